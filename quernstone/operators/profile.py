"""What tables there are, and what is in their columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_inventory(tables: Mapping[str, DataFrame], kind: str = "BASE TABLE") -> DataFrame:
    """Name, kind and row count of each table, by name. A parquet count reads footers only."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(kind).alias("table_type"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, its limits, and what one pass over the data found.

    ``max_length`` is of strings, in characters; ``min_value`` and ``max_value``
    are text, and null for types without an order.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, field in enumerate(df.schema.fields):
        value, kind = F.col(f"`{field.name}`"), field.dataType
        ordered = isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
        longest = F.max(F.length(value)) if isinstance(kind, T.StringType) else F.lit(None).cast("int")
        aggregates += [
            F.count(value).alias(f"filled_{i}"),
            longest.alias(f"longest_{i}"),
            (F.min(value).cast("string") if ordered else F.lit(None).cast("string")).alias(f"min_{i}"),
            (F.max(value).cast("string") if ordered else F.lit(None).cast("string")).alias(f"max_{i}"),
        ]
        precision, scale = _limits(kind)
        rows.append(
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(kind.simpleString()).alias("data_type"),
                F.lit(field.nullable).alias("nullable"),
                F.lit(precision).cast("int").alias("precision"),
                F.lit(scale).cast("int").alias("scale"),
                F.col(f"longest_{i}").alias("max_length"),
                (F.col("rows") - F.col(f"filled_{i}")).alias("null_count"),
                F.col(f"min_{i}").alias("min_value"),
                F.col(f"max_{i}").alias("max_value"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


# Digits and scale that the information schema of a warehouse reports for integers.
INTEGER_DIGITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _limits(kind: T.DataType) -> tuple[int | None, int | None]:
    if isinstance(kind, T.DecimalType):
        return kind.precision, kind.scale
    if isinstance(kind, T.IntegralType):
        return INTEGER_DIGITS[kind.simpleString()], 0
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (24 if isinstance(kind, T.FloatType) else 53), None
    return None, None
