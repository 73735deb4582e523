"""Results handed to a caller: bounded in memory, whole on storage."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hashing import query_hash

INLINE_ROWS, SAMPLE_ROWS = 100, 20
QUERY_LIMIT = 1000
# Times with all the digits Spark keeps.
TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


@dataclass(frozen=True)
class Bounded:
    columns: list[str]
    rows: list[Row]
    truncated: bool


def bounded(df: DataFrame, limit: int = QUERY_LIMIT) -> Bounded:
    """The first ``limit`` rows, and whether there are more."""
    rows = df.limit(limit + 1).collect()
    return Bounded(df.columns, rows[:limit], len(rows) > limit)


@dataclass(frozen=True)
class Spilled:
    path: str
    query_hash: str
    columns: list[str]
    row_count: int


def spill_result(df: DataFrame, folder: str, query: str) -> Spilled:
    """Write a whole result as gzipped JSON lines in a new folder, with a one-row manifest beside it.

    The executors write; rows are counted on their way out, in the stage that
    commits them, so that a retried task counts once and nothing is read twice.
    """
    spark = df.sparkSession
    digest = spark.range(1).select(query_hash(F.lit(query))).first()[0]
    stamp = dt.datetime.now(dt.UTC).strftime("%Y/%m/%d/%H%M%S")
    path = f"{folder.rstrip('/')}/{stamp}/{digest}_{uuid.uuid4().hex[:8]}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.options(**TIMES).json(f"{path}/rows", compression="gzip", ignoreNullFields=False)
    spilled = Spilled(path, digest, df.columns, seen.get["rows"])
    manifest = [(query, digest, df.columns, spilled.row_count)]
    spark.createDataFrame(
        manifest, "query string, query_hash string, columns array<string>, row_count long"
    ).coalesce(1).write.json(f"{path}/manifest")
    return spilled


def read_spilled(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a spilled result, with the schema they were written with."""
    return spark.read.schema(schema).options(**TIMES).json(f"{path}/rows")


@dataclass(frozen=True)
class Delivered:
    row_count: int
    columns: list[str]
    rows: list[Row]
    is_sample: bool
    path: str | None


def bounded_result(
    df: DataFrame, folder: str, query: str, inline_rows: int = INLINE_ROWS, sample_rows: int = SAMPLE_ROWS
) -> Delivered:
    """All rows of a small result; the first rows of a large one, which is written out whole.

    Rows come in the order of ``df``. A small result writes nothing. A large one
    is worked out twice, for its first rows and for the files, as files do not
    keep the order; cache ``df`` where that is dear.
    """
    rows = df.limit(inline_rows + 1).collect()
    if len(rows) <= inline_rows:
        return Delivered(len(rows), df.columns, rows, False, None)
    spilled = spill_result(df, folder, query)
    return Delivered(spilled.row_count, spilled.columns, rows[:sample_rows], True, spilled.path)
