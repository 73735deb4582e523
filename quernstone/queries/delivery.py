"""Delivery, inventory and profiling queries, each with its SQL where it has one."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators.delivery import bounded, bounded_result, read_spilled, spill_result
from ..operators.profile import profile_table, table_inventory
from ..sources.files import list_files, read_text_documents
from ..sources.scratch import scratch_path
from .tables import read

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
ORDER_QUERY = "SELECT * FROM customer"


def _bounded(spark, sf_dir):
    """Whether each table fits the default query limit, and how much of it is returned."""
    rows = []
    for name in TABLES:
        result = bounded(read(spark, sf_dir, name))
        rows.append((name, len(result.columns), len(result.rows), result.truncated))
    return spark.createDataFrame(rows, "table_name string, n_columns int, n_rows int, truncated boolean")


def _bounded_result(spark, sf_dir):
    rows = []
    for name in ("region", "nation", "customer", "orders"):
        given = bounded_result(read(spark, sf_dir, name), scratch_path(spark, "results"), f"SELECT * FROM {name}")
        rows.append((name, given.row_count, len(given.columns), len(given.rows), given.is_sample))
    return spark.createDataFrame(
        rows, "table_name string, row_count long, n_columns int, n_rows int, is_sample boolean"
    )


def _spill(spark, sf_dir):
    table = read(spark, sf_dir, "customer")
    spilled = spill_result(table, scratch_path(spark, "results"), ORDER_QUERY)
    return read_spilled(spark, spilled.path, table.schema)


def _spill_table(name, spark, sf_dir):
    """A table with times, written and read back."""
    table = read(spark, sf_dir, name)
    spilled = spill_result(table, scratch_path(spark, "results"), f"SELECT * FROM {name}")
    return read_spilled(spark, spilled.path, table.schema)


def _bounded_rows(spark, sf_dir):
    """The rows given of an ordered result of many partitions, with their places."""
    ordered = read(spark, sf_dir, "orders").repartition(8).orderBy(F.desc("o_totalprice"), "o_orderkey")
    given = bounded_result(ordered, scratch_path(spark, "results"), "SELECT * FROM orders ORDER BY o_totalprice DESC")
    rows = [(place, *row) for place, row in enumerate(given.rows, 1)]
    fields = ", ".join(f"{name} {kind}" for name, kind in ordered.dtypes)
    return spark.createDataFrame(rows, f"place long, {fields}")


def _manifest(spark, sf_dir):
    spilled = spill_result(read(spark, sf_dir, "customer"), scratch_path(spark, "results"), ORDER_QUERY)
    return spark.read.json(f"{spilled.path}/manifest").select(
        "query", "query_hash", F.array_join("columns", ",").alias("columns"), "row_count"
    )


def _inventory(spark, sf_dir):
    return table_inventory({name: read(spark, sf_dir, name) for name in TABLES})


def _profile(table, spark, sf_dir):
    return profile_table(read(spark, sf_dir, table))


def _text_files(spark, sf_dir):
    """Documents written as text files by language, and each file read back as one text."""
    folder = scratch_path(spark, "texts")
    read(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(folder)
    files = read_text_documents(spark, folder, ".txt")
    lang = F.regexp_extract("source_path", "lang=([a-z]+)", 1)
    return files.groupBy(lang.alias("lang")).agg(F.sum(F.length("text")).alias("chars"))


QUERIES = {
    "bounded_query": _bounded,
    "bounded_result": _bounded_result,
    "bounded_result_rows": _bounded_rows,
    "spill_result": _spill,
    "spill_events": partial(_spill_table, "events"),
    "spill_orders": partial(_spill_table, "orders"),
    "spill_manifest": _manifest,
    "table_inventory": _inventory,
    "profile_orders": partial(_profile, "orders"),
    "profile_customer": partial(_profile, "customer"),
    "profile_documents": partial(_profile, "documents"),
    "list_files": lambda spark, d: list_files(spark, d, ".parquet"),
    "read_text_documents": _text_files,
}

_SHAPES = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name}) AS n,"
    f" (SELECT count(*) FROM (DESCRIBE {name})) AS n_columns"
    for name in TABLES
)


def _profile_sql(table: str, columns: list[tuple[str, str]]) -> str:
    """Rows of ``profile_table`` for columns given with their Spark types."""
    limits = {"bigint": "64, 0", "int": "32, 0", "double": "53, NULL"}
    parts = []
    for i, (name, kind) in enumerate(columns):
        precision, scale = limits.get(kind, "NULL, NULL").split(", ")
        longest = f"max(length({name}))::INTEGER" if kind == "string" else "NULL::INTEGER"
        parts.append(
            f"SELECT {i + 1} AS position, '{name}' AS column_name, '{kind}' AS data_type, TRUE AS nullable,"
            f" {precision}::INTEGER AS precision, {scale}::INTEGER AS scale, {longest} AS max_length,"
            f" count(*) - count({name}) AS null_count, CAST(min({name}) AS VARCHAR) AS min_value,"
            f" CAST(max({name}) AS VARCHAR) AS max_value FROM {table}"
        )
    return " UNION ALL ".join(parts)


ORACLES = {
    "bounded_query": f"""SELECT table_name, n_columns::INTEGER AS n_columns, least(n, 1000)::INTEGER AS n_rows,
  n > 1000 AS truncated FROM ({_SHAPES})""",
    "bounded_result": f"""SELECT table_name, n AS row_count, n_columns::INTEGER AS n_columns,
  (CASE WHEN n > 100 THEN 20 ELSE n END)::INTEGER AS n_rows, n > 100 AS is_sample
FROM ({_SHAPES}) WHERE table_name IN ('region', 'nation', 'customer', 'orders')""",
    "bounded_result_rows": """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, *
FROM orders ORDER BY place LIMIT 20""",
    "spill_result": "SELECT * FROM customer",
    "spill_events": "SELECT * FROM events",
    "spill_orders": "SELECT * FROM orders",
    "spill_manifest": f"""SELECT '{ORDER_QUERY}' AS query, left(sha256('{ORDER_QUERY}'), 8) AS query_hash,
  (SELECT string_agg(column_name, ',') FROM (DESCRIBE customer)) AS columns, count(*) AS row_count FROM customer""",
    "table_inventory": f"SELECT table_name, 'BASE TABLE' AS table_type, n AS row_count FROM ({_SHAPES})",
    "profile_orders": _profile_sql(
        "orders",
        [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
         ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    ),
    "profile_customer": _profile_sql(
        "customer",
        [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
         ("c_mktsegment", "string")],
    ),
    "profile_documents": _profile_sql(
        "documents",
        [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
    ),
    "read_text_documents": "SELECT lang, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY lang",
}
