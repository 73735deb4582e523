import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from quernstone.functions.hashing import query_hash
from quernstone.operators.delivery import bounded, bounded_result, read_spilled, spill_result
from quernstone.operators.profile import profile_table, table_inventory
from quernstone.sources.scan import spread_scan


def test_query_hash(spark):
    row = spark.range(1).select(*[query_hash(F.lit(q)) for q in ("SELECT 1", "SELECT 1", "SELECT 2")]).first()
    assert row[0] == row[1] != row[2]
    assert len(row[0]) == 8 and int(row[0], 16) >= 0


def test_bounded(spark):
    whole, cut = bounded(spark.range(10), 10), bounded(spark.range(11), 10)
    assert (len(whole.rows), whole.truncated) == (10, False)
    assert (len(cut.rows), cut.truncated, cut.columns) == (10, True, ["id"])


@pytest.mark.parametrize("n, returned, is_sample", [(0, 0, False), (1, 1, False), (100, 100, False), (150, 20, True)])
def test_bounded_result(spark, tmp_path, n, returned, is_sample):
    df = spark.range(n).select("id", F.concat(F.lit("user"), "id").alias("name"))
    result = bounded_result(df, str(tmp_path), "SELECT * FROM users")
    assert (result.row_count, len(result.rows), result.is_sample) == (n, returned, is_sample)
    assert (result.path is not None) == is_sample
    assert result.columns == ["id", "name"]


def test_bounded_result_gives_the_first_rows(spark, tmp_path):
    df = spark.range(5000).repartition(8).orderBy(F.desc("id"))
    result = bounded_result(df, str(tmp_path), "q")
    assert [r["id"] for r in result.rows] == list(range(4999, 4979, -1))
    small = bounded_result(df.limit(50), str(tmp_path / "small"), "q")
    assert [r["id"] for r in small.rows] == list(range(4999, 4949, -1)) and not (tmp_path / "small").exists()


def test_spilled_times_keep_their_digits(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:07.123456' AS at, TIMESTAMP_NTZ '2024-01-01 00:00:07.000001' AS n")
    spilled = spill_result(df, str(tmp_path), "q")
    assert read_spilled(spark, spilled.path, df.schema).collect() == df.collect()


def test_spilled_rows_are_whole(spark, tmp_path):
    df = spark.range(500).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit("é\n\"")).alias("name"), (F.col("id") / 3).alias("x"),
        F.timestamp_seconds("id").alias("at"), F.array("id").alias("ids"),
    )
    spilled = spill_result(df, str(tmp_path), "q")
    assert sorted(read_spilled(spark, spilled.path, df.schema).collect()) == sorted(df.collect())
    manifest = spark.read.json(f"{spilled.path}/manifest").first()
    assert (manifest["query"], manifest["row_count"], manifest["query_hash"]) == ("q", 500, spilled.query_hash)
    parts = [f for f in os.listdir(f"{spilled.path}/rows") if f.endswith(".json.gz")]
    with gzip.open(f"{spilled.path}/rows/{parts[0]}", "rt", encoding="utf-8") as lines:
        assert set(json.loads(next(lines))) == set(df.columns)


def test_inventory(spark):
    rows = table_inventory({"b": spark.range(3), "a": spark.range(0)}).collect()
    assert [(r["table_name"], r["row_count"]) for r in rows] == [("a", 0), ("b", 3)]


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "ab", None, [1]), (None, "abc", 2.5, None)], "n int, s string, x double, l array<int>"
    ).withColumn("d", F.lit("1.50").cast("decimal(10,2)"))
    rows = {r["column_name"]: r for r in profile_table(df).collect()}
    assert [rows[c]["position"] for c in df.columns] == [1, 2, 3, 4, 5]
    assert (rows["n"]["null_count"], rows["n"]["min_value"], rows["n"]["precision"]) == (1, "1", 32)
    assert (rows["s"]["max_length"], rows["s"]["max_value"]) == (3, "abc")
    assert (rows["d"]["data_type"], rows["d"]["precision"], rows["d"]["scale"]) == ("decimal(10,2)", 10, 2)
    assert (rows["l"]["min_value"], rows["l"]["null_count"]) == (None, 1)
    assert [r["null_count"] for r in profile_table(df.limit(0)).collect()] == [0] * 5


def test_spread_scan(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(16).write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "many"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread_scan(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread_scan(one).count() == 100
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        many = spark.read.parquet(str(tmp_path / "many"))
        assert spread_scan(many) is many
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
