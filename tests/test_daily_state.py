"""Reports from stored daily sums against those of the full table."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import metrics, nulls, row_counts
from quernstone.plans import daily_state
from quernstone.plans.daily_state import read_daily_state, state_log, update_daily_state
from quernstone.sources.scratch import scratch_path

SCHEMA = "day date, shop string, amount double, note string, n long, path string"


def made_up(spark, seed, days, n=60):
    draw = random.Random(seed)
    rows = [
        (
            None if draw.random() < 0.03 else dt.date(2024, 1, draw.choice(days)),
            draw.choice(["a", "b", "c d", None]),
            None if draw.random() < 0.2 else draw.randrange(1000) / 4,
            draw.choice([None, "x"]),
            draw.randrange(5),
            "clashing",
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_as_full(state, table):
    assert rows_of(state.row_counts()) == rows_of(row_counts.compare_row_counts_daily(table, "day"))
    full = nulls.detect_null_anomalies_daily(table, "day", 5.0, ("shop",))
    assert rows_of(state.null_anomalies(5.0, ("shop",))) == rows_of(full)
    assert rows_of(state.metric_totals()) == rows_of(metrics.metric_totals_daily(table, "amount", "day"))
    full = metrics.metric_contributors_daily(table, "amount", "shop", "day")
    assert rows_of(state.metric_contributors()) == rows_of(full)


def files_of(folder):
    return {f for f in os.listdir(folder) if f.endswith(".parquet")}


def test_new_late_changed_and_removed_files(spark, tmp_path):
    folder, root = str(tmp_path / "a table, 50%"), scratch_path(spark, "state")
    read = lambda: spark.read.schema(SCHEMA).parquet(folder)
    update = lambda: update_daily_state(read(), root, "day", "amount", "shop")
    made_up(spark, 1, [2, 3, 4]).write.parquet(folder)
    state = update()
    assert state.files_read == 1
    same_as_full(state, read())
    first = files_of(folder)
    # New days, and a late file for days that were counted.
    made_up(spark, 2, [5, 6, 9]).write.mode("append").parquet(folder)
    made_up(spark, 3, [2, 4]).write.mode("append").parquet(folder)
    state = update()
    assert state.files_read == 2
    same_as_full(state, read())
    # Nothing new: no entry.
    assert update().folders == state.folders and state_log(spark, root).count() == 2
    # A file that was written anew under its name, and one that is gone.
    name = min(first)
    other = tmp_path / "other"
    made_up(spark, 4, [3, 7], 90).write.parquet(str(other))
    (tmp_path / "a table, 50%" / name).write_bytes((other / min(files_of(other))).read_bytes())
    os.remove(f"{folder}/{min(files_of(folder) - first)}")
    for check in os.listdir(folder):
        if check.endswith(".crc"):
            os.remove(f"{folder}/{check}")
    state = update()
    assert state.files_read == 1
    same_as_full(state, read())
    assert read_daily_state(spark, root).folders == state.folders


def test_files_that_were_counted_are_not_opened(spark, tmp_path):
    folder, root = str(tmp_path / "t"), scratch_path(spark, "state")
    read = lambda: spark.read.schema(SCHEMA).parquet(folder)
    made_up(spark, 1, [2, 3]).write.parquet(folder)
    before = update_daily_state(read(), root, "day", "amount", "shop").days.collect()
    # The counted file becomes unreadable, with its size and time as they were.
    name = f"{folder}/{files_of(folder).pop()}"
    told = os.stat(name)
    with open(name, "wb") as file:
        file.write(b"x" * told.st_size)
    os.utime(name, ns=(told.st_atime_ns, told.st_mtime_ns))
    made_up(spark, 2, [8]).write.mode("append").parquet(folder)
    after = update_daily_state(read(), root, "day", "amount", "shop").days
    assert sorted(after.where("day < '2024-01-08'").collect()) == sorted(before)
    assert after.where("day = '2024-01-08'").count() == 1


def test_folders_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(daily_state, "MOST_FOLDERS", 3)
    folder, root = str(tmp_path / "t"), scratch_path(spark, "state")
    for k in range(4):
        made_up(spark, k, [2, 3, 4 + k], 20).write.mode("append").parquet(folder)
        state = update_daily_state(spark.read.parquet(folder), root, "day", "amount", "shop")
        assert state.files_read == 1 and len(state.folders) < 3
    same_as_full(state, spark.read.parquet(folder))


def test_a_failed_update_counts_nothing(spark, tmp_path, monkeypatch):
    folder, root = str(tmp_path / "t"), scratch_path(spark, "state")
    made_up(spark, 1, [2]).write.parquet(folder)
    table = spark.read.parquet(folder)
    state = update_daily_state(table, root, "day", "amount", "shop")
    made_up(spark, 2, [2]).write.mode("append").parquet(folder)
    broken = spark.read.parquet(folder).withColumn("amount", F.raise_error(F.lit("no amount")).cast("double"))
    with pytest.raises(Exception, match="no amount"):
        update_daily_state(broken, root, "day", "amount", "shop")
    assert read_daily_state(spark, root).folders == state.folders
    same_as_full(update_daily_state(spark.read.parquet(folder), root, "day", "amount", "shop"), spark.read.parquet(folder))


def test_other_columns_and_empty_tables(spark, tmp_path):
    folder, root = str(tmp_path / "t"), scratch_path(spark, "state")
    made_up(spark, 1, [2]).where("false").write.parquet(folder)
    assert read_daily_state(spark, root) is None
    state = update_daily_state(spark.read.parquet(folder), root, "day", "amount", "shop")
    assert state.row_counts().count() == state.metric_contributors().count() == 0
    with pytest.raises(ValueError, match="columns"):
        update_daily_state(spark.read.parquet(folder).drop("note"), root, "day", "amount", "shop")
    with pytest.raises(TypeError):
        update_daily_state(spark.read.parquet(folder), root, "day", "note", "shop")
