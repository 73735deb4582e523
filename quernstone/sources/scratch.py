"""The shared folder that intermediate tables are written to."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that runs in one process may go without the setting, as in
    tests; a cluster must name a folder that all its executors share.
    """
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder once and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession, settings: Mapping[str, str] | None = None) -> Iterator[None]:
    """Within, shuffle files of a query go when it ends, and not when the driver next collects its garbage.

    For jobs that store tables one after the other. ``settings`` hold meanwhile too.
    """
    wanted = {CLEANUP: "true"} | dict(settings or {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def size_of(setting: str) -> int:
    """The bytes that Spark's settings give as 64m or 67108864b."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return int(number) * 1024 ** "_kmgtp".index(unit or "_")
