"""Text files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """key, size and last_modified of every file below a path. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    return files.load(path).select(
        F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    )


def read_text_documents(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """source_path and text of every UTF-8 file below a path, one row per file."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True)
    # The path is given as a URI, in which only % marks an escape.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return texts.select(path.alias("source_path"), F.col("value").alias("text"))
