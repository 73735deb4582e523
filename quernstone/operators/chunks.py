"""Documents cut into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_text, document_title


def chunk_documents(
    documents: DataFrame, path_column: str = "source_path", text_column: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per chunk: ``keep`` columns, content, metadata, source_path, chunk_index. Narrow: no shuffle."""
    path = F.col(path_column).cast("string")
    pieces = documents.select(
        *keep,
        path.alias("source_path"),
        document_title(F.col(text_column), path).alias("title"),
        chunk_text(text_column).alias("chunks"),
    )
    # The outer form: from the plain one Spark infers a filter on the array's size below it,
    # and would run the batch function once more for that.
    pieces = pieces.withColumn("total", F.size("chunks"))
    exploded = pieces.select(
        *keep, "source_path", "title", "total", F.posexplode_outer("chunks").alias("at", "content")
    ).where("content is not null")
    return exploded.select(
        *keep,
        "content",
        F.struct(
            F.col("title"),
            F.col("source_path").alias("source_file"),
            F.col("at").alias("chunk_index"),
            F.col("total").alias("total_chunks"),
        ).alias("metadata"),
        "source_path",
        F.col("at").alias("chunk_index"),
    )
