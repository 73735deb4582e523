"""Vectors of texts, kept by the hash of the text: each different text goes to the model once.

A store is a folder: a log, and one folder of vectors per call that had new
texts. A folder counts once it is in the log, so what a failed or retried call
wrote is never read. Texts are told apart by their SHA-256, models by the name
that the caller gives them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Model = Callable[[list[str]], Sequence[Sequence[float]]]

#: One call of a model gets so many texts, or texts of so many characters, at most; a longer text goes alone.
BATCH_TEXTS, BATCH_CHARS = 64, 100_000
#: A store of so many folders is merged into one by the next call.
MOST_FOLDERS = 32
VECTORS = "text_hash string, embedding array<float>"
LOG = "model string, folders array<string>, n_texts long, at timestamp, entry string"


def embed_once(
    df: DataFrame, model: Model, store: str, name: str, text_column: str = "content", vector_column: str = "embedding"
) -> DataFrame:
    """Add vectors of unit length to the rows of ``df``; texts that the store has are not given to the model.

    ``name`` says which model it is; another name has vectors of its own. Null
    texts count as empty. The new texts are brought together by their hash, a
    repeated one once per task before that, so that neither copies nor a text
    that fills a third of the table cost more than one call. The result reads
    the store, so it can be worked out again without the model. One call at a
    time may write to a store.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    hashed = df.withColumn("__text_hash", F.sha2(text, 256))
    folders = store_folders(spark, store, name)
    different = hashed.select(F.col("__text_hash").alias("text_hash"), text.alias("text")).dropDuplicates(["text_hash"])
    new = different.join(read_vectors(spark, store, folders).select("text_hash"), "text_hash", "left_anti")
    folder = uuid.uuid4().hex
    new.mapInArrow(_embedding(model), VECTORS).write.parquet(f"{store}/vectors/{folder}")
    added = spark.read.schema(VECTORS).parquet(f"{store}/vectors/{folder}").count()
    if added:
        folders = [*folders, folder]
        if len(folders) >= MOST_FOLDERS:
            merged = uuid.uuid4().hex
            read_vectors(spark, store, folders).write.parquet(f"{store}/vectors/{merged}")
            folders = [merged]
        row = spark.createDataFrame([(name, folders, added)], "model string, folders array<string>, n_texts long")
        stamped = row.select("*", F.current_timestamp().alias("at"), F.uuid().alias("entry"))
        stamped.coalesce(1).write.mode("append").parquet(f"{store}/log")
    vectors = read_vectors(spark, store, folders).withColumnRenamed("text_hash", "__text_hash")
    vectors = vectors.withColumnRenamed("embedding", vector_column)
    return hashed.join(vectors, "__text_hash", "left").select(*df.columns, vector_column)


def store_log(spark: SparkSession, store: str) -> DataFrame:
    """One row per call that had new texts: model, folders, n_texts, at, entry."""
    try:
        return spark.read.schema(LOG).parquet(f"{store}/log")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def store_folders(spark: SparkSession, store: str, name: str) -> list[str]:
    """The folders that hold the vectors of a model, fewer than ``MOST_FOLDERS``."""
    log = store_log(spark, store).where(F.col("model") == name)
    last = log.agg(F.max_by("folders", F.struct("at", "entry"))).first()[0]
    return last or []


def read_vectors(spark: SparkSession, store: str, folders: Sequence[str]) -> DataFrame:
    """text_hash, embedding of some folders; every hash stands in one of them."""
    parts = [spark.read.schema(VECTORS).parquet(f"{store}/vectors/{folder}") for folder in folders]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], VECTORS)


def batches_of(texts: list[str], most_texts: int = BATCH_TEXTS, most_chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ends of neighbouring texts that go to a model together."""
    start = chars = 0
    for k, text in enumerate(texts):
        if k > start and (k - start >= most_texts or chars + len(text) > most_chars):
            yield start, k
            start, chars = k, 0
        chars += len(text)
    if texts:
        yield start, len(texts)


def _embedding(model: Model):
    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in batches_of(texts):
                rows = np.asarray(model(texts[start:end]), dtype="f8")
                if len(rows) != end - start:
                    raise ValueError(f"the model gave {len(rows)} vectors for {end - start} texts")
                lengths = np.linalg.norm(rows, axis=1, keepdims=True)
                unit = np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0).astype("f4")
                vectors = pa.array(list(unit), type=pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), vectors], ["text_hash", "embedding"]
                )

    return embed
