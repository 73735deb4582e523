"""Texts to vectors: a caller's model in batches, or hashed TF-IDF without any model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import by_slices

DIMENSIONS = 1024


def embed_documents(
    df: DataFrame,
    model: Callable[[list[str]], Sequence[Sequence[float]]],
    text_column: str = "content",
    vector_column: str = "embedding",
) -> DataFrame:
    """Add ``array<float>`` vectors of unit length from a model called for up to ``SLICE_ROWS`` texts at a time."""

    def embed_rows(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], type=pa.list_(pa.float32()))
        rows = np.asarray(model([t or "" for t in texts.to_pylist()]), dtype="f8")
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        unit = np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)
        return pa.array([r.astype("f4") for r in unit], type=pa.list_(pa.float32()))

    def embed_batch(texts: pa.Array) -> pa.Array:
        return by_slices(texts, embed_rows)

    return df.withColumn(vector_column, F.arrow_udf(embed_batch, "array<float>")(text_column))


class TfidfEmbedder:
    """Hashed, inverse-document-frequency weighted term counts of unit length.

    Works on a column of index words (``functions.text.english_index``), so that
    a stored one is not worked out again.
    """

    def __init__(self, model: PipelineModel):
        self.model = model

    @classmethod
    def fit(cls, df: DataFrame, words_column: str = "words", dimensions: int = DIMENSIONS) -> TfidfEmbedder:
        counter = HashingTF(inputCol="__terms", outputCol="__counts", numFeatures=dimensions)
        weights = IDF(inputCol="__counts", outputCol="__weighted").fit(counter.transform(_terms(df, words_column)))
        return cls(PipelineModel([counter, weights, Normalizer(inputCol="__weighted", outputCol="__unit")]))

    def transform(
        self, df: DataFrame, words_column: str = "words", vector_column: str = "embedding"
    ) -> DataFrame:
        unit = self.model.transform(_terms(df, words_column))
        return unit.withColumn(vector_column, vector_to_array("__unit", "float32")).drop(
            "__terms", "__counts", "__weighted", "__unit"
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> TfidfEmbedder:
        return cls(PipelineModel.load(path))


def _terms(df: DataFrame, words_column: str) -> DataFrame:
    # A text without words counts as empty.
    return df.withColumn("__terms", F.coalesce(F.array_compact(words_column), F.array().cast("array<string>")))
