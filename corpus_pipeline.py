"""The corpus pipeline: documents to packed sequences, a stage after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import stored
from quernstone.llm.line_dedup import without_repeated_lines
from quernstone.llm.mixing import mixed_documents
from quernstone.llm.ngram_join import one_of_each
from quernstone.llm.packing import pack_documents
from quernstone.llm.quality import kept_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, without the lines that are boilerplate of their host.

    Null and empty texts have no words and go, as all short texts do; a long
    text is judged whole. Rows are judged one by one, so repeated rows and rows
    without id stay or go alike. No rows give no rows; other columns are kept.
    """
    return kept_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that many of them hold; ``n_chars`` is counted anew.

    A row per row given: null texts become empty, repeated rows and rows without
    id lose the same lines as others, and rows of one id count as one document.
    No rows give no rows; other columns are kept.
    """
    return without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 80 of 100), the one with the smallest id.

    Rows without id and texts without words are near to nothing and stay, and
    rows of one id stay or go together. No rows give no rows; other columns are kept.
    """
    return one_of_each(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows of one id and text are taken alike, rows without id by a hash of their
    text, so that any partitioning gives the same rows. Null and empty texts
    have no words and come as often as their source is taken whole, or once
    more. No rows give no rows; other columns are kept.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences.

    Null and empty texts are one piece of the end token; repeated rows and rows
    without id are documents of their own; long texts are cut into several
    pieces. No rows give no rows. Pieces alike in length may swap their places
    from run to run.
    """
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", mixture),
    ("best_fit_packing", packing),
]

#: Token ids are not to be had in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
