"""Document fingerprints by I-Match over randomised lexicons."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, byte_texts, mixed, plain_text

#: Terms in more than ``MAX_SHARE`` or less than ``MIN_SHARE`` of the documents are left out.
MIN_SHARE, MAX_SHARE = 0.0005, 0.1
#: Families of nested random lexicons.
FAMILIES = 64
_FLUSH = 400_000
_SIGNS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def terms(text: bytes) -> set[bytes]:
    """The different words of a text in lower case (A-Z); ASCII signs part words."""
    return set(text.translate(_SIGNS).split())


def lexicon(documents: DataFrame, text_column: str = "text", min_share: float = MIN_SHARE,
            max_share: float = MAX_SHARE) -> np.ndarray:
    """Sorted 64-bit hashes of the terms within the band of document frequencies, over all documents.

    A band of idf from ``-ln(max_share)`` to ``-ln(min_share)``. As a term of it
    is in ``min_share`` of the documents at least, the lexicon has no more than
    (mean number of different terms of a document) / ``min_share`` terms, however many documents there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = Counter(), WordHashes()

        def rows() -> pa.RecordBatch:
            found = hashes.of(list(held)).view(np.int64)
            counts = np.fromiter(held.values(), dtype=np.int64, count=len(held))
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["term", "n"])

        documents = 0
        for batch in batches:
            documents += batch.num_rows
            for text in byte_texts(batch.column(0)):
                held.update(terms(text))
                if len(held) >= _FLUSH:
                    yield rows()
                    held = Counter()
        yield rows()

    texts = documents.select(plain_text(text_column).alias("text"))
    total = documents.count()
    counts = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= min_share * total) & (F.col("n") <= max_share * total)).select("term")
    return np.sort(band.toArrow().column("term").to_numpy().view(np.uint64))


class Fingerprinter:
    """Fingerprints of texts by one lexicon.

    A family is a chain of lexicons, each a random half of the one before. Of
    each family the fingerprint holds the hash of the text's terms in the
    smallest lexicon that still holds one of them; before them stands the hash
    by the whole lexicon. Terms are distinct and their hashes are added up, so
    the order in which they are found does not count. A text without terms of
    the lexicon is fingerprinted by all its terms.
    """

    def __init__(self, lexicon: np.ndarray, families: int = FAMILIES):
        self.lexicon = lexicon
        self.hashes = WordHashes()
        odd = np.arange(1, families + 1, dtype=np.uint64)
        self.factors, self.shifts = mixed(odd) | np.uint64(1), mixed(~odd)

    def of(self, text: bytes) -> np.ndarray:
        """The whole lexicon's hash, then each family's."""
        found = self.hashes.of(list(terms(text)))
        if len(self.lexicon) and len(found):
            at = np.minimum(np.searchsorted(self.lexicon, found), len(self.lexicon) - 1)
            inside = self.lexicon[at] == found
            found = found[inside] if inside.any() else found
        if not len(found):
            return np.zeros(len(self.factors) + 1, dtype=np.uint64)
        ranks = found[:, None] * self.factors + self.shifts
        # A lexicon of a family holds the ranks below a power of two.
        bits = np.frexp(ranks.min(axis=0).astype(np.float64))[1]
        inside = ranks < np.ldexp(1.0, bits)
        values = mixed(found)
        sums = np.where(inside, values[:, None], np.uint64(0)).sum(axis=0, dtype=np.uint64)
        return np.concatenate([[values.sum(dtype=np.uint64)], mixed(sums + bits.astype(np.uint64))])

    @staticmethod
    def text_of(fingerprint: np.ndarray) -> str:
        return f"{int(fingerprint[0]):016x}" + (fingerprint[1:] >> np.uint64(32)).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of families that agree."""
    return float((a[1:] >> np.uint64(32) == b[1:] >> np.uint64(32)).mean())


def fingerprints(documents: DataFrame, lexicon: np.ndarray, id_column: str = "doc_id", text_column: str = "text",
                 families: int = FAMILIES) -> DataFrame:
    """``id, fingerprint`` of each row. Null texts are empty; equal texts have equal fingerprints."""
    held = documents.sparkSession.sparkContext.broadcast(lexicon)
    kind = documents.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(held.value, families)
        for batch in batches:
            found = [maker.text_of(maker.of(text)) for text in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    return documents.select(F.col(id_column).alias("id"), plain_text(text_column).alias("text")).mapInArrow(
        work, f"id {kind}, fingerprint string"
    )


def chained(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``bucket, guest, id, text``, sorted within partitions: each bucket a run of ids, and the next one's first.

    Ids are cut into buckets at quantiles. The first row of a bucket is also the
    last, as a guest, of the bucket before (of the last one, for the first), so
    that each row that is no guest has the next document behind it. Texts move once.
    """
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(
        F.col(id_column).alias("id"), plain_text(text_column).alias("text"), F.col(id_column).cast("double").alias("at")
    )
    shares = [k / (4 * partitions) for k in range(1, 4 * partitions)]
    cuts = rows.agg(F.percentile_approx("at", shares, 100_000)).first()[0] or []
    edges = sorted({-float("inf"), *(cuts or [0.0]), float("inf")})
    bucketed = Bucketizer(splits=edges, inputCol="at", outputCol="cut", handleInvalid="keep").transform(rows)
    bucketed = bucketed.withColumn("bucket", F.col("cut").cast("int"))
    # One row per bucket: four times as many as there are partitions at most.
    firsts = bucketed.where("id IS NOT NULL").groupBy("bucket").agg(F.min("id").alias("first")).orderBy("bucket").collect()
    last = firsts[-1]["bucket"] if firsts else 0
    bucketed = bucketed.withColumn("bucket", F.when(F.col("id").isNull(), last).otherwise(F.col("bucket")))
    before = {r["first"]: firsts[k - 1]["bucket"] for k, r in enumerate(firsts)}
    kind = documents.schema[id_column].dataType.simpleString()
    guests = spark.createDataFrame(list(before.items()), f"first {kind}, before int")
    joined = bucketed.join(F.broadcast(guests), F.col("id") == F.col("first"), "left")
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))
    spread = joined.select(F.explode(places).alias("p"), "id", "text").select("p.bucket", "p.guest", "id", "text")
    return spread.repartition(partitions, "bucket").sortWithinPartitions("bucket", "guest", F.col("id").asc_nulls_last())


def edited_texts(
    documents: DataFrame, lexicon: np.ndarray, id_column: str = "doc_id", text_column: str = "text",
    families: int = FAMILIES,
) -> DataFrame:
    """Fingerprints of each text, of the same text with its second half from the next document, and their likeness.

    Returns ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The next document is the one with the next higher
    id (the first one's after the last); of rows with one id, any comes first.
    A single document follows itself. Null texts are empty. Rows without id come
    last, before the first. No rows give no rows; other columns are not read.
    """
    import hashlib

    kind = documents.schema[id_column].dataType.simpleString()
    held = documents.sparkSession.sparkContext.broadcast(lexicon)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def found(maker: Fingerprinter, row: tuple, after: tuple) -> tuple:
        _, _, key, own, mark = row
        half = len(own) // 2
        edited = (own[: len(own) - half] + after[3][:half]).encode()
        new = maker.of(edited)
        return (
            key, len(own), hashlib.sha256(edited).hexdigest(), maker.text_of(mark), maker.text_of(new),
            likeness(mark, new), likeness(mark, after[4]),
        )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (key_type[0], pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)

    key_type: list[pa.DataType] = []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, head, last = Fingerprinter(held.value, families), None, None
        for batch in batches:
            key_type[:] = [batch.schema.field("id").type]
            out = []
            columns = (batch.column(c).to_pylist() for c in ("bucket", "guest", "id", "text"))
            for bucket, guest, key, text in zip(*columns):
                row = (bucket, guest, key, text, maker.of(text.encode()))
                if last is None or last[0] != bucket:
                    # Only a table without ids has a bucket that no guest ends.
                    if last is not None and not last[1]:
                        out.append(found(maker, last, head))
                    head = row
                elif not last[1]:
                    out.append(found(maker, last, row))
                last = row
            yield batch_of(out)
        if last is not None and not last[1]:
            yield batch_of([found(maker, last, head)])

    return chained(documents, id_column, text_column).mapInArrow(
        work,
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
