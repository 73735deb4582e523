"""Reversible line dedup: exact reference counts in tables, cuckoo filters in front of them, both by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, mixed, plain_text, stored

MIN_DOCUMENTS = 10
#: Keys that a shard holds on average; the number of shards follows from it.
SHARD_KEYS = 50_000
SLOTS = 4
#: Texts that are rewritten at a time.
SLICE_ROWS = 500
_BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(_BLANKS).lower()


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits of a key as two signed 64-bit numbers."""
    digest = xxhash.xxh128_digest(key)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class CuckooFilter:
    """A set of 128-bit keys by 16-bit fingerprints in two buckets of four; keys can be deleted.

    A key that was inserted is always found. Of others, about one in 8,000 is.
    ``full`` says that an insertion found no place: the shard is then rebuilt larger.
    """

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        rows = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((rows, SLOTS), dtype=np.uint16))

    @classmethod
    def built(cls, lo: np.ndarray) -> CuckooFilter:
        size = len(lo)
        while True:
            made = cls.sized(size)
            if all(made.insert(f, a) for f, a in zip(*made.places(lo))):
                return made
            size *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.buckets.tobytes()

    def places(self, lo: np.ndarray) -> tuple[list[int], list[int]]:
        """Fingerprints (never 0) and first buckets."""
        h = mixed(lo.astype(np.int64).view(np.uint64))
        prints = (h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        return prints.astype(int).tolist(), (h & np.uint64(len(self.buckets) - 1)).astype(int).tolist()

    def other(self, fingerprint: int, bucket: int) -> int:
        return bucket ^ ((fingerprint * 0x5BD1E995) & (len(self.buckets) - 1))

    def insert(self, fingerprint: int, bucket: int) -> bool:
        for k in (bucket, self.other(fingerprint, bucket)):
            free = np.flatnonzero(self.buckets[k] == 0)
            if len(free):
                self.buckets[k, free[0]] = fingerprint
                return True
        for turn in range(500):
            slot = turn % SLOTS
            fingerprint, self.buckets[bucket, slot] = int(self.buckets[bucket, slot]), fingerprint
            bucket = self.other(fingerprint, bucket)
            free = np.flatnonzero(self.buckets[bucket] == 0)
            if len(free):
                self.buckets[bucket, free[0]] = fingerprint
                return True
        return False

    def delete(self, fingerprint: int, bucket: int) -> bool:
        for k in (bucket, self.other(fingerprint, bucket)):
            at = np.flatnonzero(self.buckets[k] == fingerprint)
            if len(at):
                self.buckets[k, at[0]] = 0
                return True
        return False

    def contains(self, lo: np.ndarray) -> np.ndarray:
        prints, first = (np.array(x, dtype=np.int64) for x in self.places(lo))
        second = first ^ ((prints * 0x5BD1E995) & (len(self.buckets) - 1))
        wanted = prints[:, None].astype(np.uint16)
        return (self.buckets[first] == wanted).any(axis=1) | (self.buckets[second] == wanted).any(axis=1)


def document_keys(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The different keys of each row's lines as hashes: ``id, hi, lo``. Empty keys are left out."""
    kind = documents.schema[id_column].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pairs = [], []
            for k, text in enumerate(byte_texts(batch.column(1))):
                found = {line_key(line) for line in text.split(b"\n")}
                found.discard(b"")
                rows += [k] * len(found)
                pairs += [key_hash(key) for key in sorted(found)]
            hashes = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])],
                ["id", "hi", "lo"],
            )

    chosen = documents.select(F.col(id_column).alias("id"), plain_text(text_column).alias("text"))
    return chosen.mapInArrow(keys, f"id {kind}, hi long, lo long")


class LineLedger:
    """How many documents hold each line, kept so that documents can come and go.

    Two tables per state, both by shard of the key's hash: ``counts`` (exact,
    ``shard, hi, lo, documents``) and ``filters`` (``shard, keys, filter``), a
    cuckoo filter of the keys that at least ``min_documents`` documents hold. A
    change reads its keys' old counts, writes new tables and replaces the state,
    so a failed change leaves the old one. Only keys that pass the limit, either
    way, touch a filter: they are inserted or deleted, and a filter that is full
    is built anew from the counts. The number of shards is fixed by the first insertion.
    """

    def __init__(self, spark: SparkSession, min_documents: int = MIN_DOCUMENTS, shards: int | None = None):
        self.spark, self.min_documents, self.shards = spark, min_documents, shards
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None

    def insert(self, documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> None:
        """Count the documents' lines; ids must not be in the ledger yet."""
        self._change(documents, id_column, text_column, 1)

    def delete(self, documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> None:
        """Take back documents that were inserted with these texts."""
        self._change(documents, id_column, text_column, -1)

    def _shard(self):
        return F.pmod(F.col("hi"), F.lit(self.shards)).cast("int")

    def _change(self, documents: DataFrame, id_column: str, text_column: str, sign: int) -> None:
        # Rows of one document are one document; rows without id are none.
        keys = document_keys(documents, id_column, text_column)
        change = keys.groupBy("hi", "lo").agg((sign * F.count_distinct("id")).alias("delta")).where("delta <> 0")
        change = stored(change, "line-changes")
        if self.shards is None:
            self.shards = 1 + change.count() // SHARD_KEYS
        change = change.withColumn("shard", self._shard())
        if self.counts is None:
            joined = change.withColumn("before", F.lit(0).cast("long"))
        else:
            joined = change.join(self.counts, ["shard", "hi", "lo"], "full").select(
                "shard", "hi", "lo",
                F.coalesce("delta", F.lit(0)).cast("long").alias("delta"),
                F.coalesce("documents", F.lit(0)).cast("long").alias("before"),
            )
        joined = joined.withColumn("documents", F.col("before") + F.col("delta"))
        steps = stored(joined.select("shard", "hi", "lo", "before", "documents"), "line-steps")
        self.filters = stored(self._filtered(steps), "line-filters")
        self.counts = steps.where("documents > 0").select("shard", "hi", "lo", "documents")

    def _filtered(self, steps: DataFrame) -> DataFrame:
        least = self.min_documents
        held = (F.col("documents") >= least).cast("int")
        moved = held - (F.col("before") >= least).cast("int")
        keys = steps.select("shard", "lo", held.alias("held"), moved.alias("moved")).where("held = 1 OR moved <> 0")
        old = self.filters
        if old is None:
            old = self.spark.createDataFrame([], "shard int, keys long, filter binary")

        def update(key, left: pa.Table, right: pa.Table) -> pa.Table:
            lo = left.column("lo").to_numpy()
            held, moved = left.column("held").to_numpy(), left.column("moved").to_numpy()
            kept = lo[held == 1]
            made = None
            if right.num_rows:
                made = CuckooFilter.from_bytes(right.column("filter")[0].as_py())
                for which, step in ((-1, made.delete), (1, made.insert)):
                    if not all(step(f, a) for f, a in zip(*made.places(lo[moved == which]))):
                        made = None
                        break
            if made is None:
                made = CuckooFilter.built(kept)
            return pa.table(
                {
                    "shard": pa.array([key[0].as_py()], pa.int32()),
                    "keys": pa.array([len(kept)], pa.int64()),
                    "filter": pa.array([made.to_bytes()], pa.binary()),
                }
            )

        return (
            keys.groupBy("shard")
            .cogroup(old.groupBy("shard"))
            .applyInArrow(update, "shard int, keys long, filter binary")
        )

    def blocked(self, keys: DataFrame) -> DataFrame:
        """Those of the different keys (``hi, lo``) that enough documents hold.

        The shard's filter turns most of the others away; the counts decide on the rest.
        """
        asked = keys.withColumn("shard", self._shard())

        def look(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return left.slice(0, 0).select(["shard", "hi", "lo"])
            made = CuckooFilter.from_bytes(right.column("filter")[0].as_py())
            found = made.contains(left.column("lo").to_numpy())
            return left.select(["shard", "hi", "lo"]).filter(pa.array(found))

        maybe = (
            asked.groupBy("shard")
            .cogroup(self.filters.groupBy("shard"))
            .applyInArrow(look, "shard int, hi long, lo long")
        )
        exact = self.counts.where(F.col("documents") >= self.min_documents)
        return maybe.join(exact, ["shard", "hi", "lo"], "left_semi").select("hi", "lo")

    def drop_lines(self, documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """``id, kept_text, n_lines, n_dropped`` of each row: its text without the blocked lines.

        Null and empty texts are one empty line, which stays. Rows without id
        lose their blocked lines like others. No rows give no rows.
        """
        rows = documents.select(F.col(id_column).alias("id"), plain_text(text_column).alias("text"))
        return self._rewritten(rows, "id", "text").select("id", F.col("text").alias("kept_text"), "n_lines", "n_dropped")

    def _rewritten(self, rows: DataFrame, key: str, text_column: str) -> DataFrame:
        """The rows with all their columns, ``text_column`` without the blocked lines, ``n_lines`` and ``n_dropped``.

        ``key`` names a column by which rows find their blocked lines. Rows may
        share a key: blocked lines are the same for all rows, so those of another row take nothing more.
        """
        held = stored(document_keys(rows, key, text_column), "line-keys")
        blocked = self.blocked(held.select("hi", "lo").distinct())
        hits = held.join(blocked, ["hi", "lo"])
        hits = hits.groupBy("id").agg(F.collect_set(F.struct("hi", "lo")).alias("__l_blocked"))
        hits = hits.withColumnRenamed("id", "__l_hit")
        joined = rows.join(hits, rows[key].eqNullSafe(hits["__l_hit"]), "left").drop("__l_hit")
        # One struct of the other columns, so that whatever they are called, a row stays one row.
        others = [c for c in rows.columns if c != text_column]
        chosen = joined.select(plain_text(text_column).alias("text"), "__l_blocked", F.struct(*others).alias("row"))
        kind = chosen.schema["row"].dataType.simpleString()

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts_of = (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS))
            for batch in parts_of:
                texts, lines, dropped = [], [], []
                for text, gone in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist()):
                    parts = text.split(b"\n")
                    lines.append(len(parts))
                    if gone:
                        lost = {(g["hi"], g["lo"]) for g in gone}
                        parts = [p for p in parts if not (key := line_key(p)) or key_hash(key) not in lost]
                    dropped.append(lines[-1] - len(parts))
                    texts.append(b"\n".join(parts) if dropped[-1] else text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.array(lines, pa.int64()),
                        pa.array(dropped, pa.int64()),
                    ],
                    ["row", "kept_text", "n_lines", "n_dropped"],
                )

        made = chosen.mapInArrow(rewrite, f"row {kind}, kept_text string, n_lines long, n_dropped long")
        columns = [F.col("kept_text" if c == text_column else f"row.`{c}`").alias(c) for c in rows.columns]
        return made.select(*columns, "n_lines", "n_dropped")


def dedup_lines(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """Lines that ``min_documents`` documents hold go from all documents; see ``LineLedger.drop_lines``."""
    ledger = LineLedger(documents.sparkSession, min_documents)
    ledger.insert(documents, id_column, text_column)
    return ledger.drop_lines(documents, id_column, text_column)


def without_repeated_lines(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """The documents with their columns as given and their texts after ``dedup_lines``.

    A row per row given, also of rows without id and of repeated ids; ``n_chars``, where there is one, is counted anew.
    """
    ledger = LineLedger(documents.sparkSession, min_documents)
    ledger.insert(documents, id_column, text_column)
    # Rows without id must not meet in one key.
    rows = documents.withColumn(text_column, plain_text(text_column))
    rows = rows.withColumn("__l_key", F.xxhash64(id_column, text_column))
    kept = ledger._rewritten(rows, "__l_key", text_column)
    if "n_chars" in documents.columns:
        kept = kept.withColumn("n_chars", F.length(text_column).cast(documents.schema["n_chars"].dataType))
    return kept.select(*documents.columns)
