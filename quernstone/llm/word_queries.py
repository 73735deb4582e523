"""The registered queries over words and tokens, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import decode_documents, encode_documents
from .common import plain_text, words_of
from .periodic_runs import longest_by_exponent, periodic_runs
from .spelling import FORM_TIMES, LEAST_COUNT, LEAST_LETTERS, spelling_variants, word_counts

#: One word in so many of a document loses a letter before words are counted.
DROP_ONE_IN = 199


def with_planted_runs(documents):
    """The documents of which a tenth, by the checksum of the id, end in a repeated stretch of their words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Rows without id have no checksum and stay as they are, as texts without words do.
    chosen = documents.select("doc_id", "text", h.alias("h"))
    chosen = chosen.select("*", F.when(F.col("h") % 10 == 0, words_of(plain_text("text"))).alias("words"))
    chosen = chosen.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.when(F.size("words") > 0, F.size("words")))
    cut = chosen.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    a, p, left = F.col("a"), F.col("p"), F.col("n") - F.col("a")
    cut = cut.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    cycle = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(left / p).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(cycle, F.lit(1), left)), " ")
    return cut.select("doc_id", F.when(p.isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def _runs(spark, sf_dir):
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    best = found.withColumn("best", longest_by_exponent(F.col("runs")))
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _variants(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = spelling_variants(word_counts(documents, drop_one_in=DROP_ONE_IN))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def _tokens(spark, sf_dir):
    encoded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return decode_documents(encoded).select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op11_periodic_runs": _runs,
    "op12_spelling_variants": _variants,
    "op13_bpe_round_trip": _tokens,
}


def _checksum_table() -> list[int]:
    """The byte table of CRC-32 with the reversed polynomial 0xEDB88320."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def _crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text of code points below U+0800."""
    code = "[ord(c)::BIGINT]"
    two = "[192 + (ord(c) >> 6), 128 + (ord(c) & 63)]::BIGINT[]"
    data = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN {code} ELSE {two} END))"
    step = f"xor(c >> 8, ({_checksum_table()}::BIGINT[])[xor(c & 255, b) + 1])"
    return f"xor(list_reduce({data}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295)"


ORACLES = {
    "op11_periodic_runs": rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         {_crc32_sql('doc_id::VARCHAR')} AS h
  FROM documents),
sized AS (
  SELECT *, len(words) AS n, h // 10 AS g, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM split),
cut AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized),
texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(words[1:a],
           flatten(list_transform(range((n - a + p - 1) // p), lambda k: words[a + 1:a + p]))[1:n - a]) ELSE words END
         AS words
  FROM cut),
placed AS MATERIALIZED (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM texts),
lags AS (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM texts),
marks AS (SELECT doc_id, q, unnest(range(0, n, q)) AS i FROM lags),
marked AS (SELECT m.doc_id, m.q, m.i, p.word FROM marks m JOIN placed p ON m.doc_id = p.doc_id AND m.i = p.i),
same AS (
  SELECT doc_id, q, word = lead(word, 1) OVER w AND word = lead(word, 2) OVER w AND word = lead(word, 3) OVER w AS hit
  FROM marked WINDOW w AS (PARTITION BY doc_id, q ORDER BY i)),
tried AS (SELECT DISTINCT doc_id, q FROM same WHERE hit),
equal AS (
  SELECT t.doc_id, t.q, a.i, a.i - row_number() OVER (PARTITION BY t.doc_id, t.q ORDER BY a.i) AS island
  FROM tried t JOIN placed a ON t.doc_id = a.doc_id
  JOIN placed b ON t.doc_id = b.doc_id AND b.i = a.i + t.q AND b.word = a.word),
stretches AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 1 + q AS length FROM equal GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q)
  GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
left_over AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id),
first_runs AS (
  SELECT * FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (
  SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)
         AS lines
  FROM runs GROUP BY doc_id)
SELECT t.doc_id, coalesce(l.n, 0)::BIGINT AS n_runs, f.start::BIGINT AS start, f.length::BIGINT AS length,
       f.period::BIGINT AS period, (1000 * f.length // f.period)::BIGINT AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(o.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed l ON t.doc_id = l.doc_id LEFT JOIN first_runs f ON t.doc_id = f.doc_id
LEFT JOIN left_over o ON t.doc_id = o.doc_id""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                     'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{{C0}}-\x{{FF}}]{{{LEAST_LETTERS},}}')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY doc_id, run),
summed AS (SELECT run, n, {_crc32_sql("doc_id || ':' || run")} AS h FROM counted),
changed AS (
  SELECT CASE WHEN h % {DROP_ONE_IN} = 0
              THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM summed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_LETTERS}
  GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
shorter AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
near AS (
  SELECT p.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS best, max(w.n) AS best_n
  FROM pairs p JOIN words w ON p.near = w.word GROUP BY p.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN best_n >= {FORM_TIMES} * w.n THEN best END AS form,
         CASE WHEN best_n >= {FORM_TIMES} * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
chains AS (
  SELECT word, word AS at, form AS onward FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON c.onward = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON f.word = c.word WHERE c.onward IS NULL""",
}
