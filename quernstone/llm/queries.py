"""The registered queries of this folder, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import word_queries
from .html_extract import extract_text, train_on
from .imatch import edited_texts, lexicon
from .languages import held_out, identify, train
from .licenses import BASE_PHRASES, LOWER, MIN_WORDS, NOTICES, PLAIN_WORDS, RARE_WORDS, UPPER, scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_join import similar_documents
from .packing import pack_documents
from .passages import repeated_passages
from .quality import MAX_REMOVED_PERCENT, MIN_PERCENT, MIN_TEXTS, quality_rules


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fingerprints(spark, sf_dir):
    documents = _read(spark, sf_dir, "documents")
    return edited_texts(documents, lexicon(documents)).withColumnRenamed("id", "doc_id")


def _passages(spark, sf_dir):
    found = repeated_passages(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "kept_id", "line", F.col("start").alias("first_word"), (F.col("end") - F.col("start")).alias("n_words"))


def _main_text(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    # The page's address is taken along with its id.
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    texts = extract_text(keyed, train_on(pages), "page")
    return texts.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))


def _similar(spark, sf_dir):
    return similar_documents(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _languages(spark, sf_dir):
    documents = _read(spark, sf_dir, "documents")
    # Rows without id have no checksum and are not learned from.
    model = train(documents.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    found = identify(documents, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def _licenses(spark, sf_dir):
    found = scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def _pack(spark, sf_dir):
    packed = pack_documents(_read(spark, sf_dir, "documents"))
    return packed.withColumnRenamed("id", "doc_id")


def _mix(spark, sf_dir):
    mixed = mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _lines(spark, sf_dir):
    kept = dedup_lines(_read(spark, sf_dir, "documents"))
    return kept.select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def _quality(spark, sf_dir):
    judged = quality_rules(_read(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_removed", "base_failed", "kept",
    )


QUERIES = {
    "op1_imatch_fingerprints": _fingerprints,
    "op5_best_fit_packing": _pack,
    "op2_passage_dedup": _passages,
    "op3_html_extract": _main_text,
    "op4_ngram_jaccard_join": _similar,
    "op6_language_id": _languages,
    "op7_mix_sources": _mix,
    "op8_license_scan": _licenses,
    "op9_line_dedup": _lines,
    "op10_quality_rules": _quality,
    **word_queries.QUERIES,
}


def _listed(rows) -> str:
    """Rows of numbers and texts as SQL VALUES."""
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)


_NOTICE_ROWS = [
    (k, label, min(RARE_WORDS, len({*notice.split()} - PLAIN_WORDS))) for k, (label, notice, _) in enumerate(NOTICES)
]
_POSTING_ROWS = [
    (word, k, place)
    for k, (_, notice, _) in enumerate(NOTICES)
    for place, word in enumerate(notice.split())
    if word not in PLAIN_WORDS
]
_PHRASE_ROWS = [(k, f" {phrase} ") for k, (_, _, phrases) in enumerate(NOTICES) for phrase in phrases]
_BASE_ROWS = [(phrase, label, len(phrase.split())) for phrase, label in BASE_PHRASES.items()]

ORACLES = {
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
parts AS (
  SELECT doc_id, CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                      ELSE [array_to_string(words[i:i + 2], ' ') for i in range(1, len(words) - 1)] END AS parts
  FROM docs WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, unnest(parts) AS shingle FROM parts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * common.n >= 90 * (x.n + y.n - common.n)),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT r.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reached r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id""",
    "op7_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || doc_id::VARCHAR) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, source_size * 3 / weight AS lvl,
         (sum(source_size) OVER ()
            - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source ASC NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER ()
            - coalesce(sum(weight) OVER (ORDER BY source_size * 3 / weight, source ASC NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS open_level
  FROM sources),
chosen AS (SELECT arg_min(open_level, lvl) AS open_level FROM levels WHERE open_level <= lvl),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE
              ELSE least((source_size * 3)::DOUBLE,
                         coalesce(chosen.open_level * weight, (source_size * 3)::DOUBLE)) END AS target
  FROM levels, chosen),
running AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized),
whole AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS times
  FROM running r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN target - times * source_size > 0
                              AND 2 * before + size <= 2 * (target - times * source_size) THEN 1 ELSE 0 END))::BIGINT
         AS taken
FROM whole""",
    "op8_license_scan": rf"""
WITH notices(notice, label, most) AS (VALUES {_listed(_NOTICE_ROWS)}),
postings(word, notice, place) AS (VALUES {_listed(_POSTING_ROWS)}),
phrases(notice, phrase) AS (VALUES {_listed(_PHRASE_ROWS)}),
base_phrases(phrase, label, size) AS (VALUES {_listed(_BASE_ROWS)}),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
flat AS (SELECT doc_id, ' ' || coalesce(array_to_string(words, ' '), '') || ' ' AS flat FROM docs),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos, words FROM docs),
base AS (
  SELECT doc_id, pos, label FROM placed, base_phrases
  WHERE word = split_part(phrase, ' ', 1) AND array_to_string(words[pos + 1:pos + size], ' ') = phrase),
based AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM base GROUP BY doc_id),
ranks AS (
  SELECT word, row_number() OVER (ORDER BY n, word) AS place
  FROM (SELECT l.word, count(DISTINCT p.doc_id) AS n
        FROM (SELECT DISTINCT word FROM postings) l LEFT JOIN placed p ON l.word = p.word GROUP BY l.word)),
rare AS (
  SELECT doc_id, word FROM (SELECT DISTINCT p.doc_id, p.word, r.place FROM placed p JOIN ranks r ON p.word = r.word)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) <= {RARE_WORDS}),
met AS (
  SELECT p.doc_id, t.notice, p.pos - t.place AS at, count(DISTINCT p.word) AS n
  FROM placed p JOIN rare r ON p.doc_id = r.doc_id AND p.word = r.word JOIN postings t ON p.word = t.word
  GROUP BY p.doc_id, t.notice, p.pos - t.place),
matched AS (
  SELECT m.doc_id, n.label, least(1.0, m.n / n.most)::DOUBLE AS share
  FROM met m JOIN notices n ON m.notice = n.notice JOIN flat f ON m.doc_id = f.doc_id
  WHERE m.n >= least({MIN_WORDS}, n.most)
    AND NOT EXISTS (SELECT 1 FROM phrases p WHERE p.notice = m.notice AND NOT contains(f.flat, p.phrase))),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM matched GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base,
       b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(
         list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(f.share, 0.0::DOUBLE) END AS score
FROM docs d LEFT JOIN based b ON d.doc_id = b.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id""",
    "op9_line_dedup": r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM parts),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM cut),
gone AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(gone.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (gone.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone ON keyed.key = gone.key
GROUP BY doc_id""",
    "op10_quality_rules": rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base WHERE len(words) >= 3)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n
  FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
texts AS (SELECT DISTINCT source, text FROM base),
host_sizes AS (SELECT source, count(*) AS texts FROM texts GROUP BY source),
flat AS (
  SELECT source, text, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM texts)),
found AS (
  SELECT source, line, count(DISTINCT text) AS found FROM flat WHERE line <> '' GROUP BY source, line
  HAVING count(DISTINCT text) >= {MIN_TEXTS}),
common AS (
  SELECT f.source, f.line FROM found f JOIN host_sizes h ON f.source IS NOT DISTINCT FROM h.source
  WHERE f.found * 100 >= h.texts * {MIN_PERCENT}),
removed AS (
  SELECT l.source, l.text, sum(length(l.line) - length(replace(l.line, ' ', '')) + 1)::BIGINT AS n
  FROM flat l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line
  GROUP BY l.source, l.text),
measured AS (
  SELECT b.doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars,
         (length(b.text) - length(regexp_replace(b.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(r.n, 0)::BIGINT AS n_removed
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
  LEFT JOIN removed r ON b.source IS NOT DISTINCT FROM r.source AND b.text = r.text)
SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT 100 * n_removed > {MAX_REMOVED_PERCENT} * n_words AS kept
FROM measured""",
    **word_queries.ORACLES,
}
