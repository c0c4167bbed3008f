"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbral.llm.shared import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from timbral.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.where(~held_out())), ["doc_id"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score", "languages")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.telephony import media_round_trip

    return media_round_trip(table(spark, sf_dir, "documents")).drop("pcm")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.personal_data import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from timbral.llm.conversations import damaged_repair

    return damaged_repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Rates, distribution functions and uniform numbers of timbral.llm.mixing, for equal weights.
MIXING_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(SUM(COALESCE(strlen(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source
), total AS (
  SELECT CAST(SUM(size) AS BIGINT) AS all_size, CAST(COUNT(*) FILTER (WHERE size > 0) AS DOUBLE) AS all_weight FROM sizes
), rates AS (
  SELECT source, CAST(all_size AS DOUBLE) / (all_weight * size) AS rate FROM sizes, total WHERE size > 0
), means AS (
  SELECT source, CAST(CEIL(rate / 16.0) AS INTEGER) AS parts, rate / CEIL(rate / 16.0) AS mean FROM rates
), terms(source, mean, k, p, cdf) AS (
  SELECT source, mean, 0, EXP(-mean), EXP(-mean) FROM means
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM terms
  WHERE k < CAST(CEIL(mean + 12 * SQRT(mean) + 40) AS INTEGER)
), functions AS (
  SELECT source, LIST(cdf ORDER BY k) AS cdf FROM terms GROUP BY source
), draws AS (
  SELECT d.*, f.cdf, UNNEST(RANGE(1, m.parts + 1)) AS part
  FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source
  JOIN functions f ON d.source IS NOT DISTINCT FROM f.source
), drawn AS (
  SELECT *, CAST('0x' || substr(md5('mix|' || COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || part), 1, 12) AS BIGINT) / 281474976710656.0 AS u FROM draws
), counts AS (
  SELECT doc_id, text, lang, source, n_chars, CAST(SUM(len(list_filter(cdf, lambda p: p <= u))) AS INTEGER) AS n
  FROM drawn GROUP BY doc_id, text, lang, source, n_chars
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, UNNEST(RANGE(1, n + 1)) AS copy FROM counts WHERE n > 0
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       substr(md5('mix-order|' || COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || copy), 1, 16) AS shuffle_key
FROM copies
"""


#: Base32 of the SHA-1: 20 bits, five hexadecimal digits, are four letters.
WARC_SQL = """
WITH rows AS (
  SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS hex FROM pages WHERE page_id IS NOT NULL
), last AS (
  SELECT hex, MAX(page_id) AS keep FROM rows GROUP BY hex
), digests AS (
  SELECT hex, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS digest
  FROM last
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM rows JOIN last USING (hex) JOIN digests USING (hex)
"""


#: A CRC-32 bit by bit; a walk down each conversation that carries the cheapest (cost, audit, text) of the four states.
_FAR = 1_000_000_000


def _edit(state: str, cost: str, letter: str, line: str = "") -> str:
    text = f" || chr(10) || {line}" if line else ""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t{text}}}"


def _filled(source: str) -> str:
    """One more insertion in every state."""
    users = ", ".join(_edit(s, "5", "I", "'user:'") for s in ("s0", "s1", "s3"))
    return f"SELECT * REPLACE (list_min([s2, {users}]) AS s2, list_min([s3, {_edit('s2', '5', 'I', chr(39) + 'assistant:' + chr(39))}]) AS s3) FROM ({source})"


def _row_moves() -> str:
    spare = f"(CASE WHEN fault IN ('blank', 'duplicate') THEN {_FAR} WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
    keep = lambda s, initial: _edit(s, f"{spare} + CASE WHEN role[1] = '{initial}' THEN 0 ELSE {_FAR} END", "K", "role || ':' || text")
    give = lambda s, role: _edit(s, f"{spare} + 1", "R", f"'{role}:' || text")
    drop = lambda s: _edit(s, "2", "D")
    to_user = ", ".join(f(s) for s in ("s0", "s1", "s3") for f in (lambda s: keep(s, "u"), lambda s: give(s, "user")))
    return f"{drop('s0')} AS s0, list_min([{drop('s1')}, {keep('s0', 's')}]) AS s1, list_min([{drop('s2')}, {to_user}]) AS s2, list_min([{drop('s3')}, {keep('s2', 'a')}, {give('s2', 'assistant')}]) AS s3"


REPAIR_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS kind
  FROM given
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         UNNEST(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS n FROM damaged
), rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                 WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault,
         LAG(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair
  FROM numbered
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {{'c': CAST({_FAR} AS BIGINT), 'a': '', 't': ''}} AS s1,
         {{'c': CAST({_FAR} AS BIGINT), 'a': '', 't': ''}} AS s2, {{'c': CAST({_FAR} AS BIGINT), 'a': '', 't': ''}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, {_row_moves()}
  FROM ({_filled(_filled("SELECT r.conv_id, r.n, r.role, r.text, r.fault, w.s0, w.s1, w.s2, w.s3 FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1"))})
), ends AS (
  SELECT conv_id, list_min([s0, s3]) AS best
  FROM ({_filled(_filled("SELECT * FROM walk QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1"))})
), counts AS (
  SELECT conv_id, CAST(COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS BIGINT) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank,
         COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate, COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated,
         COUNT(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT e.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing_to_target_weights": MIXING_SQL, "op8_warc": WARC_SQL, "op13_conversation_repair": REPAIR_SQL}
