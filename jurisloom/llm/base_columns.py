"""The columns of the operators' queries that SQL can state, each with its SQL.

They come from the queries themselves, over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_id, licenses, lm_scoring, token_counts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: crc32 of an id written as text: bit by bit, byte by byte.
_ROUND = "list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
CRC_SQL = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {_ROUND}), 4294967295)"


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and base phrases of all documents, from the license scan."""
    return licenses.op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM d),
l AS (SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
h AS (SELECT doc_id, p, CASE WHEN a = 'gnu' AND b = 'general' AND c = 'public' AND e = 'license' THEN 'gpl' WHEN a = 'apache' AND b = 'license' THEN 'apache' WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'mit' AND b = 'license' THEN 'mit' END AS x FROM l),
g AS (SELECT doc_id, count(*) AS n, min(p) - 1 AS f, max(p) - 1 AS t, string_agg(DISTINCT x, ',' ORDER BY x) AS s FROM h WHERE x IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, t::BIGINT AS last_word, coalesce(s, '') AS base_labels FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and edited texts of all documents, from the fingerprints' query."""
    return fingerprints.op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, length(t) // 3 AS cut, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS f FROM d)
SELECT doc_id, n::BIGINT AS n_chars, sha256(substr(t, 1, n - cut) || substr(f, 1, cut)) AS edited_sha256 FROM n
"""


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, known ones and the word model's score of all documents, from the scoring query."""
    rows = lm_scoring.op6_lm_scoring(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LM_SQL = rf"""
WITH d AS (SELECT doc_id, {CRC_SQL} % 5 = 1 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), '') AS w FROM documents),
u AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM u WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM u LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
"""


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents, from the token counts' query."""
    return token_counts.op10_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


BYTES_SQL = "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents"


def language_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out documents, and those without a letter, from the language query."""
    rows = language_id.op7_language_id(spark, sf_dir)
    return rows.select("doc_id", "held_out", (F.col("lang_pred") == language_id.UNDETERMINED).alias("undetermined"))


SPLITS_SQL = rf"SELECT doc_id, {CRC_SQL} % 5 = 0 AS held_out, NOT regexp_matches(coalesce(text, ''), '\p{{L}}') AS undetermined FROM documents"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in (license_places, edited_texts, lm_base_scores, text_bytes, language_splits)}


def oracle_sql() -> dict[str, str]:
    return {"license_places": LICENSE_SQL, "edited_texts": EDITED_SQL, "lm_base_scores": LM_SQL, "text_bytes": BYTES_SQL, "language_splits": SPLITS_SQL}
