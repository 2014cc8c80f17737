"""Queries of problem 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.chars import BLANKS, COLONS, DASHES, OTHER_DIGITS, PLAIN_DIGITS
from quotelens.operators import orphans
from quotelens.operators.skew import union_all
from quotelens.plans.runtime import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of quotes and parsed_references with month and kind."""
    quotes, parsed = table(spark, d, "quotes"), table(spark, d, "parsed_references")
    refs = union_all([orphans.quote_references(quotes), orphans.parsed_references(parsed)])
    return orphans.orphan_references(refs, table(spark, d, "quran_surahs"), table(spark, d, "quran_verses"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted per table, month and kind."""
    return p4_found(spark, d).groupBy("table_name", "month_key", "orphan_kind").agg(F.count("*").alias("n_orphans"))


def p4_parsed_quote_orphans(spark: SparkSession, d: str) -> DataFrame:
    """parsed_references whose quote_id names no quote, by match semantics 'simple'."""
    parsed = table(spark, d, "parsed_references").select("ref_id", "quote_id").distinct()
    return orphans.find_orphans(parsed, table(spark, d, "quotes"), ["quote_id"]).select("ref_id", "quote_id")


def p4_partial_keys(spark: SparkSession, d: str) -> DataFrame:
    """(surah, ayah) keys, either possibly null, found nowhere, by semantics 'partial'."""
    parsed = table(spark, d, "parsed_references").select("ref_id", "surah", F.col("start_ayah").alias("ayah")).distinct()
    return orphans.find_orphans(parsed, table(spark, d, "quran_verses"), ["surah", "ayah"], "partial")


_FROM = DASHES + COLONS + OTHER_DIGITS
_TO = "-" * len(DASHES) + ":" * len(COLONS) + PLAIN_DIGITS

_FOUND = rf"""
WITH plain AS (
  SELECT DISTINCT quote_id, found_at,
    translate(regexp_replace(reference, '[\p{{Cf}}\p{{Cc}}\p{{Z}}\x{{034F}}\x{{FE00}}-\x{{FE0F}}]', '', 'g'), '{_FROM}{BLANKS[5:]}', '{_TO}') AS r
  FROM quotes),
refs AS (
  SELECT 'quotes' AS table_name, quote_id AS rec_id, found_at AS moment,
    try_cast(regexp_extract(r, '^([0-9]+):([0-9]+)(-([0-9]+))?$', 1) AS BIGINT) AS s,
    try_cast(regexp_extract(r, '^([0-9]+):([0-9]+)(-([0-9]+))?$', 2) AS BIGINT) AS a,
    try_cast(nullif(regexp_extract(r, '^([0-9]+):([0-9]+)(-([0-9]+))?$', 4), '') AS BIGINT) AS b
  FROM plain WHERE regexp_matches(r, '^([0-9]+):([0-9]+)(-([0-9]+))?$')
  UNION ALL
  SELECT DISTINCT 'parsed_references', ref_id, parsed_at, surah::BIGINT, start_ayah::BIGINT, end_ayah::BIGINT FROM parsed_references),
kept AS (SELECT *, coalesce(b, a) AS z FROM refs WHERE s IS NOT NULL AND a IS NOT NULL AND coalesce(b >= a, true)),
sur AS (SELECT number AS s, max(verses_count) AS n FROM quran_surahs GROUP BY 1),
ver AS (SELECT surah AS s, ayah, min(removed_at) AS gone, min(loaded_at) AS came FROM quran_verses GROUP BY 1, 2),
seen AS (
  SELECT k.table_name, k.rec_id, k.moment, k.s, k.a, k.z, any_value(sur.n) AS n, count(ver.ayah) AS have, min(ver.gone) AS gone, max(ver.came) AS came
  FROM kept k LEFT JOIN sur ON sur.s = k.s LEFT JOIN ver ON ver.s = k.s AND ver.ayah BETWEEN k.a AND k.z
  GROUP BY ALL),
judged AS (
  SELECT table_name, rec_id, strftime(moment AT TIME ZONE 'UTC', '%Y-%m') AS month_key,
    CASE WHEN n IS NULL THEN 'no_surah' WHEN a < 1 OR z > n THEN 'beyond' WHEN have < z - a + 1 THEN 'no_verse'
         WHEN gone <= moment THEN 'removed' WHEN came > moment THEN 'late' END AS orphan_kind
  FROM seen)
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_report, p4_parsed_quote_orphans, p4_partial_keys)}

SQL = {
    "p4_found": _FOUND + "SELECT * FROM judged WHERE orphan_kind IS NOT NULL",
    "p4_report": _FOUND + "SELECT table_name, month_key, orphan_kind, count(*) AS n_orphans FROM judged WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3",
    "p4_parsed_quote_orphans": "SELECT DISTINCT ref_id, quote_id FROM parsed_references p WHERE quote_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM quotes q WHERE q.quote_id = p.quote_id)",
    "p4_partial_keys": """
SELECT DISTINCT ref_id, surah, start_ayah AS ayah, (surah IS NULL)::INT::VARCHAR || (start_ayah IS NULL)::INT::VARCHAR AS null_mask
FROM parsed_references p WHERE (surah IS NOT NULL OR start_ayah IS NOT NULL) AND NOT EXISTS (
  SELECT 1 FROM quran_verses v WHERE (p.surah IS NULL OR v.surah = p.surah) AND (p.start_ayah IS NULL OR v.ayah = p.start_ayah))""",
}
