"""Queries over whole texts, put together from the quotes of each output, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.operators import quotes as Q
from quotelens.options import ProcessorOptions
from quotelens.plans import match_queries as M
from quotelens.plans import sqltext as S
from quotelens.plans.runtime import table
from quotelens.streaming.validate import stream_validate

# How a quote of each detection method is written into its output's text, by tag format.
_OPEN = {"xml": ('<quran ref="', '">', "</quran> "), "markdown": ('```quran ref="', '"\n', "\n``` "), "bracket": ("[[Q:", "|", "]] ")}


def documents_of(spark: SparkSession, d: str, fmt: str = "xml") -> DataFrame:
    """(doc_id, text): each output's quotes in order, tagged, announced or bare by their
    detection method."""
    q = table(spark, d, "quotes").select("output_id", "quote_id", "original", "reference", "detection_method").where(F.col("original").isNotNull()).repartition("output_id").distinct()
    ref = F.coalesce("reference", F.lit("1:1"))
    a, b, c = (F.lit(x) for x in _OPEN[fmt])
    piece = (
        F.when(F.col("detection_method") == "tagged", F.concat(a, ref, b, "original", c))
        .when(F.col("detection_method") == "contextual", F.concat(F.lit("Allah says: "), "original", F.lit(" and so on. ")))
        .otherwise(F.concat(F.lit("text "), "original", F.lit(" ("), ref, F.lit(") end. ")))
    )
    pieces = F.array_sort(F.collect_list(F.struct("quote_id", piece.alias("t"))))
    return q.groupBy(F.col("output_id").alias("doc_id")).agg(F.array_join(F.transform(pieces, lambda x: x["t"]), "").alias("text"))


def _spans(fmt: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return Q.all_spans(documents_of(spark, d, fmt), fmt)

    query.__doc__ = f"Tagged ({fmt}) and inline quotes of every output."
    return query


def detect_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every Arabic segment of every output with its verdict."""
    found = Q.detect(documents_of(spark, d), M.corpus_of(spark, d))
    return found.select("doc_id", "text", "start", "end", "is_valid", "match_type", F.round("confidence", 9).alias("confidence"), "reference")


def detected_flag(spark: SparkSession, d: str) -> DataFrame:
    return Q.detected(documents_of(spark, d), M.corpus_of(spark, d))


def validate_quote(spark: SparkSession, d: str) -> DataFrame:
    """Every quote against the reference it was given."""
    q = table(spark, d, "quotes").select("quote_id", F.col("original").alias("text"), F.col("reference").alias("expected_ref")).where(F.col("text").isNotNull())
    return Q.validate_quotes(q, M.corpus_of(spark, d), distinct=True).select("quote_id", "is_valid", "correct_text", "actual_ref")


def _processed(spark: SparkSession, d: str, fmt: str = "xml", **opts: bool) -> DataFrame:
    return Q.process(documents_of(spark, d, fmt), M.corpus_of(spark, d), ProcessorOptions(tag_format=fmt, **opts))


def process_output(spark: SparkSession, d: str) -> DataFrame:
    """Corrected text of every output, whether all quotes were right, and warnings."""
    p = _processed(spark, d)
    return p.select("doc_id", "corrected_text", "all_valid", F.size("quotes").alias("n_quotes"), F.array_join("warnings", "\n").alias("warnings"))


def process_bracket(spark: SparkSession, d: str) -> DataFrame:
    p = _processed(spark, d, "bracket")
    return p.select("doc_id", "corrected_text", "all_valid", F.size("quotes").alias("n_quotes"))


def _by_method(method: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _processed(spark, d).select("doc_id", F.explode("quotes").alias("q")).where(F.col("q.detection_method") == method)
        return rows.select("doc_id", *[F.col(f"q.{c}").alias(c) for c in ("original", "corrected", "is_valid", "reference", "start_index", "end_index", "was_corrected")], F.round("q.confidence", 9).alias("confidence"))

    query.__doc__ = f"Accepted quotes found as {method}."
    return query


def range_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Tagged quotes that name a range of verses, compared with the whole range."""
    rows = Q.range_quotes(documents_of(spark, d), M.corpus_of(spark, d))
    return rows.withColumn("confidence", F.round("confidence", 9))


def quick_validate_issues(spark: SparkSession, d: str) -> DataFrame:
    q = Q.quick_validate(documents_of(spark, d), M.corpus_of(spark, d))
    return q.select("doc_id", "has_quran_content", "all_valid", F.array_join("issues", "\n").alias("issues"))


def stream_static_validate(spark: SparkSession, d: str) -> DataFrame:
    """All quotes through the cascade as a stream, batch by batch."""
    return stream_validate(spark, f"{d}/quotes.parquet", M.corpus_of(spark, d))


QUERIES = {
    "tagged_xml": _spans("xml"), "tagged_markdown": _spans("markdown"), "tagged_bracket": _spans("bracket"), "detect_documents": detect_documents,
    "detected_flag": detected_flag, "validate_quote": validate_quote, "process_output": process_output, "process_bracket": process_bracket,
    "contextual_quotes": _by_method("contextual"), "untagged_quotes": _by_method("fuzzy"), "range_quotes": range_quotes,
    "quick_validate_issues": quick_validate_issues, "stream_static_validate": stream_static_validate,
}


def _docs(fmt: str) -> str:
    a, b, c = (x.replace("\n", "' || chr(10) || '") for x in _OPEN[fmt])
    return f"""docs AS (
  SELECT output_id AS doc_id, string_agg(CASE detection_method WHEN 'tagged' THEN '{a}' || ref || '{b}' || original || '{c}'
    WHEN 'contextual' THEN 'Allah says: ' || original || ' and so on. ' ELSE 'text ' || original || ' (' || ref || ') end. ' END, '' ORDER BY quote_id) AS text
  FROM (SELECT DISTINCT output_id, quote_id, original, coalesce(reference, '1:1') AS ref, detection_method FROM quotes WHERE original IS NOT NULL) GROUP BY 1)"""


_REF = r"\p{Nd}+:\p{Nd}+(?:-\p{Nd}+)?"
# The tag formats, for RE2.
_TAG = {
    "xml": rf"""(?is)<quran[{S.WS_RE2}]+ref=["'']({_REF})["'']>(.*?)</quran>""",
    "markdown": rf"""(?is)```quran[{S.WS_RE2}]+ref=["'']({_REF})["''][\r\n]+(.*?)[\r\n]+```""",
    "bracket": rf"(?s)\[\[Q:({_REF})\|(.*?)\]\]",
}
_INLINE = rf"([{S.A_RE2}{S.WS_RE2}]+)\(({_REF})\)"


def _found(name: str, pattern: str, ref: int, body: int) -> str:
    return f"""{name} AS (
  SELECT doc_id, i, r[i] AS ref, {S.strip('b[i]')} AS text, s AS start, s + length(w[i]) AS "end", w[i] AS whole FROM (
    SELECT *, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN w[1:i - 1]]), 0) AS INT) AS s FROM (
      SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w, g, r, b FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') AS w, string_split_regex(text, '{pattern}') AS g,
          regexp_extract_all(text, '{pattern}', {ref}) AS r, regexp_extract_all(text, '{pattern}', {body}) AS b FROM docs))))"""


def _span_sql(fmt: str) -> str:
    return f"""WITH {_docs(fmt)}, {_found('tags', _TAG[fmt], 1, 2)}, {_found('inl', _INLINE, 2, 1)}
SELECT doc_id, 'tag' AS how, ref, text, start, "end" FROM tags
UNION ALL SELECT doc_id, 'inline', ref, text, start, "end" FROM inl WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.doc_id = inl.doc_id AND inl.start >= t.start AND inl.start < t."end")"""


_SEGMENTS = f"""seg AS (
  SELECT doc_id, {S.strip('h[i]')} AS text, s AS start, s + length(h[i]) AS "end" FROM (
    SELECT *, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i - 1]]), 0) AS INT) AS s FROM (
      SELECT doc_id, h, g, unnest(range(1, len(h) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '[{S.A_RE2}][{S.A_RE2}{S.WS_RE2}]*') AS h, string_split_regex(text, '[{S.A_RE2}][{S.A_RE2}{S.WS_RE2}]*') AS g FROM docs)))
  WHERE length({S.strip('h[i]')}) >= 10)"""

_DETECT = f"""WITH {_docs('xml')}, {_SEGMENTS}, {S.CORPUS}, asked AS (SELECT DISTINCT text AS quote_id, text AS original, text AS q FROM seg), {M._STAGES}, {M._cascade(True)}"""

# The announcements, in the order in which they are looked for, for RE2.
_W = f"[{S.WS_RE2}]"
_TRIGGERS = (
    rf"(?i)(?:Allah{_W}+says?|God{_W}+says?|the{_W}+Quran{_W}+says?|in{_W}+the{_W}+Quran|Quranic{_W}+verse|verse{_W}+states?|ayah|ayat|surah){_W}*[:\-]?{_W}*",
    rf"(?:قال{_W}+الله|قال{_W}+تعالى|يقول{_W}+الله|في{_W}+القرآن|الآية|سورة){_W}*[:\-]?{_W}*",
    r"\(?\p{Nd}{1,3}:\p{Nd}{1,3}(?:-\p{Nd}{1,3})?\)?",
    r"\[[\p{L}\p{N}_\-]+:\p{Nd}+(?:-\p{Nd}+)?\]",
)


def _announced(k: int, pattern: str) -> str:
    return f"""SELECT doc_id, {k} AS k, i, e AS start, regexp_extract(substr(text, e + 1), '^[{S.A_RE2}{S.WS_RE2}]*') AS run FROM (
    SELECT doc_id, i, text, CAST(list_sum([length(x) FOR x IN g[1:i]]) + list_sum([length(x) FOR x IN w[1:i]]) AS INT) AS e FROM (
      SELECT doc_id, text, w, g, unnest(range(1, len(w) + 1)) AS i FROM (
        SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS w, string_split_regex(text, '{pattern}') AS g FROM docs)))"""


_HIT = """(x.start >= r.start AND x.start < r."end" OR x."end" > r.start AND x."end" <= r."end")"""
_SHAPE = "'^([0-9]+):([0-9]+)-([0-9]+)\\n?$'"


def _processed_sql(fmt: str) -> str:
    """kept: every accepted quote of every output, in order of (doc_id, stage, n)."""
    a, b, c = ("'" + x.rstrip(" ").replace("\n", "' || chr(10) || '") + "'" for x in _OPEN[fmt])
    part = lambda g: f"try_cast(regexp_extract(plain, {_SHAPE}, {g}) AS BIGINT)"
    return f"""WITH RECURSIVE {_docs(fmt)}, {_found('tags', _TAG[fmt], 1, 2)}, {_found('inl', _INLINE, 2, 1)},
tagged AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g, i) AS n FROM (
    SELECT *, 0 AS g FROM tags UNION ALL SELECT *, 1 FROM inl x WHERE NOT EXISTS (SELECT 1 FROM tags r WHERE r.doc_id = x.doc_id AND x.start >= r.start AND x.start < r."end"))),
announced AS ({" UNION ALL ".join(_announced(k, t) for k, t in enumerate(_TRIGGERS))}),
contextual AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS n, {S.strip('run')} AS text, start, "end" FROM (SELECT *, start + length(run) AS "end" FROM announced) x
  WHERE length({S.strip('run')}) >= 10 AND NOT EXISTS (SELECT 1 FROM tagged r WHERE r.doc_id = x.doc_id AND {_HIT})),
{_SEGMENTS},
spans AS (
  SELECT doc_id, 0 AS stage, n, ref, text, start, "end", whole FROM tagged
  UNION ALL SELECT doc_id, 1, n, NULL, text, start, "end", NULL FROM contextual
  UNION ALL SELECT doc_id, 2, row_number() OVER (PARTITION BY doc_id ORDER BY start), NULL, text, start, "end", NULL FROM seg WHERE length(text) >= 15),
{S.CORPUS}, asked AS (SELECT DISTINCT text AS quote_id, text AS original, text AS q FROM spans), {M._STAGES}, {M._cascade(True)},
parsed AS (SELECT *, {part(1)} AS s, {part(2)} AS a, {part(3)} AS b, {S.norm('text')} AS norm_text FROM (SELECT *, {S.plain_digits("coalesce(ref, '')")} AS plain FROM spans)),
places AS (SELECT surah, ayah, arg_min(text, ord) AS text FROM corpus GROUP BY 1, 2),
ranges AS (
  SELECT s, a, b, string_agg(v.text, ' ' ORDER BY v.ayah) AS range_text FROM (SELECT DISTINCT s, a, b FROM parsed WHERE b <> 0) p JOIN places v ON v.surah = p.s AND v.ayah BETWEEN p.a AND p.b
  GROUP BY ALL HAVING count(*) = b - a + 1),
normed AS (SELECT *, {S.norm('range_text')} AS norm_range FROM ranges),
ranged AS (
  SELECT p.* EXCLUDE (s, a, b), range_text, CASE WHEN range_text IS NULL THEN 0.0::DOUBLE WHEN p.text = range_text THEN 1.0::DOUBLE WHEN norm_text = norm_range THEN 0.95::DOUBLE
    ELSE {S.similarity('norm_text', 'norm_range')} END AS sim, coalesce(norm_text = norm_range, false) AS same
  FROM parsed p LEFT JOIN normed USING (s, a, b) WHERE p.b <> 0),
analyzed AS (
  SELECT doc_id, stage, n, p.text AS original, kind IS NOT NULL AND coalesce(ref = concat(surah, ':', ayah), true) AS is_valid,
    CASE WHEN kind IS NOT NULL AND kind <> 'exact' THEN verse_text ELSE p.text END AS corrected, CASE WHEN kind IS NOT NULL THEN concat(surah, ':', ayah) ELSE ref END AS reference,
    coalesce(confidence, 0.0::DOUBLE) AS confidence, kind IS NOT NULL AND kind <> 'exact' AS was_corrected, start, "end", whole
  FROM parsed p JOIN verdict ON quote_id = p.text WHERE coalesce(p.b, 0) = 0
  UNION ALL
  SELECT doc_id, stage, n, text, good, CASE WHEN good AND text <> range_text THEN range_text ELSE text END, ref, sim, coalesce(good AND text <> range_text, false), start, "end", whole
  FROM (SELECT *, range_text IS NOT NULL AND (text = range_text OR same OR sim >= 0.85::DOUBLE) AS good FROM ranged)),
early AS (SELECT * FROM analyzed WHERE stage = 0 OR stage = 1 AND (is_valid OR confidence >= 0.85::DOUBLE)),
kept AS (
  SELECT * FROM early
  UNION ALL SELECT * FROM analyzed x WHERE stage = 2 AND confidence >= 0.85::DOUBLE AND NOT EXISTS (SELECT 1 FROM early r WHERE r.doc_id = x.doc_id AND {_HIT})),
noted AS (
  SELECT *, CASE WHEN stage = 2 THEN concat('Potential untagged Quran quote detected: "', substr(original, 1, 50), '..." (possibly ', coalesce(reference, 'None'), ', ', round_even(confidence * 100, 0)::BIGINT, '% confidence)') END AS warning,
    CASE WHEN NOT is_valid OR was_corrected THEN concat('Quote "', substr(original, 1, 30), '..." is ', CASE WHEN is_valid THEN 'imprecise' ELSE 'invalid' END,
      CASE WHEN coalesce(reference, '') <> '' THEN concat(' (should be ', reference, ')') ELSE '' END) END AS issue
  FROM kept),
summed AS (
  SELECT doc_id, count(*) AS n_quotes, bool_and(is_valid AND NOT was_corrected) AS all_valid, list(warning ORDER BY stage, n) FILTER (warning IS NOT NULL) AS warnings,
    list(issue ORDER BY stage, n) FILTER (issue IS NOT NULL) AS issues FROM noted GROUP BY 1),
fix AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stage, n) AS k, coalesce(whole, original) AS old,
    CASE WHEN stage = 0 THEN {a} || coalesce(reference, 'None') || {b} || corrected || {c} ELSE corrected END AS new FROM kept WHERE was_corrected),
fold AS (
  SELECT doc_id, 0::BIGINT AS k, text FROM docs
  UNION ALL
  SELECT f.doc_id, x.k, CASE WHEN strpos(f.text, x.old) > 0 THEN concat(substr(f.text, 1, strpos(f.text, x.old) - 1), x.new, substr(f.text, strpos(f.text, x.old) + length(x.old))) ELSE f.text END
  FROM fold f JOIN fix x ON x.doc_id = f.doc_id AND x.k = f.k + 1),
corrected AS (SELECT doc_id, arg_max(text, k) AS corrected_text FROM fold GROUP BY 1)
"""


def _method_sql(stage: int, more: str = "") -> str:
    return f"""{_processed_sql('xml')} SELECT doc_id, original, corrected, is_valid, reference, start AS start_index, "end" AS end_index, was_corrected, round(confidence, 9) AS confidence
FROM kept WHERE stage = {stage} {more}"""


SQL = {f"tagged_{fmt}": _span_sql(fmt) for fmt in _TAG} | {
    "detect_documents": f"""{_DETECT} SELECT doc_id, seg.text, start, "end", kind IS NOT NULL AS is_valid, coalesce(kind, 'none') AS match_type, round(coalesce(confidence, 0.0::DOUBLE), 9) AS confidence,
  CASE WHEN verse_id IS NOT NULL THEN concat(surah, ':', ayah) END AS reference FROM seg JOIN verdict ON quote_id = seg.text""",
    "detected_flag": f"""{_DETECT}, f AS (SELECT doc_id, count(*) AS n_segments, bool_or(kind IS NOT NULL) AS detected FROM seg JOIN verdict ON quote_id = seg.text GROUP BY 1)
SELECT docs.doc_id, coalesce(n_segments, 0) AS n_segments, coalesce(detected, false) AS detected FROM docs LEFT JOIN f USING (doc_id)""",
    "validate_quote": f"""{M._Q}, {M._STAGES}, {M._cascade(True)}, given AS (SELECT DISTINCT quote_id, coalesce(reference, '') AS expected FROM quotes),
v AS (SELECT *, concat(surah, ':', ayah) AS actual, kind IS NOT NULL AND expected <> '' AND expected <> concat(surah, ':', ayah) AS wrong FROM verdict JOIN given USING (quote_id))
SELECT quote_id, kind IS NOT NULL AND NOT wrong AS is_valid, CASE WHEN kind IS NOT NULL AND (wrong OR kind <> 'exact') THEN verse_text END AS correct_text,
  CASE WHEN kind IS NOT NULL THEN actual END AS actual_ref FROM v""",
    "process_output": f"""{_processed_sql('xml')} SELECT doc_id, corrected_text, coalesce(all_valid, true) AS all_valid, coalesce(n_quotes, 0) AS n_quotes, coalesce(array_to_string(warnings, chr(10)), '') AS warnings
FROM corrected LEFT JOIN summed USING (doc_id)""",
    "process_bracket": f"""{_processed_sql('bracket')} SELECT doc_id, corrected_text, coalesce(all_valid, true) AS all_valid, coalesce(n_quotes, 0) AS n_quotes FROM corrected LEFT JOIN summed USING (doc_id)""",
    "contextual_quotes": _method_sql(1),
    "untagged_quotes": _method_sql(2),
    "range_quotes": _method_sql(0, "AND contains(reference, '-')"),
    "quick_validate_issues": f"""{_processed_sql('xml')} SELECT doc_id, coalesce(n_quotes, 0) > 0 AS has_quran_content, coalesce(all_valid, true) AS all_valid,
  array_to_string(list_concat(coalesce(issues, []), coalesce(warnings, [])), chr(10)) AS issues FROM docs LEFT JOIN summed USING (doc_id)""",
    "stream_static_validate": f"""{M._Q}, {M._STAGES}, {M._cascade(True)} SELECT DISTINCT quote_id, kind IS NOT NULL AS is_valid, coalesce(kind, 'none') AS match_type, round(coalesce(confidence, 0.0::DOUBLE), 9) AS confidence, verse_id,
  CASE WHEN verse_id IS NOT NULL THEN concat(surah, ':', ayah) END AS reference FROM verdict""",
}
