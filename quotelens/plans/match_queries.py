"""Queries of the matching operators, scalar kernels and look-ups, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.functions import text as T
from quotelens.operators import lookup, match
from quotelens.options import INDEX_OPTIONS, NormalizationOptions, ValidatorOptions
from quotelens.plans import sqltext as S
from quotelens.plans.runtime import materialize, table
from quotelens.sources import corpus as C


def corpus_of(spark: SparkSession, d: str) -> DataFrame:
    return C.prepared(C.verse_table(table(spark, d, "quran_verses")))


def quotes_of(spark: SparkSession, d: str) -> DataFrame:
    """(quote_id, text) of every distinct quote with a text."""
    return _all_quotes(spark, d).distinct()


def _all_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotes").select("quote_id", F.col("original").alias("text"))
    return q.where(F.col("text").isNotNull())


# --- scalar kernels


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return quotes_of(spark, d).select("quote_id", T.normalize_arabic(F.col("text")).alias("norm"))


_VARIANTS = {
    "marks_kept": NormalizationOptions(remove_diacritics=False),
    "letters_kept": NormalizationOptions(normalize_alef=False, normalize_alef_maqsura=False, normalize_teh_marbuta=False, normalize_hamza=False),
    "tatweel_kept": NormalizationOptions(remove_tatweel=False),
    "blanks_kept": NormalizationOptions(normalize_whitespace=False),
    "index_form": INDEX_OPTIONS,
}


def normalize_options(spark: SparkSession, d: str) -> DataFrame:
    return quotes_of(spark, d).select("quote_id", *[T.normalize_arabic(F.col("text"), o).alias(n) for n, o in _VARIANTS.items()])


def remove_diacritics(spark: SparkSession, d: str) -> DataFrame:
    return quotes_of(spark, d).select("quote_id", T.remove_diacritics(F.col("text")).alias("bare"))


def contains_arabic(spark: SparkSession, d: str) -> DataFrame:
    return quotes_of(spark, d).select("quote_id", T.contains_arabic(F.col("text")).alias("arabic"))


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    q = quotes_of(spark, d)
    return q.select("quote_id", T.clean_text(F.col("text")).alias("cleaned"), T.strip_arabic_digits(F.col("text")).alias("digitless"), T.strip(F.col("text")).alias("stripped"))


def extract_segments(spark: SparkSession, d: str) -> DataFrame:
    """Arabic segments of every quote and its surroundings."""
    framed = quotes_of(spark, d).select("quote_id", F.concat(F.lit("It is said: "), F.col("text"), F.lit(" (sic), "), F.col("text"), F.lit("\n")).alias("t"))
    return framed.select("quote_id", F.explode(T.arabic_segments(F.col("t"))).alias("s")).select("quote_id", "s.text", "s.start", "s.end")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "quotes").select("quote_id", "original", "corrected").distinct()
    return p.where(F.col("original").isNotNull() & F.col("corrected").isNotNull())


def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance and similarity of every quote and its correction, normalized."""
    n = _pairs(spark, d).select("quote_id", T.normalize_arabic(F.col("original")).alias("a"), T.normalize_arabic(F.col("corrected")).alias("b"))
    return n.select("quote_id", F.levenshtein("a", "b").alias("distance"), F.round(T.similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


def find_differences(spark: SparkSession, d: str) -> DataFrame:
    """Differing runs of every quote and its correction."""
    return _pairs(spark, d).select("quote_id", F.explode(T.find_differences(F.col("original"), F.col("corrected"))).alias("d")).select("quote_id", "d.position", "d.input", "d.correct")


def parse_reference(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quotes").select("quote_id", "reference").distinct().where(F.col("reference").isNotNull())
    r = T.parse_reference(F.col("reference"))
    return q.select("quote_id", r.alias("r")).where(F.col("r").isNotNull()).select("quote_id", "r.surah", "r.start_ayah", "r.end_ayah", "r.is_range")


# --- corpus and look-ups


def normalized_index(spark: SparkSession, d: str) -> DataFrame:
    return C.normalized_index(C.verse_table(table(spark, d, "quran_verses"))).select("norm", F.array_join("ids", ",").alias("ids"))


def get_verse(spark: SparkSession, d: str) -> DataFrame:
    """The verse that each parsed reference begins with."""
    p = table(spark, d, "parsed_references").select("ref_id", "surah", F.col("start_ayah").alias("ayah")).distinct()
    return lookup.get_verses(p, corpus_of(spark, d)).select("ref_id", "surah", "ayah", F.col("id").alias("verse_id"), "text")


def verse_range(spark: SparkSession, d: str) -> DataFrame:
    """Joined texts of every range that parsed references name in full."""
    p = table(spark, d, "parsed_references").select("surah", "start_ayah", F.coalesce("end_ayah", "start_ayah").alias("end_ayah"))
    return lookup.verse_ranges(p, corpus_of(spark, d)).withColumn("verse_ids", F.array_join("verse_ids", ","))


def range_missing(spark: SparkSession, d: str) -> DataFrame:
    """Ranges that are reversed or miss a verse."""
    p = table(spark, d, "parsed_references").select("surah", "start_ayah", F.coalesce("end_ayah", "start_ayah").alias("end_ayah")).distinct().dropna()
    return p.join(lookup.verse_ranges(p, corpus_of(spark, d)), ["surah", "start_ayah", "end_ayah"], "left_anti")


def surah_verses(spark: SparkSession, d: str) -> DataFrame:
    return lookup.surah_verses(corpus_of(spark, d), 7).select("id", "surah", "ayah", "text")


def get_surah(spark: SparkSession, d: str) -> DataFrame:
    return lookup.get_surah(table(spark, d, "quran_surahs").distinct(), 7).select("number", "name", "verses_count")


def all_surahs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quran_surahs").distinct()


def surah_counts(spark: SparkSession, d: str) -> DataFrame:
    """Verses counted and verses there, by chapter."""
    s = table(spark, d, "quran_surahs").select("number", "verses_count").distinct()
    return C.with_counts(s, C.verse_table(table(spark, d, "quran_verses")))


def verse_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return C.verse_skeleton(table(spark, d, "quran_surahs").select("number", "verses_count").distinct())


def words_to_verses(spark: SparkSession, d: str) -> DataFrame:
    """Verses put together again from their numbered words."""
    v = C.verse_table(table(spark, d, "quran_verses"))
    words = v.select("surah", "ayah", F.posexplode(F.split("text", " ")).alias("word", "text")).withColumn("pos", F.col("word"))
    return C.words_to_verses(words)


def etl_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Corpus from verses and the words of processed texts, by left join."""
    v = C.verse_table(table(spark, d, "quran_verses"))
    p = table(spark, d, "processed_verses").select("proc_id", "surah", "ayah", "text_simple").distinct()
    words = p.select("surah", "ayah", "proc_id", F.posexplode(F.split("text_simple", " ")).alias("word", "text")).withColumn("pos", F.col("proc_id"))
    built = C.build_from_maps(v.select("id", "surah", "ayah", "text"), words)
    return built.select("id", "surah", "ayah", "text", "text_simple")


def search_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten most similar verses of every quote whose id is divisible by 50."""
    asked = quotes_of(spark, d).where((F.col("quote_id") % 50 == 0) & T.contains_arabic(F.col("text"))).select(F.col("quote_id").alias("qid"), F.col("text").alias("query"))
    return lookup.search(asked, corpus_of(spark, d)).withColumn("similarity", F.round("similarity", 9))


# --- matching


def exact_match(spark: SparkSession, d: str) -> DataFrame:
    q = quotes_of(spark, d).select("quote_id", T.strip(F.col("text")).alias("text"))
    return q.join(match.exact_verses(corpus_of(spark, d)), "text").select("quote_id", F.col("v.id").alias("verse_id"))


def normalized_match(spark: SparkSession, d: str) -> DataFrame:
    """First verse of each quote's normalized text, with the suggestions if there are several."""
    q = quotes_of(spark, d).where(T.contains_arabic(F.col("text"))).select("quote_id", T.normalize_arabic(F.col("text")).alias("norm"))
    hit = q.join(match.normalized_verses(corpus_of(spark, d), 3), "norm")
    return hit.select("quote_id", F.col("v.id").alias("verse_id"), F.array_join(F.col("suggestions.reference"), ",").alias("suggestions"))


def _residue(spark: SparkSession, d: str, corpus: DataFrame) -> DataFrame:
    """Distinct normalized texts that neither of the first two stages resolves."""
    q = quotes_of(spark, d).where(T.contains_arabic(F.col("text"))).select(T.normalize_arabic(F.col("text")).alias("nq")).distinct()
    return q.join(corpus.select(F.col("norm").alias("nq")).distinct(), "nq", "left_anti")


def partial_match(spark: SparkSession, d: str) -> DataFrame:
    corpus = corpus_of(spark, d)
    return match.partial_matches(_residue(spark, d, corpus), corpus).select("nq", F.col("v.id").alias("verse_id"), F.round("confidence", 9).alias("confidence"))


def _fuzzy(spark: SparkSession, d: str) -> DataFrame:
    corpus = materialize(corpus_of(spark, d))  # read by every step
    return match.fuzzy_matches(materialize(_residue(spark, d, corpus)), corpus, ValidatorOptions())


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Most similar verse of every text the first two stages leave, containment aside."""
    m = _fuzzy(spark, d)
    return m.select("nq", F.col("v.id").alias("verse_id"), F.round("confidence", 9).alias("confidence"))


def fuzzy_suggestions(spark: SparkSession, d: str) -> DataFrame:
    rows = _fuzzy(spark, d).select("nq", F.posexplode("suggestions").alias("n", "s"))
    return rows.select("nq", "n", "s.verse_id", "s.reference", F.round("s.confidence", 9).alias("confidence"))


def validate_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every quote through the cascade."""
    shown = ("quote_id", "is_valid", "match_type", F.round("confidence", 9).alias("confidence"), "verse_id", "reference")
    return match.validate(_all_quotes(spark, d), corpus_of(spark, d), distinct=True).select(*shown, F.array_join(F.col("suggestions.reference"), ",").alias("suggestions"), F.size("differences").alias("n_differences"))


def validate_no_partial(spark: SparkSession, d: str) -> DataFrame:
    """The cascade without containment."""
    v = match.validate(_all_quotes(spark, d), corpus_of(spark, d), ValidatorOptions(include_partial=False), distinct=True, with_suggestions=False, with_text=False)
    return v.select("quote_id", "match_type", F.round("confidence", 9).alias("confidence"), "verse_id")


def match_summary(spark: SparkSession, d: str) -> DataFrame:
    """Quotes by how they were resolved."""
    v = match.validate(_all_quotes(spark, d), corpus_of(spark, d), with_differences=False, distinct=True)
    return v.groupBy("match_type").agg(F.count("*").alias("n_quotes"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, normalize_options, remove_diacritics, contains_arabic, clean_texts, extract_segments, similarity_pairs, find_differences,
        parse_reference, normalized_index, get_verse, verse_range, range_missing, surah_verses, get_surah, all_surahs, surah_counts, verse_skeleton,
        words_to_verses, etl_corpus, search_topk, exact_match, normalized_match, partial_match, fuzzy_match, fuzzy_suggestions, validate_cascade,
        validate_no_partial, match_summary,
    )
}

_Q = f"WITH {S.ASKED}, {S.CORPUS}"
_RANGES = "ranges AS (SELECT DISTINCT surah, start_ayah, coalesce(end_ayah, start_ayah) AS end_ayah FROM parsed_references)"
_DIFFS = """
p AS (SELECT quote_id, original AS a, corrected AS b, least(length(original), length(corrected)) AS m FROM pairs),
mm AS (SELECT quote_id, i FROM (SELECT quote_id, a, b, unnest(range(m)) AS i FROM p) WHERE substr(a, i + 1, 1) <> substr(b, i + 1, 1)),
isl AS (SELECT quote_id, i, i - row_number() OVER (PARTITION BY quote_id ORDER BY i) AS g FROM mm),
runs AS (SELECT quote_id, min(i) AS s, max(i) + 1 AS e FROM isl GROUP BY quote_id, g),
diffs AS (
  SELECT quote_id, s AS position, CASE WHEN e < m THEN substr(a, s + 1, e - s) ELSE substr(a, s + 1) END AS input,
    CASE WHEN e < m THEN substr(b, s + 1, e - s) ELSE substr(b, s + 1) END AS correct
  FROM runs JOIN p USING (quote_id)
  UNION ALL
  SELECT quote_id, m, coalesce(nullif(substr(a, m + 1), ''), '(missing)'), coalesce(nullif(substr(b, m + 1), ''), '(extra)')
  FROM p WHERE length(a) <> length(b) AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.quote_id = p.quote_id AND r.e = p.m))
"""
_STAGES = f"""
gated AS (SELECT DISTINCT q, {S.norm('q')} AS nq FROM asked WHERE {S.has_arabic('q')}),
ex AS (SELECT text AS q, min(ord) AS ord FROM corpus GROUP BY text),
nm AS (SELECT norm AS nq, min(ord) AS ord, count(*) AS n, array_to_string(list(concat(surah, ':', ayah) ORDER BY ord)[1:3], ',') AS refs FROM corpus GROUP BY norm),
residue AS (SELECT DISTINCT nq FROM gated WHERE nq NOT IN (SELECT nq FROM nm)),
hits AS (
  SELECT nq, ord, CASE WHEN contains(norm, nq) THEN 0.7::DOUBLE + length(nq)::DOUBLE / length(norm) * 0.2::DOUBLE
    ELSE 0.6::DOUBLE + length(norm)::DOUBLE / length(nq) * 0.2::DOUBLE END AS confidence
  FROM residue JOIN corpus ON contains(norm, nq) OR contains(nq, norm)),
part AS (SELECT nq, min(ord) AS ord, arg_min(confidence, ord) AS confidence FROM hits GROUP BY nq),
lettered AS (SELECT nq, letters, {S.coded(S.wide('nq'), 'letters')} AS code FROM (SELECT nq, {S.alphabet(S.wide('nq'))} AS letters FROM residue)),
sims AS (SELECT nq, ord, surah, ayah, {S.similarity('nq', 'norm', f"levenshtein(code, {S.coded('wide', 'letters')})")} AS sim FROM lettered JOIN corpus ON least(length(nq), length(norm)) >= 0.7 * greatest(length(nq), length(norm))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY nq ORDER BY sim DESC, ord) AS rn, max(sim) OVER (PARTITION BY nq) AS top FROM sims WHERE sim >= 0.8::DOUBLE * 0.9::DOUBLE),
fz AS (SELECT nq, arg_min(ord, rn) AS ord, max(sim) AS confidence, array_to_string(list(concat(surah, ':', ayah) ORDER BY rn), ',') AS refs FROM ranked WHERE rn <= 3 AND top >= 0.8::DOUBLE GROUP BY nq)
"""


def _cascade(partial: bool) -> str:
    part = "part" if partial else "(SELECT * FROM part WHERE false)"
    return f"""
resolved AS (
  SELECT q, nq, CASE WHEN ex.ord IS NOT NULL THEN 'exact' WHEN nm.ord IS NOT NULL THEN 'normalized' WHEN pt.ord IS NOT NULL THEN 'partial' WHEN fz.ord IS NOT NULL THEN 'fuzzy' END AS kind,
    coalesce(ex.ord, nm.ord, pt.ord, fz.ord) AS ord,
    CASE WHEN ex.ord IS NOT NULL THEN 1.0::DOUBLE WHEN nm.ord IS NOT NULL THEN 0.95::DOUBLE WHEN pt.ord IS NOT NULL THEN pt.confidence ELSE fz.confidence END AS confidence,
    CASE WHEN ex.ord IS NOT NULL THEN '' WHEN nm.ord IS NOT NULL THEN CASE WHEN nm.n > 1 THEN nm.refs ELSE '' END WHEN pt.ord IS NOT NULL THEN '' ELSE fz.refs END AS refs
  FROM gated LEFT JOIN ex USING (q) LEFT JOIN nm USING (nq) LEFT JOIN {part} AS pt USING (nq) LEFT JOIN fz USING (nq)),
verdict AS (
  SELECT quote_id, asked.q, kind, resolved.confidence, c.id AS verse_id, c.surah, c.ayah, c.text AS verse_text, refs
  FROM asked LEFT JOIN resolved ON resolved.q = asked.q AND kind IS NOT NULL LEFT JOIN corpus c USING (ord))
"""


SQL = {
    "normalize_text": f"{_Q} SELECT quote_id, {S.norm('original')} AS norm FROM asked",
    "normalize_options": f"{_Q} SELECT quote_id, {', '.join(f'{S.norm("original", o)} AS {n}' for n, o in _VARIANTS.items())} FROM asked",
    "remove_diacritics": f"{_Q} SELECT quote_id, regexp_replace(original, '[{S.MARKS_RE2}]', '', 'g') AS bare FROM asked",
    "contains_arabic": f"{_Q} SELECT quote_id, {S.has_arabic('original')} AS arabic FROM asked",
    "clean_texts": f"{_Q} SELECT quote_id, {S.clean('original')} AS cleaned, {S.strip("translate(original, '٠١٢٣٤٥٦٧٨٩', '')")} AS digitless, q AS stripped FROM asked",
    "extract_segments": f"""{_Q}, framed AS (SELECT quote_id, concat('It is said: ', original, ' (sic), ', original, chr(10)) AS t FROM asked),
hits AS (SELECT quote_id, regexp_extract_all(t, '[{S.A_RE2}][{S.A_RE2}{S.WS_RE2}]*') AS h, string_split_regex(t, '[{S.A_RE2}][{S.A_RE2}{S.WS_RE2}]*') AS g FROM framed),
each AS (SELECT quote_id, h[i] AS raw, CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i - 1]]), 0) AS INT) AS s
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM hits))
SELECT quote_id, {S.strip('raw')} AS text, s AS start, s + length(raw) AS "end" FROM each WHERE {S.strip('raw')} <> ''""",
    "similarity_pairs": f"""WITH n AS (SELECT DISTINCT quote_id, {S.norm('original')} AS a, {S.norm('corrected')} AS b FROM quotes WHERE original IS NOT NULL AND corrected IS NOT NULL)
SELECT quote_id, {S.distance('a', 'b')} AS distance, round({S.similarity('a', 'b')}, 9) AS similarity FROM n""",
    "find_differences": f"WITH pairs AS (SELECT DISTINCT quote_id, original, corrected FROM quotes WHERE original IS NOT NULL AND corrected IS NOT NULL), {_DIFFS} SELECT * FROM diffs",
    "parse_reference": rf"""WITH r AS (SELECT DISTINCT quote_id, {S.plain_digits('reference')} AS r, '^([0-9]+):([0-9]+)(-([0-9]+))?\n?$' AS shape FROM quotes WHERE reference IS NOT NULL)
SELECT quote_id, regexp_extract(r, '^([0-9]+):([0-9]+)(-([0-9]+))?\n?$', 1)::BIGINT AS surah, regexp_extract(r, '^([0-9]+):([0-9]+)(-([0-9]+))?\n?$', 2)::BIGINT AS start_ayah,
  nullif(regexp_extract(r, '^([0-9]+):([0-9]+)(-([0-9]+))?\n?$', 4), '')::BIGINT AS end_ayah, regexp_extract(r, '^([0-9]+):([0-9]+)(-([0-9]+))?\n?$', 4) <> '' AS is_range
FROM r WHERE regexp_matches(r, '^([0-9]+):([0-9]+)(-([0-9]+))?\n?$')""",
    "normalized_index": f"WITH {S.CORPUS} SELECT {S.norm('text_simple', INDEX_OPTIONS)} AS norm, array_to_string(list(id ORDER BY id), ',') AS ids FROM corpus GROUP BY 1",
    "get_verse": f"WITH {S.CORPUS} SELECT DISTINCT ref_id, p.surah, start_ayah AS ayah, id AS verse_id, text FROM parsed_references p LEFT JOIN corpus c ON c.surah = p.surah AND c.ayah = p.start_ayah",
    "verse_range": f"""WITH {S.CORPUS}, {_RANGES} SELECT r.surah, start_ayah, end_ayah, string_agg(text, ' ' ORDER BY ayah) AS text, string_agg(text_simple, ' ' ORDER BY ayah) AS text_simple,
  string_agg(id::VARCHAR, ',' ORDER BY ayah) AS verse_ids FROM ranges r JOIN corpus c ON c.surah = r.surah AND ayah BETWEEN start_ayah AND end_ayah
GROUP BY ALL HAVING count(*) = end_ayah - start_ayah + 1""",
    "range_missing": f"""WITH {S.CORPUS}, {_RANGES} SELECT r.surah, start_ayah, end_ayah FROM ranges r LEFT JOIN corpus c ON c.surah = r.surah AND ayah BETWEEN start_ayah AND end_ayah
WHERE r.surah IS NOT NULL AND start_ayah IS NOT NULL GROUP BY ALL HAVING start_ayah > end_ayah OR count(id) < end_ayah - start_ayah + 1""",
    "surah_verses": f"WITH {S.CORPUS} SELECT id, surah, ayah, text FROM corpus WHERE surah = 7",
    "get_surah": "SELECT DISTINCT number, name, verses_count FROM quran_surahs WHERE number = 7",
    "all_surahs": "SELECT DISTINCT * FROM quran_surahs",
    "surah_counts": f"WITH {S.CORPUS} SELECT number, verses_count, (SELECT count(*) FROM corpus c WHERE c.surah = s.number) AS n_verses FROM (SELECT DISTINCT number, verses_count FROM quran_surahs) s",
    "verse_skeleton": "SELECT number AS surah, unnest(range(1, verses_count + 1))::INT AS ayah FROM (SELECT DISTINCT number, verses_count FROM quran_surahs)",
    "words_to_verses": f"WITH {S.CORPUS} SELECT surah, ayah, {S.strip("translate(text, '٠١٢٣٤٥٦٧٨٩', '')")} AS text FROM (SELECT surah, ayah, array_to_string([w FOR w IN string_split(text, ' ') IF w <> ''], ' ') AS text FROM corpus)",
    "etl_corpus": f"""WITH {S.CORPUS}, w AS (SELECT surah, ayah, proc_id, unnest(string_split(text_simple, ' ')) AS t, generate_subscripts(string_split(text_simple, ' '), 1) AS word
  FROM (SELECT DISTINCT proc_id, surah, ayah, text_simple FROM processed_verses WHERE text_simple IS NOT NULL)),
l AS (SELECT surah, ayah, word, arg_max(t, proc_id) AS t FROM w GROUP BY ALL),
j AS (SELECT surah, ayah, {S.strip("translate(coalesce(string_agg(t, ' ' ORDER BY word) FILTER (t <> ''), ''), '٠١٢٣٤٥٦٧٨٩', '')")} AS text_simple FROM l GROUP BY ALL)
SELECT id, c.surah, c.ayah, text, coalesce(j.text_simple, '') AS text_simple FROM corpus c LEFT JOIN j ON j.surah = c.surah AND j.ayah = c.ayah""",
    "search_topk": f"""{_Q}, lettered AS (SELECT quote_id, nq, letters, {S.coded(S.wide('nq'), 'letters')} AS code
  FROM (SELECT quote_id, {S.norm('original')} AS nq, {S.alphabet(S.wide(S.norm('original')))} AS letters FROM asked WHERE quote_id % 50 = 0 AND {S.has_arabic('original')})),
s AS (SELECT quote_id AS qid, id, surah, ayah, ord, {S.similarity('nq', 'norm', f"levenshtein(code, {S.coded('wide', 'letters')})")} AS similarity FROM lettered, corpus),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, ord) AS rank FROM s WHERE similarity > 0.3::DOUBLE)
SELECT qid, id, surah, ayah, round(similarity, 9) AS similarity, rank FROM r WHERE rank <= 10""",
    "exact_match": f"{_Q} SELECT quote_id, min(id) AS verse_id FROM asked JOIN corpus ON corpus.text = q GROUP BY 1",
    "normalized_match": f"""{_Q} SELECT quote_id, min(id) AS verse_id, CASE WHEN count(*) > 1 THEN array_to_string(list(concat(surah, ':', ayah) ORDER BY ord)[1:3], ',') ELSE '' END AS suggestions
FROM asked JOIN corpus ON norm = {S.norm('original')} WHERE {S.has_arabic('original')} GROUP BY quote_id""",
    "partial_match": f"{_Q}, {_STAGES} SELECT nq, ord AS verse_id, round(confidence, 9) AS confidence FROM part",
    "fuzzy_match": f"{_Q}, {_STAGES} SELECT nq, ord AS verse_id, round(confidence, 9) AS confidence FROM fz",
    "fuzzy_suggestions": f"{_Q}, {_STAGES} SELECT nq, rn - 1 AS n, ord AS verse_id, concat(surah, ':', ayah) AS reference, round(sim, 9) AS confidence FROM ranked WHERE rn <= 3 AND top >= 0.8::DOUBLE",
    "validate_cascade": f"""{_Q}, {_STAGES}, {_cascade(True)},
pairs AS (SELECT quote_id, q AS original, verse_text AS corrected FROM verdict WHERE kind IS NOT NULL AND kind <> 'exact'), {_DIFFS}
SELECT quote_id, kind IS NOT NULL AS is_valid, coalesce(kind, 'none') AS match_type, round(coalesce(confidence, 0.0::DOUBLE), 9) AS confidence, verse_id,
  CASE WHEN verse_id IS NOT NULL THEN concat(surah, ':', ayah) END AS reference, coalesce(refs, '') AS suggestions,
  (SELECT count(*) FROM diffs WHERE diffs.quote_id = verdict.quote_id) AS n_differences FROM verdict""",
    "validate_no_partial": f"{_Q}, {_STAGES}, {_cascade(False)} SELECT quote_id, coalesce(kind, 'none') AS match_type, round(coalesce(confidence, 0.0::DOUBLE), 9) AS confidence, verse_id FROM verdict",
    "match_summary": f"{_Q}, {_STAGES}, {_cascade(True)} SELECT coalesce(kind, 'none') AS match_type, count(*) AS n_quotes, round(avg(coalesce(confidence, 0.0::DOUBLE)), 6) AS mean_confidence FROM verdict GROUP BY 1",
}
