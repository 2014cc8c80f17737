"""Queries of the JSON sources and sinks, the corpus pipelines over them and the SQL
functions, and their SQL.  What is written goes below the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.functions import text as T
from quotelens.functions.register import register
from quotelens.operators import quotes as Q
from quotelens.plans import document_queries as D
from quotelens.plans import match_queries as M
from quotelens.plans import sqltext as S
from quotelens.plans.runtime import shared_dir, table
from quotelens.sources import corpus as C


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"


def _verses(spark: SparkSession, d: str) -> DataFrame:
    return C.verse_table(table(spark, d, "quran_verses"))


def json_verses(spark: SparkSession, d: str) -> DataFrame:
    """Verses written as a JSON array and read back by way of the minified fallback."""
    at = _folder(spark)
    rows = C.camel_verses(_verses(spark, d))
    C.write_json_array(rows, f"{at}/quran-verses.min.json", rows.columns, "id")
    return C.parse_verses(C.json_rows(spark, at, "quran-verses", C.VERSE_JSON))


def json_surahs(spark: SparkSession, d: str) -> DataFrame:
    """Chapters written as an indented JSON array and read back."""
    at = _folder(spark)
    rows = C.camel_surahs(table(spark, d, "quran_surahs").distinct())
    C.write_json_array(rows, f"{at}/quran-surahs.json", rows.columns, "number", pretty=True)
    return C.parse_surahs(C.json_rows(spark, at, "quran-surahs", C.SURAH_JSON))


def json_index(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index written as a JSON object and read back."""
    path = f"{_folder(spark)}/normalized-index.json"
    C.write_json_map(C.normalized_index(_verses(spark, d)), path, "norm", F.to_json("ids"))
    return C.read_map(spark, path, "map<string,array<int>>").select(F.col("location").alias("norm"), F.array_join("v", ",").alias("ids"))


def json_word_maps(spark: SparkSession, d: str) -> DataFrame:
    """Corpus from the two raw maps, verses and their words, both written as JSON."""
    at, v = _folder(spark), _verses(spark, d)
    place = F.concat_ws(":", "surah", "ayah")
    C.write_json_map(v.select(place.alias("k"), C.json_object(["id", "surah", "ayah", "text"]).alias("j")), f"{at}/verses.json", "k", F.col("j"))
    words = v.select("surah", "ayah", F.posexplode(F.split("text", " ")).alias("word", "text"))
    C.write_json_map(words.select(F.concat_ws(":", "surah", "ayah", "word").alias("k"), C.json_object(["surah", "ayah", "word", "text"]).alias("j")), f"{at}/words.json", "k", F.col("j"))
    w = C.read_map(spark, f"{at}/words.json", C.WORD_MAP)
    typed = w.select("pos", *[F.col(f"v.{c}").try_cast("int").alias(c) for c in ("surah", "ayah", "word")], "v.text")
    built = C.build_from_maps(C.read_map(spark, f"{at}/verses.json", C.VERSE_MAP).select("v.*"), typed)
    return built.select("id", "surah", "ayah", "text", "text_simple")


def payload_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Corpus from one nested download: chapters with their verses, numbered in reading order."""
    v = _verses(spark, d).select("surah", F.struct(F.col("ayah").alias("numberInSurah"), "text", "page", "juz").alias("a"))
    surahs = v.groupBy("surah").agg(F.array_sort(F.collect_list("a")).alias("ayahs"))
    one = F.struct(F.col("surah").alias("number"), F.lit("").alias("name"), F.lit("").alias("englishName"), F.lit("").alias("revelationType"), "ayahs")
    data = surahs.agg(F.to_json(F.struct(F.lit(200).alias("code"), F.lit("OK").alias("status"), F.struct(F.collect_list(one).alias("surahs")).alias("data"))).alias("j"))
    payload = data.select(F.from_json("j", C.PAYLOAD).alias("payload"))
    return C.build_from_payload(payload).select("id", "surah", "ayah", "text", "page", "juz")


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions as SQL calls them."""
    register(spark)
    M.quotes_of(spark, d).createOrReplaceTempView("quotelens_quotes")
    return spark.sql("""SELECT quote_id, normalize_arabic(text) AS norm, remove_diacritics(text) AS bare, contains_arabic(text) AS arabic,
  round(text_similarity(normalize_arabic(text), remove_diacritics(text)), 9) AS similarity FROM quotelens_quotes""")


def segments_table_function(spark: SparkSession, d: str) -> DataFrame:
    """Arabic segments of every output by the table function, in a lateral join."""
    register(spark)
    D.documents_of(spark, d).createOrReplaceTempView("quotelens_outputs")
    return spark.sql("SELECT doc_id, s.text, s.start, s.end FROM quotelens_outputs, LATERAL arabic_segments(text) s")


def tag_formats(spark: SparkSession, d: str) -> DataFrame:
    """Every quote in the tag formats, with its first word replaced and its confidence in per cent."""
    q = table(spark, d, "quotes").select("quote_id", "original", "reference", "confidence").distinct().where(F.col("original").isNotNull())
    shapes = [T.tagged(f, F.col("reference"), F.col("original")).alias(f) for f in ("xml", "markdown", "bracket", "other")]
    word = F.substring_index(T.strip(F.col("original")), " ", 1)
    return q.select("quote_id", *shapes, T.replace_first(F.col("original"), word, F.lit("X")).alias("replaced"), T.percent(F.col("confidence")).alias("percent"))


def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of every quote and its correction as stored."""
    p = table(spark, d, "quotes").select("quote_id", "original", "corrected").distinct().dropna()
    return p.select("quote_id", F.levenshtein("original", "corrected").alias("distance"))


def duplicate_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for every normalized text that several verses have."""
    from quotelens.operators.match import normalized_verses

    found = normalized_verses(M.corpus_of(spark, d), 3).where(F.size("suggestions") > 0)
    return found.select("norm", F.posexplode("suggestions").alias("n", "s")).select("norm", "n", "s.verse_id", "s.reference", "s.confidence")


def inline_refs(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with a reference in brackets after them, tags aside."""
    return Q.all_spans(D.documents_of(spark, d), "xml").where(F.col("how") == "inline").drop("how")


QUERIES = {
    f.__name__: f
    for f in (
        json_verses, json_surahs, json_index, json_word_maps, payload_corpus, sql_functions, segments_table_function, tag_formats,
        levenshtein_pairs, duplicate_suggestions, inline_refs,
    )
}

_FORMS = {"xml": ("'<quran ref=\"'", "'\">'", "'</quran>'"), "markdown": ("'```quran ref=\"'", "'\"' || chr(10)", "chr(10) || '```'"), "bracket": ("'[[Q:'", "'|'", "']]'")}
_TAGGED = ", ".join(f"{a} || ref || {b} || original || {c} AS {f}" for f, (a, b, c) in _FORMS.items())
_DIGITLESS = S.strip("translate(x, '٠١٢٣٤٥٦٧٨٩', '')")

SQL = {
    "json_verses": """WITH v AS (SELECT DISTINCT id, surah, ayah, text, coalesce(text_simple, '') AS text_simple, coalesce(page, 0) AS page, coalesce(juz, 0) AS juz FROM quran_verses)
SELECT *, row_number() OVER (ORDER BY id) - 1 AS ord FROM v""",
    "json_surahs": "SELECT DISTINCT number, name, english_name, verses_count, revelation_type FROM quran_surahs",
    "json_index": M.SQL["normalized_index"],
    "json_word_maps": f"""WITH {S.CORPUS}, j AS (SELECT *, array_to_string([w FOR w IN string_split(text, ' ') IF w <> ''], ' ') AS x FROM corpus)
SELECT id, surah, ayah, text, {_DIGITLESS} AS text_simple FROM j""",
    "payload_corpus": f"""WITH {S.CORPUS} SELECT row_number() OVER (ORDER BY surah, ayah)::INT AS id, surah, ayah, trim({S.clean('text')}, ' ') AS text, coalesce(page, 0) AS page, coalesce(juz, 0) AS juz FROM corpus""",
    "sql_functions": f"""WITH {S.ASKED}, n AS (SELECT quote_id, {S.norm('original')} AS norm, regexp_replace(original, '[{S.MARKS_RE2}]', '', 'g') AS bare, {S.has_arabic('original')} AS arabic FROM asked)
SELECT *, round({S.similarity('norm', 'bare')}, 9) AS similarity FROM n""",
    "segments_table_function": f"""WITH {D._docs('xml')}, {D._SEGMENTS.replace(">= 10)", "> 0)")} SELECT * FROM seg""",
    "tag_formats": f"""WITH q AS (SELECT DISTINCT quote_id, original, coalesce(reference, 'None') AS ref, confidence, string_split({S.strip('original')}, ' ')[1] AS w FROM quotes WHERE original IS NOT NULL)
SELECT quote_id, {_TAGGED}, original || ' (' || ref || ')' AS other,
  CASE WHEN strpos(original, w) > 0 THEN substr(original, 1, strpos(original, w) - 1) || 'X' || substr(original, strpos(original, w) + length(w)) ELSE original END AS replaced,
  round_even(confidence * 100, 0)::BIGINT::VARCHAR AS percent FROM q""",
    "levenshtein_pairs": f"""SELECT quote_id, {S.distance('original', 'corrected')} AS distance FROM (SELECT DISTINCT quote_id, original, corrected FROM quotes WHERE original IS NOT NULL AND corrected IS NOT NULL)""",
    "duplicate_suggestions": f"""WITH {S.CORPUS}, r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY ord) AS rn, count(*) OVER (PARTITION BY norm) AS c FROM corpus)
SELECT norm, rn - 1 AS n, id AS verse_id, concat(surah, ':', ayah) AS reference, 0.95::DOUBLE AS confidence FROM r WHERE c > 1 AND rn <= 3""",
    "inline_refs": f"SELECT doc_id, ref, text, start, \"end\" FROM ({D._span_sql('xml')}) WHERE how = 'inline'",
}
