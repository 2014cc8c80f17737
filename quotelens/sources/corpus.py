"""Canonical corpus: JSON sources with fallback, row parsers, sinks, the inverted index
and the two pipelines that build the corpus from raw downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.functions.text import clean_text, normalize_arabic, strip_arabic_digits
from quotelens.options import INDEX_OPTIONS

VERSE_JSON = "id INT, surah INT, ayah INT, text STRING, textSimple STRING, page INT, juz INT"
SURAH_JSON = "number INT, name STRING, englishName STRING, versesCount INT, revelationType STRING"
POSITION = "file_position"
WORD_MAP = "map<string,struct<surah:string,ayah:string,word:string,text:string>>"
VERSE_MAP = "map<string,struct<id:int,surah:int,ayah:int,text:string>>"
PAYLOAD = (
    "struct<code:int,status:string,data:struct<surahs:array<struct<number:int,name:string,englishName:string,"
    "revelationType:string,ayahs:array<struct<text:string,numberInSurah:int,page:int,juz:int>>>>>>"
)


def json_rows(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Rows of the JSON array ``name``.json, or of ``name``.min.json where that is missing,
    with their order in the file."""
    jvm = spark.sparkContext._jvm
    for path in (f"{folder}/{name}.json", f"{folder}/{name}.min.json"):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            rows = spark.read.schema(schema).option("multiLine", True).json(path)
            return rows.withColumn(POSITION, F.monotonically_increasing_id())
    raise FileNotFoundError(f"{name}.json and {name}.min.json are missing in {folder}")


def parse_verses(rows: DataFrame) -> DataFrame:
    """Verses with defaults for missing optional fields; ``ord`` is the order in the file,
    or that of ids where the rows come from elsewhere."""
    order = POSITION if POSITION in rows.columns else "id"
    return rows.select(
        "id", "surah", "ayah", "text", F.coalesce("textSimple", F.lit("")).alias("text_simple"),
        F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("juz", F.lit(0)).alias("juz"), F.col(order).alias("ord"),
    )


def parse_surahs(rows: DataFrame) -> DataFrame:
    return rows.select("number", "name", F.col("englishName").alias("english_name"), F.col("versesCount").alias("verses_count"), F.col("revelationType").alias("revelation_type"))


def load_corpus(spark: SparkSession, folder: str, verses: str = "quran-verses", surahs: str = "quran-surahs") -> tuple[DataFrame, DataFrame]:
    return parse_verses(json_rows(spark, folder, verses, VERSE_JSON)), parse_surahs(json_rows(spark, folder, surahs, SURAH_JSON))


def verse_table(verses: DataFrame) -> DataFrame:
    """Corpus of a table of deliveries: each verse once, in the order of ids."""
    return verses.select("id", "surah", "ayah", "text", "text_simple", "page", "juz").distinct().withColumn("ord", F.col("id"))


def prepared(corpus: DataFrame) -> DataFrame:
    """``corpus`` with its normalized text, computed once, and that text's length."""
    return corpus.withColumn("norm", normalize_arabic(F.col("text"))).withColumn("norm_len", F.length("norm"))


def verse_skeleton(surahs: DataFrame) -> DataFrame:
    """(surah, ayah) of every verse that the chapters' counts promise."""
    counted = surahs.where(F.col("verses_count") >= 1)
    return counted.select(F.col("number").alias("surah"), F.explode(F.sequence(F.lit(1), "verses_count")).alias("ayah"))


def surah_counts(verses: DataFrame) -> DataFrame:
    return verses.groupBy("surah").agg(F.count("*").alias("n_verses"))


def with_counts(surahs: DataFrame, verses: DataFrame) -> DataFrame:
    """Chapters with the number of verses present, 0 where there are none."""
    counts = surah_counts(verses).withColumnRenamed("surah", "number")
    return surahs.join(counts, "number", "left").withColumn("n_verses", F.coalesce("n_verses", F.lit(0)))


def normalized_index(verses: DataFrame, text: str = "text_simple") -> DataFrame:
    """(norm, ids): ids in order of every text in index form; empty keys are kept."""
    return verses.where(F.col(text).isNotNull()).groupBy(normalize_arabic(F.col(text), INDEX_OPTIONS).alias("norm")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def words_to_verses(words: DataFrame) -> DataFrame:
    """(surah, ayah, text) of ``words`` (surah, ayah, word, text, pos).

    Words stand at their number, the last in input order (``pos``) wins a number twice
    given, empty ones are skipped, then Arabic-Indic digits are dropped.
    """
    last = words.groupBy("surah", "ayah", "word").agg(F.max_by(F.coalesce("text", F.lit("")), "pos").alias("text"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "text")))
    shown = F.filter(F.transform(in_order, lambda w: w["text"]), lambda t: t != "")
    return last.groupBy("surah", "ayah").agg(strip_arabic_digits(F.array_join(shown, " ")).alias("text"))


def read_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(pos, location, value struct) of a JSON file that is one object keyed by location."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.map_entries(F.from_json("value", schema))).alias("pos", "e")).select("pos", F.col("e.key").alias("location"), F.col("e.value").alias("v"))


def build_from_maps(verses: DataFrame, words: DataFrame) -> DataFrame:
    """Corpus rows from verses (id, surah, ayah, text) and words; a verse without words
    gets an empty simple text."""
    simple = words_to_verses(words).withColumnRenamed("text", "text_simple")
    joined = verses.join(simple, ["surah", "ayah"], "left")
    return joined.select("id", "surah", "ayah", "text", F.coalesce("text_simple", F.lit("")).alias("text_simple"), F.lit(0).alias("page"), F.lit(0).alias("juz"), F.col("id").alias("ord"))


def build_from_payload(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Corpus rows from an API payload: nested chapters unnested, ids in reading order.  A
    payload whose code isn't 200 is an error, not an empty corpus."""
    code = F.col(f"{column}.code")
    failed = F.raise_error(F.concat(F.lit("download failed with code "), F.coalesce(code.cast("string"), F.lit("null"))))
    surahs = payload.select(F.explode(F.when(code == 200, F.col(f"{column}.data.surahs")).otherwise(failed)).alias("s"))
    verses = surahs.select(F.col("s.number").alias("surah"), F.posexplode("s.ayahs").alias("n", "a"))
    # Ids run over all chapters: each chapter's offset comes from the chapters' sizes.
    sizes = surahs.select(F.col("s.number").alias("surah"), F.size("s.ayahs").alias("size"))
    before = Window.partitionBy(F.lit(0)).orderBy("surah").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("surah", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))  # a row a chapter
    number = (F.col("offset") + F.col("n") + 1).cast("int")
    text = F.trim(clean_text(F.col("a.text")))
    return verses.join(offsets, "surah").select(
        number.alias("id"), "surah", F.col("a.numberInSurah").alias("ayah"), text.alias("text"), F.lit("").alias("text_simple"),
        F.coalesce("a.page", F.lit(0)).alias("page"), F.coalesce("a.juz", F.lit(0)).alias("juz"), number.alias("ord"),
    )


def camel_verses(verses: DataFrame) -> DataFrame:
    """Verses in the field names of the JSON files, which ``parse_verses`` reads."""
    return verses.select("id", "surah", "ayah", "text", F.col("text_simple").alias("textSimple"), "page", "juz")


def camel_surahs(surahs: DataFrame) -> DataFrame:
    return surahs.select("number", "name", F.col("english_name").alias("englishName"), F.col("verses_count").alias("versesCount"), F.col("revelation_type").alias("revelationType"))


def json_object(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def _write_lines(items: DataFrame, order: str, path: str, ends: tuple[str, str], pretty: bool) -> None:
    """A JSON file of ``items`` (.., line) in order: a sorted stream of lines, never held
    as a whole."""
    number = F.row_number().over(Window.orderBy(order, "line"))
    gap = "  " if pretty else ""
    lines = items.select(F.lit(1).alias("part"), number.alias("n"), F.concat(F.when(number > 1, "," + gap).otherwise(gap), "line").alias("value"))
    edges = items.sparkSession.createDataFrame([(0, 0, ends[0]), (2, 0, ends[1])], "part int, n int, value string")
    lines.unionByName(edges).repartition(1).sortWithinPartitions("part", "n").select("value").write.mode("overwrite").option("lineSep", "\n" if pretty else " ").text(path)


def write_json_array(rows: DataFrame, path: str, columns: list[str], order: str, pretty: bool = False) -> None:
    """One JSON array of a corpus or dimension, in order, non-ASCII kept; one file, which
    ``json_rows`` reads back.  Null fields are written as null; an empty table gives []."""
    _write_lines(rows.select(F.col(order).alias("k"), json_object(columns).alias("line")), "k", path, ("[", "]"), pretty)


def write_json_map(rows: DataFrame, path: str, key: str, value: Column, pretty: bool = False) -> None:
    """One JSON object with a field for each row, in order of its ``key``: the raw downloads'
    form, and that of the inverted index (``read_map``)."""
    name = F.regexp_extract(F.to_json(F.array(F.col(key))), r"(?s)^\[(.*)\]$", 1)
    _write_lines(rows.select(F.col(key).alias("k"), F.concat(name, F.lit(":"), value).alias("line")), "k", path, ("{", "}"), pretty)
