import json

import pytest
from pyspark.sql import functions as F

from quotelens.sources import corpus as C
from quotelens.streaming.validate import parquet_stream, start_validation, stream_validate


def test_json_sources_fall_back_and_fill_defaults(spark, tmp_path):
    (tmp_path / "quran-verses.min.json").write_text(json.dumps([{"id": 1, "surah": 1, "ayah": 1, "text": "قُلْ"}, {"id": 2, "surah": 1, "ayah": 2, "text": "هُوَ", "textSimple": "هو", "page": 3, "juz": 1}]))
    (tmp_path / "quran-surahs.json").write_text(json.dumps([{"number": 1, "name": "ا", "englishName": "A", "versesCount": 2, "revelationType": "Meccan"}]))
    verses, surahs = C.load_corpus(spark, str(tmp_path))
    assert [tuple(r) for r in verses.orderBy("id").collect()] == [(1, 1, 1, "قُلْ", "", 0, 0, 0), (2, 1, 2, "هُوَ", "هو", 3, 1, 1)]
    assert C.verse_skeleton(surahs).count() == 2
    with pytest.raises(FileNotFoundError):
        C.json_rows(spark, str(tmp_path), "nothing", "id INT")
    C.write_json_array(verses, f"{tmp_path}/out", ["id", "text"], "id")
    assert json.loads(spark.read.text(f"{tmp_path}/out", wholetext=True).collect()[0][0]) == [{"id": 1, "text": "قُلْ"}, {"id": 2, "text": "هُوَ"}]
    index = {r.norm: list(r.ids) for r in C.normalized_index(verses).collect()}
    assert index == {"": [1], "هو": [2]}


def test_word_map_pipeline(spark, tmp_path):
    words = {"1:1:2": {"surah": "1", "ayah": "1", "word": "2", "text": "هو"}, "1:1:1": {"surah": "1", "ayah": "1", "word": "1", "text": "قل"}, "1:1:3": {"surah": "1", "ayah": "1", "word": "3", "text": "١"}, "x": {"surah": "1", "ayah": "1", "word": "2", "text": "هوَ"}}
    verses = {"1:1": {"id": 5, "surah": 1, "ayah": 1, "text": "قُلْ هُوَ"}, "1:2": {"id": 6, "surah": 1, "ayah": 2, "text": "x"}}
    for name, x in (("w", words), ("v", verses)):
        (tmp_path / name).write_text(json.dumps(x))
    w = C.read_map(spark, f"{tmp_path}/w", C.WORD_MAP).selectExpr("pos", "cast(v.surah as int) surah", "cast(v.ayah as int) ayah", "cast(v.word as int) word", "v.text")
    v = C.read_map(spark, f"{tmp_path}/v", C.VERSE_MAP).select("v.*")
    got = {r.id: r.text_simple for r in C.build_from_maps(v, w).collect()}
    assert got == {5: "قل هوَ", 6: ""}


def test_payload_pipeline(spark):
    payload = {"code": 200, "status": "OK", "data": {"surahs": [{"number": n, "name": "x", "englishName": "X", "revelationType": "Meccan", "ayahs": [{"text": f"﻿ t{n}{k}", "numberInSurah": k, "page": 1, "juz": 1} for k in (1, 2)]} for n in (1, 2)]}}
    df = spark.createDataFrame([(json.dumps(payload),)], "j string").selectExpr(f"from_json(j, '{C.PAYLOAD}') payload")
    assert [(r.id, r.surah, r.ayah, r.text) for r in C.build_from_payload(df).orderBy("id").collect()] == [(1, 1, 1, "t11"), (2, 1, 2, "t12"), (3, 2, 1, "t21"), (4, 2, 2, "t22")]


def test_order_is_that_of_the_file_and_sinks_read_back(spark, tmp_path):
    rows = [{"id": 9, "surah": 1, "ayah": 1, "text": "a\"b"}, {"id": 2, "surah": 1, "ayah": 2, "text": "ق", "page": None}]
    (tmp_path / "quran-verses.json").write_text(json.dumps(rows))
    verses = C.parse_verses(C.json_rows(spark, str(tmp_path), "quran-verses", C.VERSE_JSON))
    assert [r.id for r in verses.orderBy("ord").collect()] == [9, 2]
    for pretty in (True, False):
        camel = C.camel_verses(verses)
        C.write_json_array(camel, f"{tmp_path}/{pretty}/v.json", camel.columns, "id", pretty)
        back = C.parse_verses(C.json_rows(spark, f"{tmp_path}/{pretty}", "v", C.VERSE_JSON))
        assert [(r.id, r.text) for r in back.orderBy("ord").collect()] == [(2, "ق"), (9, 'a"b')]
    C.write_json_array(verses.limit(0), f"{tmp_path}/none.json", ["id"], "id")
    assert C.json_rows(spark, str(tmp_path), "none", "id INT").count() == 0
    C.write_json_map(verses, f"{tmp_path}/m.json", "text", F.to_json(F.array("id")))
    assert {r.location: list(r.v) for r in C.read_map(spark, f"{tmp_path}/m.json", "map<string,array<int>>").collect()} == {'a"b': [9], "ق": [2]}


def test_failed_payload_is_an_error(spark):
    for code in (404, None):
        df = spark.createDataFrame([(json.dumps({"code": code, "data": {"surahs": []}}),)], "j string").selectExpr(f"from_json(j, '{C.PAYLOAD}') payload")
        with pytest.raises(Exception, match="download failed"):
            C.build_from_payload(df).collect()


def test_stream_equals_batch(spark, tmp_path):
    corpus = C.prepared(spark.createDataFrame([(1, 1, 1, "قُلْ هُوَ ٱلنُّورُ", "", 1)], "id int, surah int, ayah int, text string, text_simple string, ord int"))
    rows = [(1, "قل هو النور"), (2, "x"), (3, "قُلْ هُوَ ٱلنُّورُ"), (4, None)]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, "quote_id long, original string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    got = {r.quote_id: r.match_type for r in stream_validate(spark, f"{tmp_path}/q", corpus).collect()}
    assert got == {1: "normalized", 2: "none", 3: "exact"}
    source = spark.readStream.schema("quote_id long, original string").parquet(f"{tmp_path}/q").selectExpr("quote_id", "original AS text")
    start_validation(source, corpus, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_a_stream_for_short_verdicts_writes_no_texts(spark, tmp_path):
    rows = [(1, 1, 1, "نور بعيد قريب", "", 0, 0, 1)]
    corpus = C.prepared(spark.createDataFrame(rows, "id int, surah int, ayah int, text string, text_simple string, page int, juz int, ord int"))
    quotes = [(1, "نور بعيد قريب"), (1, "نور بعيد قريب"), (1, " نور بعيد قريب"), (2, "نور بعيد قربب"), (3, "قلم")]
    spark.createDataFrame(quotes, "quote_id long, text string").write.parquet(f"{tmp_path}/q")
    start_validation(parquet_stream(spark, f"{tmp_path}/q"), corpus, f"{tmp_path}/out", f"{tmp_path}/progress", short=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    assert got.columns == ["quote_id", "is_valid", "match_type", "confidence", "verse_id", "reference"]
    assert {(r.quote_id, r.match_type, r.reference) for r in got.collect()} == {(1, "exact", "1:1"), (2, "fuzzy", "1:1"), (3, "none", None)}
