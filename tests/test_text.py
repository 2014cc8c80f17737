import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotelens.chars import BLANKS
from quotelens.functions import text as T
from quotelens.functions.register import register
from quotelens.options import INDEX_OPTIONS, NormalizationOptions
from tests import spec

LETTERS = "ابتثكلمنهويأإآٱىةؤئءـ" + "ًٌٍَُِّْٰۭٕۖ" + "؀؛،٣﴿﴾﻿"
TEXTS = st.lists(st.text(st.sampled_from(LETTERS + BLANKS + "abZ19(:-)😀​"), max_size=14), min_size=1, max_size=25)
RELAXED = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, texts, value):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.v for r in df.select("k", value(F.col("t")).alias("v")).orderBy("k").collect()]


def test_examples(spark):
    assert column(spark, ["بِسْمِ اللَّهِ", "الرَّحْمَٰنِ", None, ""], T.normalize_arabic) == ["بسم الله", "الرحمن", None, ""]
    assert column(spark, ["السَّلَامُ عَلَيْكُمُ"], T.remove_diacritics) == ["السلام عليكم"]
    assert column(spark, ["Hello مرحبا", "Hello", "﻿x", None], T.contains_arabic) == [True, False, True, None]
    assert column(spark, ["﻿a​b"], T.clean_text) == ["ab"]
    assert column(spark, [" قل ٣ هو ١٢ "], T.strip_arabic_digits) == ["قل  هو"]
    kept = lambda c: T.normalize_arabic(c, INDEX_OPTIONS)
    assert column(spark, ["أَـة "], kept) == ["اَـه"]
    nothing = NormalizationOptions(*[False] * 7)
    assert column(spark, [" أ  ة "], lambda c: T.normalize_arabic(c, nothing)) == [" أ  ة "]


@RELAXED
@given(TEXTS)
def test_normalization_equals_statement_and_is_idempotent(spark, texts):
    once = column(spark, texts, T.normalize_arabic)
    assert once == [spec.norm(t) for t in texts]
    assert column(spark, once, T.normalize_arabic) == once


@RELAXED
@given(TEXTS)
def test_segments_slice_back(spark, texts):
    import re

    got = column(spark, texts, T.arabic_segments)
    for t, segments in zip(texts, got, strict=True):
        want = [(m[0].strip(), m.start(), m.end()) for m in re.finditer(f"[{spec.A}][{spec.A}\\s]*", t)]
        assert [(s.text, s.start, s.end) for s in segments] == [w for w in want if w[0]]
        assert all(t[s.start : s.end].strip() == s.text for s in segments)


@RELAXED
@given(st.lists(st.tuples(st.text("ابc😀", max_size=9), st.text("ابc😀", max_size=9)), min_size=1, max_size=20))
def test_similarity_and_differences(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, a string, b string")
    rows = df.select("k", T.similarity(F.col("a"), F.col("b")).alias("s"), T.similarity(F.col("b"), F.col("a")).alias("r"), T.find_differences(F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()
    for (a, b), r in zip(pairs, rows, strict=True):
        assert abs(r.s - spec.sim(a, b)) < 1e-12 and r.s == r.r
        assert [(d.input, d.correct, d.position) for d in r.d] == spec.differences(a, b)


def test_references(spark):
    got = column(spark, ["2:255", "2:1-3", "٢:٣", "1:1\n", "1:1\n\n", "a1:1", "1:1-", "1:1-0", None, "999999999999999999999:1"], T.parse_reference)
    shown = [r and (r.surah, r.start_ayah, r.end_ayah, r.is_range) for r in got]
    assert shown == [(2, 255, None, False), (2, 1, 3, True), (2, 3, None, False), (1, 1, None, False), None, None, None, (1, 1, 0, True), None, (None, 1, None, False)]


def test_replace_first_and_percent(spark):
    df = spark.createDataFrame([("abab", "b", "X"), ("abab", "c", "X"), ("ab", "", "X"), ("😀b", "b", "c")], "t string, o string, n string")
    assert [r[0] for r in df.select(T.replace_first(F.col("t"), F.col("o"), F.col("n"))).collect()] == ["aXab", "abab", "Xab", "😀c"]
    assert [r[0] for r in spark.createDataFrame([(0.865,), (0.9,)], "x double").select(T.percent(F.col("x"))).collect()] == ["86", "90"]


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT normalize_arabic('  بِسْمِ   ٱللَّهِ ') n, remove_diacritics('قُلْ') d, contains_arabic('x') c, text_similarity('ab', 'ac') s").collect()[0]
    assert tuple(r) == ("بسم الله", "قل", False, 0.5)
    rows = spark.sql("SELECT s.* FROM (VALUES ('a قل هو b')) t(x), LATERAL arabic_segments(x) s").collect()
    assert [tuple(x) for x in rows] == [("قل هو", 2, 8)]
    assert unicodedata.normalize("NFC", "é") == "é"
