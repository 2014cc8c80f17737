import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quotelens.llm import house_form as H
from quotelens.llm import lookalikes


def test_same_look_same_form():
    same = [
        ("ﻛِﺘَﺎب", "كِتَاب"), ("کتاب", "كتاب"), ("ھو", "هو"), ("یوم", "يوم"), ("علی", "على"), ("علی كل", "على كل"), ("بَیْتِی", "بَيْتِى"), ("أَ", "أَ"), ("ؤ", "ؤ"),
        ("ىٔ", "ئ"), ("a​b­c", "abc"), ("a  　b", "a b"), (" a\n", "a"), ("Ｑāｆ", "Qāf"), ("ṣ", "ṣ"), ("ạ̄", "ạ̄"), ("ѕаϳ", "saj"), ("һо", "ho"),
        ("ـَّ", "ـ" + unicodedata.normalize("NFC", "َّ")), ("", ""), ("‏⁦", ""), ("ﷲ", "الله"), ("ѕ̣", "ṣ"),
    ]
    for given_, want in same:
        assert H.house_form(given_) == unicodedata.normalize("NFC", want), (given_, want)
    assert H.house_form(None) is None


def test_what_can_be_seen_stays():
    for t in ["أ", "ا", "ى", "ي", "ة", "ه", "ـ", "بَ", "A", "a", "،", "﴾x﴿", "x۝", "ؤ", "ء", "(a)", "s", "ṣ"]:
        assert H.house_form(t) == t
    plain = "قُلْ هُوَ"
    assert H.house_form(plain) is plain


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ابهیىيکوٱ" + "َُّٰٕٔ" + "asѕāu ̣̄​ ＱﻛﻼﺎـーA")))
def test_idempotent_and_canonical(t):
    h = H.house_form(t)
    assert H.house_form(h) == h
    assert unicodedata.is_normalized("NFC", h)
    assert "  " not in h and h == h.strip(" ")
    # Unstable characters anywhere in the text don't change how the rest is written.
    assert H.house_form(f"قلب {t} قلب").startswith("قلب") and H.house_form(f"قلب {t} قلب").endswith("قلب")


def test_pairs(spark):
    six = "قُلْ هُوَ يَوْمٌ كَبِيرٌ فِي ٱلأَرْضِ"
    alike = six.replace("ك", "ک").replace(" ", " ")
    verses = [(1, six, "قل", "x"), (2, alike, None, "y"), (3, six, "قل", "z"), (1, six, "قل", "x"), (4, "قُلْ", "قل", "short")]
    quotes = [(10, six + "‏", 1), (11, six, 2), (12, "قُلْ", 3), (13, None, 4), (10, six + "‏", 5), (14, "", 6)]
    processed = [(20, 1, "قل"), (21, None, six), (22, 9, six)]
    v = spark.createDataFrame(verses, "id int, text string, text_simple string, k1 string")
    q = spark.createDataFrame(quotes, "quote_id long, original string, scope int")
    p = spark.createDataFrame(processed, "proc_id long, id int, text_simple string")
    got = sorted(map(tuple, lookalikes.lookalike_pairs(v, q, p).collect()))
    assert got == [(1, 2), (1, 10), (2, 3), (2, 10), (2, 11), (3, 10)]
    assert lookalikes.lookalike_pairs(v.limit(0), q, p).count() == 0
    simple = spark.createDataFrame([(1, None, six)], "id int, text string, text_simple string")
    done = spark.createDataFrame([(20, 1, alike), (21, 2, alike), (22, 1, six)], "proc_id long, id int, text_simple string")
    assert [tuple(r) for r in lookalikes.lookalike_pairs(simple, q.limit(0), done).collect()] == [(1, 20)]


def test_column_form(spark):
    df = spark.createDataFrame([(1, "کa"), (2, None)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(H.house_form_col(F.col("t"))).collect()] == ["كa", None]


def test_decomposed_spelling_equals_composed():
    """Of every composed character of the basic plane, Hangul syllables among them."""
    for cp in [*range(0xD800), *range(0xE000, 0x10000)]:
        c = chr(cp)
        parts = unicodedata.normalize("NFD", c)
        if parts != c:
            want = H.house_form(c)
            assert H.house_form(parts) == want == H.house_form(unicodedata.normalize("NFC", c)), hex(cp)
            assert H.house_form(f"1{parts}1") == H.house_form(f"1{c}1"), hex(cp)
    word = "한국어 각 말"
    assert H.house_form(unicodedata.normalize("NFD", word)) == H.house_form(word) == word


def test_accented_look_alikes():
    for given_, want in [("ёж", "ëж"), ("Ї", "Ï"), ("Ά", "Á"), ("ό", "ó"), ("ꓮꓐ", "AB"), ("Ⅳ", "Ⅳ"), ("Ⅹ", "X")]:
        assert H.house_form(given_) == want
