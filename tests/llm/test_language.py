import random
from collections import Counter

import numpy as np
import pytest

from quotelens.llm import language

SAMPLES = [
    ("en", "The court notes that the witnesses described the boundary in the same manner and that the costs follow the event. " * 3),
    ("de", "Das Gericht stellt fest, dass die Zeugen die Grenze auf die gleiche Weise beschrieben haben und die Kosten trägt die unterlegene Partei. " * 3),
    ("fr", "La cour relève que les témoins ont décrit la limite de la même façon et les dépens suivent le sort du principal. " * 3),
]
EN = "The witnesses described the costs of the boundary in the same manner and the court notes that the event follows in the same way as before."
DE = "Die Zeugen haben die Grenze auf die gleiche Weise beschrieben und das Gericht stellt fest, dass die unterlegene Partei die Kosten der Sache trägt."


@pytest.fixture(scope="module")
def prof():
    return language.Profiles(SAMPLES)


def test_passages_and_labels(spark, prof):
    rows = [
        (1, EN, "en-GB"), (2, EN, "German"), (3, EN + "\n" + DE, "en"), (4, None, None), (5, " \n ", "en"), (6, DE, None),
        (7, DE, "DEU"), (8, EN + " («Die Kosten trägt die Partei.»)", "EN"), (9, DE, ""), (10, EN * 400, "fr"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {tuple(r) for r in language.mislabelled(docs, prof).collect()}
    assert got == {(2, "en"), (3, "en"), (3, "de"), (6, "de"), (9, "de"), (10, "en")}


def test_runs_cover_whole_text_and_keep_columns(spark, prof):
    docs = spark.createDataFrame([(1, EN + "\n" + DE + "\n" + EN, "x", "clash")], "doc_id long, text string, lang string, segment string")
    runs = language.language_runs(docs, prof).orderBy("segment").collect()
    assert [r.seg_lang for r in runs] == ["en", "de", "en"]
    assert [r.first_word for r in runs] == [0, runs[0].n_words, runs[0].n_words + runs[1].n_words]
    assert all(0 <= r.confidence <= 1 and r.lang == "x" for r in runs)


def test_empty_table_and_no_profiles(spark, prof):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.mislabelled(docs, prof).count() == 0
    one = spark.createDataFrame([(1, EN, "en")], "doc_id long, text string, lang string")
    assert language.mislabelled(one, language.Profiles([])).count() == 0


def test_held_out_accuracy(spark):
    """Profiles of half the samples name the other half."""
    rows = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet").orderBy("sample_id").collect()
    prof = language.Profiles([(r.sample_lang, r.sample_text) for r in rows if r.sample_id % 2])
    test = [r for r in rows if not r.sample_id % 2 and len(r.sample_text.split()) >= 20]
    got = language.classify([r.sample_text for r in test], prof, language.word_caches(prof))
    right = sum(bool(g) and max(g, key=lambda x: x[1])[2] == r.sample_lang for g, r in zip(got, test, strict=True))
    assert right >= 0.98 * len(test)


def plain_distances(text, prof, lists):
    """Out-of-place distance of a text to each language, n-gram by n-gram."""
    counts = Counter(g for w in language.tokens(text) if w[0].isalpha() for g in language.ngrams(w) if g in prof.grams)
    own = sorted(counts, key=lambda g: (-counts[g], prof.grams[g]))[: language.RANKS]
    gaps = [[abs(ranks.index(g) - r) if g in ranks else language.PROFILE for r, g in enumerate(own)] for ranks in lists]
    return [sum(x) / (max(len(own), 1) * language.PROFILE) for x in gaps]


def test_distance_with_many_profiles():
    """More n-grams than twelve bits can number, and more of one than nineteen can count."""
    r = random.Random(4)
    samples = []
    for k in range(20):
        letters = [chr(0x5000 + 18 * k + i) for i in range(18)]
        samples.append((f"l{k:02}", " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(400))))
    prof = language.Profiles(samples)
    assert len(prof.grams) > 4096
    lists = [[g for g, _ in sorted(prof.grams.items(), key=lambda kv: row[kv[1]]) if row[prof.grams[g]] < language.PROFILE] for row in prof.ranks]
    texts = [samples[k][1][200 * k % 900 :][:400] for k in range(20)] + [(samples[3][1][:7] + " ") * 300_000]
    cache = language.word_caches(prof)[1]
    for t in texts:
        words = np.fromiter(map(cache.__getitem__, language.tokens(t)), np.int64)
        got = language._distances(words, np.zeros(len(words), np.int64), 1, cache.table, prof)[0]
        assert got == pytest.approx(plain_distances(t, prof, lists))
    found = language.classify(texts[:20], prof, language.word_caches(prof))
    assert [max(x, key=lambda run: run[1])[2] for x in found] == prof.languages


AR = "قَالَ ٱلقَاضِي إِنَّ ٱلشُّهُودَ وَصَفُوا ٱلحُدُودَ عَلَى ٱلنَّحْوِ نَفْسِهِ وَإِنَّ ٱلنَّفَقَاتِ عَلَى ٱلطَّرَفِ ٱلخَاسِرِ فِي ٱلدَّعْوَى "


def test_scripts_without_case_title_case_and_short_texts(spark):
    prof = language.Profiles([*SAMPLES, ("ar", AR * 4)])
    assert prof.languages == ["ar", "de", "en", "fr"]
    short = "the boundary and the costs of the same manner are noted"
    rows = [(1, AR * 3, None), (2, EN.title(), None), (3, short, None), (4, "漢字 仮名", None), (5, "Gericht", None), (6, "1 2 3", None), (7, EN.upper(), None), (8, "", None), (9, AR.translate(dict.fromkeys(range(0x64B, 0x653))), "ar")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.seg_lang, r.n_words) for r in language.language_runs(docs, prof).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "ar", 2: "en", 3: "en", 4: "und", 5: "de", 7: "en", 9: "ar"}
    assert got[3][1] == len(short.split()) < language.RUN_WORDS
    assert {r.doc_id for r in language.mislabelled(docs, prof).collect()} == {1, 2, 7}
