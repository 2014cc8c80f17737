import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotelens.operators import lookup, match
from quotelens.operators.distance import distances, padded
from quotelens.operators.skew import salted_join
from quotelens.options import ValidatorOptions
from quotelens.plans import runtime
from quotelens.plans.runtime import materialize, materialize_packed, release
from quotelens.sources.corpus import prepared
from tests import spec

WORDS = "نور بعيد قريب سماء ارض طويل حساب جميع يوم ناس كتاب قلم بحر جبل ريح".split()


def verses(n=40, seed=1):
    r = random.Random(seed)
    rows = [(i, (i - 1) // 10 + 1, (i - 1) % 10 + 1, " ".join(r.choices(WORDS, k=r.randint(1, 7)))) for i in range(1, n + 1)]
    return [*rows, (n + 1, 9, 1, rows[0][3]), (n + 2, 9, 2, "نُورٌ بَعِيدٌ وَقَرِيبٌ مِنَ ٱلأَرْضِ")]


def corpus_of(spark, rows):
    return prepared(spark.createDataFrame([(*r, r[3], r[0]) for r in rows], "id int, surah int, ayah int, text string, text_simple string, ord int"))


def quotes(rows, n=150, seed=2):
    r = random.Random(seed)
    out = ["", "abc", "َ", "﻿abc", rows[-1][3], "نور بعيد وقريب من الارض", " " + rows[3][3] + "\xa0", "ن", "نو", None]
    for _ in range(n):
        t = list(r.choice(rows)[3])
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randint(0, 1)] = r.choice(["", "ب", "م", " ", "ُ"])
        out.append("".join(t))
    return out


@pytest.mark.parametrize("partial", [True, False])
def test_cascade_equals_the_statement(spark, partial):
    rows = verses()
    texts = quotes(rows)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r for r in match.validate(df, corpus_of(spark, rows), ValidatorOptions(include_partial=partial)).collect()}
    listed = [(f"{s}:{a}", t) for _, s, a, t in rows]
    for k, t in enumerate(texts):
        r = got[k]
        if t is None:
            assert r.is_valid is None and r.match_type is None and r.differences == []
            continue
        kind, conf, v = spec.validate(t, listed, partial=partial)
        assert (r.match_type, r.reference, r.is_valid) == (kind, v and v[0], v is not None), t
        assert r.confidence == pytest.approx(conf)
        assert [(d.input, d.correct, d.position) for d in r.differences] == (spec.differences(t.strip(), v[1]) if v and kind != "exact" else [])


def test_fuzzy_loses_nothing_and_ranks_suggestions(spark):
    rows = verses(60, 5)
    texts = sorted({spec.norm(t) for t in quotes(rows, 120, 7) if t} - {""})
    df = spark.createDataFrame([(t,) for t in texts], "nq string")
    for threshold in (0.8, 0.6):
        got = {r.nq: r for r in match.fuzzy_matches(df, corpus_of(spark, rows), ValidatorOptions(fuzzy_threshold=threshold)).collect()}
        for t in texts:
            ranked = sorted(((spec.sim(t, spec.norm(v[3])), -v[0]) for v in rows), reverse=True)
            want = [(-i, s) for s, i in ranked if s >= threshold * 0.9][:3] if ranked[0][0] >= threshold else None
            assert (want is None) == (t not in got), t
            if want:
                assert [s.verse_id for s in got[t].suggestions] == [i for i, _ in want]
                assert [s.confidence for s in got[t].suggestions] == pytest.approx([s for _, s in want])


@pytest.mark.parametrize(("tile", "tile_pairs"), [(50_000, 2_000_000), (3, 10)])
def test_containment_in_tiles(spark, tile, tile_pairs):
    """One n-gram in more than a third of all texts, on both sides."""
    r = random.Random(11)
    hays = sorted({"نور " * r.randint(0, 1) + " ".join(r.choices(WORDS, k=4)) for _ in range(120)} | {"ن", "نو"})
    needles = sorted({h[a : a + r.randint(1, 9)] for h in hays for a in [r.randrange(len(h))]} | {"نور", "ن", "نو", "ظظظ"})
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((needles, "needle"), (hays, "hay"))]
    got = [tuple(x) for x in match.contained_pairs(*frames, tile, tile_pairs).collect()]
    assert sorted(got) == sorted((n, h) for n in needles for h in hays if n in h)
    assert match.contained_pairs(frames[0].limit(0), frames[1]).count() == match.contained_pairs(frames[0], frames[1].limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.9, 0.75, 0.5, 0.35])
def test_similar_pairs_lose_nothing(spark, threshold):
    r = random.Random(13)
    left = sorted({"".join(r.choices("ابت ", k=r.randint(1, 14))) for _ in range(60)})
    right = sorted({"".join(r.choices("ابت ", k=r.randint(1, 14))) for _ in range(60)} | set(left[:9]))
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((left, "q"), (right, "norm"))]
    got = sorted((x.q, x.norm) for x in match.similar_pairs(*frames, threshold).collect())
    assert got == sorted((a, b) for a in left for b in right if spec.sim(a, b) >= threshold)
    with pytest.raises(ValueError):
        match.similar_pairs(*frames, 0.5, 3)


def test_a_verse_like_a_third_of_all_texts(spark, monkeypatch):
    from quotelens.operators import skew

    r = random.Random(17)
    verse = "نور بعيد قريب سماء ارض طويل"
    left = sorted({verse[:k] + c + verse[k + 1 :] for k in range(len(verse)) for c in "بتث"} | {" ".join(r.choices(WORDS, k=5)) for _ in range(160)})
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((left, "q"), ([verse, "قلم بحر"], "norm"))]
    monkeypatch.setattr(skew.hot_buckets, "__defaults__", (10,))
    got = sorted((x.q, x.norm) for x in match.similar_pairs(*frames, 0.8).collect())
    assert got == sorted((a, b) for a in left for b in (verse, "قلم بحر") if spec.sim(a, b) >= 0.8)


def test_distances_equal_the_statement():
    r = random.Random(1)
    for _ in range(40):
        texts = sorted(("".join(r.choices("abcd😀", k=r.randint(0, 150))) for _ in range(8)), key=len)
        symbols, sizes = padded(texts)
        alphabet = np.unique(symbols)
        p = "".join(r.choices("abcde", k=r.choice([0, 1, 5, 63, 64, 65, 128, 130])))
        assert distances(p, np.searchsorted(alphabet, symbols), sizes, alphabet).tolist() == [spec.distance(p, t) for t in texts]


def test_search_and_empty_corpus(spark):
    rows = verses(30, 3)
    asked = spark.createDataFrame([(1, rows[4][3]), (2, "ظظظظظظظظ"), (3, None)], "qid int, query string")
    got = lookup.search(asked, corpus_of(spark, rows), 4).orderBy("qid", "rank").collect()
    ranked = sorted(((-spec.sim(spec.norm(rows[4][3]), spec.norm(v[3])), v[0]) for v in rows))[:4]
    assert [(r.id, r.qid) for r in got] == [(i, 1) for s, i in ranked if -s > 0.3]
    none = corpus_of(spark, verses()).limit(0)
    r = match.validate(spark.createDataFrame([(1, "نور")], "k int, text string"), none).collect()[0]
    assert r.match_type == "none" and r.confidence == 0.0
    with pytest.raises(ValueError):
        lookup.search(asked, none, -1)


def test_search_in_small_tables_of_characters(spark, monkeypatch):
    rows = [*verses(30, 3), (50, 9, 3, "قلم " * 300), (51, 9, 4, "")]
    asked = spark.createDataFrame([(k, rows[k][3]) for k in (4, 9, 32)] + [(99, "")], "qid int, query string")
    want = {(k, v[0]) for k, q in [(k, rows[k][3]) for k in (4, 9, 32)] + [(99, "")] for v in rows if spec.sim(spec.norm(q), spec.norm(v[3])) > 0.3}
    for cells in (lookup.CELLS, 50):
        monkeypatch.setattr(lookup, "CELLS", cells)
        block = lookup._search_block(pa.table({"q": [spec.norm(rows[4][3])]}), pa.table({"id": [v[0] for v in rows], "surah": [1] * len(rows), "ayah": [1] * len(rows), "ord": [v[0] for v in rows], "norm": [spec.norm(v[3]) for v in rows]}), 100, 0.3)
        assert set(block.column("id").to_pylist()) == {i for k, i in want if k == 4}
    assert {(r.qid, r.id) for r in lookup.search(asked, corpus_of(spark, rows), 100).collect()} == want


def test_search_compares_in_the_jvm_as_stated(spark, monkeypatch):
    r = random.Random(23)
    scripts = ("ابت ", "abṣ ", "ا😀بab")
    some = lambda: spec.norm("".join(r.choices(r.choice(scripts), k=r.choice([1, 5, 20, 63, 64, 65, 90, 127, 128, 129, 200]))))
    texts = [*(some() for _ in range(36)), "", *[spec.norm("ابت " * 12)] * 2]
    rows = [(k, 1, k, t) for k, t in enumerate(texts, 1)]
    asked = [*(some() for _ in range(14)), *("".join(r.choice("ابت") if r.random() < 0.2 else c for c in t) for t in texts[:12]), "", texts[-1]]
    frame = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    monkeypatch.setattr(lookup, "QUERIES", 9)
    monkeypatch.setattr(lookup, "TEXTS", 14)
    for limit, floor in ((3, 0.3), (100, 0.0)):
        got = lookup.search(frame, corpus_of(spark, rows), limit, floor)
        assert "python" not in (plan := got._jdf.queryExecution().toString().lower()) and "arrow" not in plan
        want = []
        for k, q in enumerate(asked):
            ranked = sorted((-spec.sim(spec.norm(q), t), i) for i, _, _, t in rows)
            want += [(k, n, i, -s) for n, (s, i) in enumerate([x for x in ranked if -x[0] > floor][:limit], 1)]
        assert sorted((x.qid, x["rank"], x.id, x.similarity) for x in got.collect()) == want


def test_ranges_and_lookups(spark):
    rows = verses()
    corpus = corpus_of(spark, rows)
    asked = spark.createDataFrame([(1, 1, 3), (1, 3, 1), (1, 9, 12), (None, 1, 1), (1, 1, 3), (9, 2, 2)], "surah int, start_ayah int, end_ayah int")
    got = {(r.surah, r.start_ayah): (r.text, list(r.verse_ids)) for r in lookup.verse_ranges(asked, corpus).collect()}
    assert got == {(1, 1): (" ".join(v[3] for v in rows[:3]), [1, 2, 3]), (9, 2): (rows[-1][3], [42])}
    found = lookup.get_verses(spark.createDataFrame([(1, 2, 7), (5, 5, 8)], "surah int, ayah int, tag int"), corpus).orderBy("tag").collect()
    assert [(r.id, r.tag) for r in found] == [(2, 7), (None, 8)]
    assert [r.ayah for r in lookup.surah_verses(corpus, 9).collect()] == [1, 2]


def test_marked_text_with_extra_columns(spark):
    """Columns of the caller that clash with the operator's own names survive."""
    rows = verses()
    df = spark.createDataFrame([(1, rows[0][3], "x", 5, 0.1, "old", {"a": 1})], "k int, text string, q string, surah int, confidence double, v string, m map<string,int>")
    r = match.validate(df, corpus_of(spark, rows)).select("k", "q", "surah", "v", "match_type", "confidence", F.size("suggestions").alias("n")).collect()[0]
    assert tuple(r) == (1, "x", 5, "old", "exact", 1.0, 0)
    many = df.unionAll(df).crossJoin(spark.range(400)).select("k", "text", "m")
    assert match.validate(many, corpus_of(spark, rows), with_differences=False).where("is_valid").count() == 800


def test_shuffle_files_of_a_finished_step_are_removed(spark):
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    release(spark)
    time.sleep(1)
    before = kept.size()
    for k in range(3):
        assert materialize(spark.range(1000).groupBy((F.col("id") % (7 + k)).alias("m")).count()).count() == 7 + k
    release(spark)
    time.sleep(1)
    assert kept.size() <= before + 1  # the last count


def test_packed_tables_read_back_whole_and_small(spark):
    rows = [(k, None if k % 5 == 0 else "نور بعيد " * 40, [(k, None), (None, "ب")] if k % 3 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, t string, a array<struct<x:int,y:string>>")
    got = materialize_packed(df)
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert materialize_packed(df.limit(0)).collect() == []
    assert sum(len(r.rows) for r in df.mapInArrow(runtime._packed, "rows binary").collect()) < 3000 * 100


def test_equal_rows_count_once_in_the_shuffle_of_a_join(spark):
    big = spark.createDataFrame([(k % 40, "a" if k % 4 else "b") for k in range(400)], "id int, k string")
    small = spark.createDataFrame([("a", 1)], "k string, v int")
    want = sorted((k % 40, 1 if k % 4 else None) for k in range(40))
    for rows in (10, 1000):
        got = salted_join(big, small, ["k"], "left", rows_per_part=rows, distinct=True)
        assert sorted((r.id, r.v) for r in got.collect()) == sorted(want)
        assert len(re.findall("Exchange hash", got._jdf.queryExecution().executedPlan().initialPlan().toString())) <= 2


def test_validation_of_distinct_rows(spark):
    rows = verses()
    df = spark.createDataFrame([(1, rows[0][3]), (1, rows[0][3]), (2, rows[0][3])], "k int, text string")
    got = match.validate(df, corpus_of(spark, rows), with_differences=False, distinct=True).collect()
    assert sorted((r.k, r.match_type) for r in got) == [(1, "exact"), (2, "exact")]


@pytest.mark.parametrize("partial", [True, False])
def test_verdicts_without_suggestions_and_texts(spark, partial, monkeypatch):
    rows = verses(60, 5)
    df = spark.createDataFrame(list(enumerate([*quotes(rows), rows[3][3] + " "])), "k int, text string")
    opts, shown = ValidatorOptions(include_partial=partial), ("k", "text", "is_valid", "match_type", "confidence", "verse_id", "reference")
    want = match.validate(df, corpus_of(spark, rows), opts).select(*shown).collect()
    asked, similar = [], match.similar_pairs
    monkeypatch.setattr(match, "similar_pairs", lambda a, b, threshold: asked.append(threshold) or similar(a, b, threshold))
    got = match.validate(df, corpus_of(spark, rows), opts, distinct=True, with_suggestions=False, with_text=False)
    assert got.columns == list(shown) and asked == [opts.fuzzy_threshold]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want)) and any(r.match_type == "fuzzy" for r in want)
