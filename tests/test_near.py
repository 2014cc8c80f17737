import random

import pytest

from quotelens.operators import match, near
from tests import spec


def texts(n, seed, letters="ابتثجح "):
    r = random.Random(seed)
    return sorted({"".join(r.choices(letters, k=r.randint(1, 40))) for _ in range(n)}, key=len)


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.72, 0.5])
def test_near_pairs_lose_nothing_and_give_few_others(threshold):
    r = random.Random(3)
    left = texts(80, 1)
    changed = {"".join(r.choice("ابت") if r.random() < 0.12 else c for c in t) for t in left}
    right = sorted(changed | set(texts(80, 2)) | {"ا" * 300, "ا" * 290 + "بب"}, key=len)
    left = sorted({*left, "ا" * 299 + "ت"}, key=len)
    got = {(left[i], right[j]) for a, b in near.near_pairs(left, right, threshold) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert {(a, b) for a in left for b in right if spec.sim(a, b) >= threshold} <= got
    assert len(got) < len(left) * len(right) / (50 if threshold >= 0.8 else 2)


def test_similar_pairs_write_no_candidates(spark, monkeypatch):
    left, right = texts(60, 5, "ابت"), texts(60, 6, "ابت")
    frames = [spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((left, "q"), (right, "norm"))]

    def refuse(df):
        raise AssertionError("candidates are written")

    monkeypatch.setattr(match, "materialize", refuse)
    monkeypatch.setattr(match, "LEAST_WORK", 2_000)
    monkeypatch.setattr(match, "BLOCK_CHARS", 300)
    got = sorted((x.q, x.norm) for x in match.similar_pairs(*frames, 0.7).collect())
    assert got == sorted((a, b) for a in left for b in right if spec.sim(a, b) >= 0.7)


@pytest.mark.parametrize("letters", ["ابتثجح ", "اب"])
def test_first_contained_equals_all_pairs(letters):
    r = random.Random(9)
    known = list(dict.fromkeys(texts(70, 7, letters) + ["ا", "بت", "اب"]))
    r.shuffle(known)
    asked = sorted({k[a : a + r.randint(1, 9)] for k in known for a in [r.randrange(len(k))]} | {"ت" + r.choice(known) + "ب" for _ in range(40)} | {"ظ", "ظظ", "ظظظظ"} | set(texts(40, 8, letters)))
    want = [(i, *min(((k, t not in v) for k, v in enumerate(known) if t in v or v in t), default=(None, None))) for i, t in enumerate(asked)]
    got = {i: (k, inside) for i, k, inside in near.first_contained(asked, known)}
    assert got == {i: (k, not around) for i, k, around in want if k is not None}


def test_containment_writes_no_candidates(spark, monkeypatch):
    rows = [(k, 1, k, t) for k, t in enumerate(texts(60, 4, "ابت"), 1)]
    corpus = spark.createDataFrame([(*x, x[3], x[0]) for x in rows], "id int, surah int, ayah int, text string, norm string, ord int")
    asked = sorted({x[3][1:6] for x in rows} - {""} | {"ت" + x[3] for x in rows})

    def refuse(df):
        raise AssertionError("candidates are written")

    monkeypatch.setattr(match, "materialize", refuse)
    monkeypatch.setattr(match, "BLOCK_CHARS", 300)
    got = {r.nq: r.v.ord for r in match.partial_matches(spark.createDataFrame([(t,) for t in asked], "nq string"), corpus).select("nq", "v").collect()}
    assert got == {t: min(x[0] for x in rows if t in x[3] or x[3] in t) for t in asked if any(t in x[3] or x[3] in t for x in rows)}
