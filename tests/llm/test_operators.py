"""The operators against brute force, with small limits so that every split happens."""

import random
from collections import Counter

import pytest

from quotelens.llm import leakage, near_duplicates, packing, shared_spans, term_counts
from quotelens.llm.records import plain_form


def texts(n, seed, words=30, longest=14):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    out = [" ".join(r.choices(vocabulary, k=r.randint(0, longest))) for _ in range(n)]
    for _ in range(n):
        t = r.choice(out).split()
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("run_rows", [4_000_000, 5])
def test_terms(spark, run_rows):
    rows = list(enumerate(texts(200, 1))) + [(900, None), (901, ""), (902, " \t"), (903, "x x x x")]
    df = spark.createDataFrame(rows + rows[:50], "rid long, t string").withColumnRenamed("t", "term")
    fields = {"one": (df, "rid", "term"), "none": (df.limit(0), "rid", "term")}
    got = {r.term: (r.field_name, r.n_occurrences, r.n_records, r.mark) for r in term_counts.term_table(fields, 2, 0.2, run_rows).collect()}
    held = [t.split() for _, t in rows if t and t.split()]
    n, m = Counter(w for t in held for w in t), Counter(w for t in held for w in set(t))
    assert got == {w: ("one", n[w], m[w], "rare" if n[w] <= 2 else "common" if m[w] > 0.2 * len(held) else None) for w in n}
    marked = {(r.term, r.mark) for r in term_counts.marked_terms(fields, 2, 0.2).collect()}
    assert marked == {(w, x[3]) for w, x in got.items() if x[3]}


def jaccard_pairs(rows, threshold, least):
    sets = [(i, set(t.split())) for i, t in rows if t]
    sets = [(i, s) for i, s in sets if len(s) >= least]
    return {(min(i, j), max(i, j)) for k, (i, s) in enumerate(sets) for j, u in sets[:k] if len(s & u) / len(s | u) >= threshold - 1e-12}


@pytest.mark.parametrize(("bits", "tile", "threshold"), [(21, 4096, 0.7), (4, 8, 0.7), (6, 64, 0.5)])
def test_near_duplicates(spark, bits, tile, threshold, monkeypatch):
    rows = list(enumerate(texts(150, 4, 60, 20))) + [(1000 + i, "a b c d e f g h i" + f" z{i % 3}") for i in range(80)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "rec_id long, plain string")
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(df, threshold, 8, bits, tile).collect()]
    assert len(got) == len(set(got))
    assert set(got) == jaccard_pairs(rows, threshold, 8)
    assert near_duplicates.near_duplicate_pairs(df.limit(0)).count() == 0


def test_large_groups_are_compared_block_by_block(spark):
    r = random.Random(8)
    rows = [(i, "rare " + " ".join(r.sample([f"c{k}" for k in range(14)], 11))) for i in range(330)]
    df = spark.createDataFrame(rows, "rec_id long, plain string")
    for tile in (4096, 100):
        assert {tuple(x) for x in near_duplicates.near_duplicate_pairs(df, 0.7, 8, 12, tile).collect()} == jaccard_pairs(rows, 0.7, 8)


def test_near_duplicate_groups(spark):
    rows = list(enumerate(texts(120, 6, 50, 16))) + [(1000, "a b c d e f g h"), (1001, "a b c d e f g h"), (1002, "h g f e d c b a")]
    pairs = jaccard_pairs(rows, 0.7, 8)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    links = Counter(x for p in pairs for x in p)
    got = {x.rec_id: (x.group_id, x.n_links) for x in near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "rec_id long, plain string")).collect()}
    assert got == {i: (root(i), links[i]) for i, t in rows if len(set(t.split())) >= 8}


def _chains(n):
    """The chain 2, 3, .., n+1, 1 and one over random ids: both are long paths."""
    r = random.Random(2)
    ids = r.sample(range(10_000, 90_000), n)
    return [*zip(range(2, n + 1), range(3, n + 2), strict=True), (n + 1, 1), *zip(ids, ids[1:])], ids


def test_components_of_long_chains_and_a_hub(spark, monkeypatch):
    from quotelens.operators import skew

    n = 1500
    links, ids = _chains(n)
    hub = [(100_000 + k, 99_999) for k in range(1000)]  # a third of all nodes on one
    rows = [(a, b) for a, b in links + hub] + [(b, a) for a, b in links + hub] + [(7_000_000, 7_000_000)]
    monkeypatch.setattr(skew.salted_join, "__defaults__", ("inner", 100, None))
    monkeypatch.setattr(skew.hot_buckets, "__defaults__", (100,))
    rounds = []
    got = {r.x: r.label for r in near_duplicates.components(spark.createDataFrame(rows, "x long, y long"), rounds.append).collect()}
    want = dict.fromkeys(range(1, n + 2), 1) | dict.fromkeys(ids, min(ids)) | {a: 99_999 for a, _ in hub} | {99_999: 99_999, 7_000_000: 7_000_000}
    assert got == want
    assert len(rounds) <= 16


@pytest.mark.parametrize("how", [{}, {"places": 2, "shard_chars": 200, "k": 5}, {"k": 11}])
def test_shared_spans(spark, how):
    r = random.Random(3)
    base = ["".join(r.choices("abcdе😀 ", k=r.randint(0, 90))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(-7, base[3] + base[4])]
    rows += [(100 + i, "".join(x[a : a + r.randint(5, 40)] for x in r.sample(base, 3) for a in [r.randrange(len(x) + 1)])) for i in range(40)]
    rows += [(200, base[0]), (201, "xyz" * 30), (202, "xyz" * 30), (203, "q" * 60), (204, None), (205, ""), (0, base[0]), (206, "ab" * 200)]
    least, cover = 12, {}
    for i, t in set(rows):
        others = [u for j, u in set(rows) if j != i and u]
        places = set()
        for k in range(len(t or "") - least + 1):
            if any(t[k : k + least] in u for u in others):
                places.update(range(k, k + least))
        cover[i] = (None if t is None else len(t), len(places))
    df = spark.createDataFrame(rows, "rec_id long, text string").withColumnRenamed("rec_id", "rec_id")
    got = {x.rec_id: (x.n_chars, x.shared_chars) for x in shared_spans.shared_shares(df, least, **({"k": 7} | how)).collect()}
    assert got == cover
    assert shared_spans.shared_shares(df.limit(0), least, k=5).count() == 0


def test_an_anchor_in_a_third_of_all_records(spark):
    """Its places are refined; the rows that search stay as many as the places."""
    r = random.Random(6)
    filler = lambda n: "".join(r.choices("abcdefgh", k=n))
    rows = [(i, filler(r.randint(0, 20)) + "the quick brown fox jumps" + filler(r.randint(0, 20))) for i in range(60)] + [(100 + i, filler(60)) for i in range(100)]
    rows += [(300 + i, filler(i % 9) + "over the quick brown fox jumps high" + filler(i % 7)) for i in range(40)] + [(500, "quick brown " * 12), (501, "quick brown " * 9)]
    least, cover = 12, {}
    for i, t in rows:
        places = set()
        for k in range(len(t) - least + 1):
            if any(t[k : k + least] in u for j, u in rows if j != i):
                places.update(range(k, k + least))
        cover[i] = (len(t), len(places))
    df = spark.createDataFrame(rows, "rec_id long, text string")
    for places in (20_000, 30, 3):
        got = {x.rec_id: (x.n_chars, x.shared_chars) for x in shared_spans.shared_shares(df, least, k=7, places=places).collect()}
        assert got == cover


def test_packing(spark):
    r = random.Random(5)
    sizes = [r.choice([1, 7, 30, 30, 30, 55, 99, 100, 101, 250, 0, -3]) for _ in range(500)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    rows = packing.pack_items(df, 100).collect()
    fill, parts = Counter(), Counter()
    for x in rows:
        fill[x.container_id] += x.part_tokens
        parts[x.doc_id] += x.part_tokens
        assert x.part_tokens <= 100
    assert max(fill.values()) <= 100
    assert parts == Counter({i: n for i, n in enumerate(sizes) if n and n > 0})
    whole = [x for x in rows if sizes[x.doc_id] <= 100]
    assert len({x.doc_id for x in whole}) == len(whole)
    assert sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.05 * sum(parts.values()) / 100 + 1
    assert packing.pack_items(df.limit(0), 100).count() == 0


def test_packing_numbers_large_lengths_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 40)
    df = spark.createDataFrame([(i, 30 if i % 2 else 45) for i in range(400)], "doc_id long, n_tokens long")
    rows = packing.pack_items(df, 100).collect()
    fill = Counter()
    for x in rows:
        fill[x.container_id] += x.part_tokens
    assert len(rows) == len({x.doc_id for x in rows}) == 400 and max(fill.values()) <= 100


def test_histogram_packing_is_exact():
    histogram = {60: 5, 40: 3, 39: 4, 20: 2, 1: 7, 100: 2}
    patterns = packing.pack_histogram(histogram, 100)
    assert Counter({n: sum(p.count(n) * c for p, c in patterns) for n in histogram}) == Counter(histogram)
    assert all(sum(p) <= 100 for p, _ in patterns)
    with pytest.raises(ValueError):
        packing.pack_histogram({101: 1}, 100)


def test_tokens_of_blank_texts(spark):
    df = spark.createDataFrame([(1, "The court notes."), (2, "  \n"), (3, None), (4, "")], "doc_id long, text string")
    assert [(r.doc_id, r.n_tokens) for r in packing.token_counts(df).collect()] == [(1, 4)]


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"


def test_leaks(spark):
    w = ITEM.split()
    docs = [
        (1, "x " + " ".join(w[:16]) + " y"), (2, " ".join(w[:15]) + " y"), (3, "​".join(ITEM.upper()) + "."), (4, ITEM.replace("seven ", "sev-\nen ")), (5, " ".join(w[:8] + ["header"] + w[8:])),
        (6, None), (7, ""), (8, "Ｏｎｅ，" + " ".join(w[1:]).replace(" ", " — ")), (9, ITEM.replace("eight", "eight page 2")), (1, "x " + " ".join(w[:16]) + " y"), (10, ("filler " * 3000) + " ".join(w[2:])),
        (11, " ".join(w[1:17])), (12, " ".join(w[:12]) + " " + " ".join(w[6:])),
    ]
    items = [(1, ITEM), (2, " ".join(w[1:] + ["nineteen"])), (3, "short item"), (4, None), (1, ITEM)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, item_text string")
    for bits in (26, 6):  # the smallest map is full of bits
        got = {tuple(r) for r in leakage.leaked_items(d, i, filter_bits=bits).collect()}
        assert got == {(1, 1), (3, 1), (3, 2), (4, 1), (4, 2), (8, 1), (8, 2), (10, 1), (10, 2), (11, 1), (11, 2)}
    folded = spark.createDataFrame([(1, "\ufdfa " * 4)], "doc_id long, text string")  # four characters, more words
    words = spark.createDataFrame([(1, "\ufdfa \ufdfa \ufdfa \ufdfa")], "item_id int, item_text string")
    assert leakage.leaked_items(folded, words, min_words=12).count() == 1
    assert leakage.leaked_items(d, i.limit(0)).count() == 0 and leakage.leaked_items(d.limit(0), i).count() == 0
    with pytest.raises(ValueError):
        leakage.leaked_items(d, i, min_words=4)


def test_leaks_equal_brute_force(spark):
    r = random.Random(9)
    words = [f"v{k}" for k in range(6)]
    docs = [(k, " ".join(r.choices(words, k=r.randint(0, 60)))) for k in range(120)]
    items = [(k, " ".join(r.choices(words, k=r.randint(3, 20)))) for k in range(60)] + [(99, docs[5][1])]
    want = set()
    for i, t in items:
        w = t.split()
        for a in range(len(w) - 6):
            run = f" {' '.join(w[a : a + 7])} "
            want |= {(d, i) for d, x in docs if run in f" {x} "}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, item_text string")
    assert {tuple(x) for x in leakage.leaked_items(d, i, min_words=7).collect()} == want


def test_plain_form(spark):
    df = spark.createDataFrame([("قُلْ هُوَ  أَحَدٌ ۝",), (None,)], "t string")
    assert [r[0] for r in df.select(plain_form(df.t)).collect()] == ["قل هو احد", None]
