import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotelens.operators import orphans
from quotelens.operators.skew import hot_buckets, salted_join

T0 = dt.datetime(2024, 1, 1)


def at(days):
    return T0 + dt.timedelta(days=days)


@pytest.fixture(scope="module")
def tables(spark):
    surahs = spark.createDataFrame([(1, 3), (1, 3), (2, 2)], "number int, verses_count int")
    verses = spark.createDataFrame(
        [(1, 1, at(0), None), (1, 2, at(0), at(10)), (1, 2, at(5), at(10)), (2, 1, at(20), None)],
        "surah int, ayah int, loaded_at timestamp, removed_at timestamp",
    )
    return surahs, verses


def test_reference_spellings(spark):
    texts = ["2:3", " 2 : 3 ", "２：３", "٢:٣-٤", "2:3–5", "2​:3‏", "۱۲:۳", "2.3", "2:", "", None, "Surah 2", "2:3-", "0002:3", "9" * 30 + ":1"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [r.r and tuple(r.r) for r in df.select("k", orphans.reference_parts(F.col("t")).alias("r")).orderBy("k").collect()]
    assert got == [(2, 3, None), (2, 3, None), (2, 3, None), (2, 3, 4), (2, 3, 5), (2, 3, None), (12, 3, None), None, None, None, None, None, None, (2, 3, None), (10**17, 1, None)]


def test_kinds(spark, tables):
    rows = [
        ("q", 1, 1, 1, None, at(1)), ("q", 2, 7, 1, None, at(1)), ("q", 3, 1, 4, None, at(1)), ("q", 4, 1, 0, None, at(1)), ("q", 5, 1, 3, None, at(1)),
        ("q", 6, 1, 1, 2, at(10)), ("q", 7, 1, 1, 2, at(9)), ("q", 8, 2, 1, None, at(19)), ("q", 9, 2, 1, None, at(20)), ("q", 10, None, 1, None, at(1)),
        ("q", 11, 1, None, None, at(1)), ("q", 12, 1, 2, 1, at(1)), ("q", 13, 7, 1, None, None), ("q", 1, 1, 1, None, at(1)), ("q", 14, 1, 1, 2000000000, at(40)),
    ]
    refs = spark.createDataFrame(rows, "table_name string, rec_id long, surah long, start_ayah long, end_ayah long, at timestamp")
    got = {(r.rec_id, r.month_key, r.orphan_kind) for r in orphans.orphan_references(refs, *tables).collect()}
    assert got == {
        (2, "2024-01", "no_surah"), (3, "2024-01", "beyond"), (4, "2024-01", "beyond"), (5, "2024-01", "no_verse"), (6, "2024-01", "removed"),
        (8, "2024-01", "late"), (13, None, "no_surah"), (14, "2024-02", "beyond"),
    }
    assert orphans.orphan_references(refs.limit(0), *tables).count() == 0
    assert {r.orphan_kind for r in orphans.orphan_references(refs, tables[0].limit(0), tables[1]).collect()} == {"no_surah"}


def test_partly_null_references(spark, tables):
    rows = [("q", 1, 7, None, None, at(1)), ("q", 2, None, 9, None, at(1)), ("q", 3, 2, None, None, at(1)), ("q", 4, None, 1, 2, at(1)), ("q", 5, None, None, None, at(1)), ("q", 6, 9, 1, None, at(1))]
    refs = spark.createDataFrame(rows, "table_name string, rec_id long, surah long, start_ayah long, end_ayah long, at timestamp")
    kinds = lambda m: {(r.rec_id, r.orphan_kind) for r in orphans.orphan_references(refs, *tables, m).collect()}
    assert kinds("simple") == {(6, "no_surah")}
    assert kinds("partial") == {(6, "no_surah"), (1, "no_surah"), (2, "no_verse")}
    assert kinds("full") == {(6, "no_surah"), (1, "incomplete"), (2, "incomplete"), (3, "incomplete"), (4, "incomplete")}
    plan = orphans.orphan_references(refs, *tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") >= 3


def test_match_semantics(spark):
    refs = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, 1, None), (4, 9, None), (5, None, None), (6, None, 1), (1, 1, 1), (2, 1, 9)], "r int, a int, b int")
    target = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (None, 9, 0)], "a int, b int, r int")
    ids = lambda m: sorted(x.r for x in orphans.find_orphans(refs, target, ["a", "b"], m).collect())
    assert ids("simple") == [2, 2]
    assert ids("partial") == [2, 2, 4]
    assert ids("full") == [2, 2, 3, 4, 6]
    assert orphans.find_orphans(refs, target.limit(0), ["a", "b"]).count() == 4
    with pytest.raises(ValueError):
        orphans.find_orphans(refs, target, ["a"], "other")


def test_hot_keys_are_split_and_lose_nothing(spark):
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("x"))
    small = spark.createDataFrame([(7, "a"), (8, "b"), (7, "c")], "k long, y string")
    assert max(hot_buckets(big, ["k"], 500).values()) > 1
    for how in ("inner", "left"):
        plain, salted = (sorted(map(tuple, j.select("k", "x", "y").collect()), key=str) for j in (big.join(small, "k", how), salted_join(big, small, ["k"], how, 500)))
        assert plain == salted
