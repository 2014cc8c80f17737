"""References to records that do not exist, are gone, or came later (problem 4).

Method: composite keys with partial nulls.  References are grouped by their null
mask; the distinct keys of each mask are anti-joined on the mask's non-null columns
under declared match semantics (``find_orphans``), and only the few distinct keys are
compared with the target tables.  The verdict then joins back to the rows, salted,
because one key may hold a third of them.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.chars import BLANKS, COLONS, DASHES, OTHER_DIGITS, PLAIN_DIGITS
from quotelens.operators.skew import hot_buckets, once, salted_join, union_all
from quotelens.plans.runtime import materialize

# A number of more digits than this is read as this power of ten: no key is as large.
_DIGITS = 17

_PLAIN = (DASHES + COLONS + OTHER_DIGITS, "-" * len(DASHES) + ":" * len(COLONS) + PLAIN_DIGITS)


def readable(reference: Column) -> Column:
    """A reference with plain digits and signs, without blanks and invisible characters."""
    return F.translate(F.regexp_replace(reference, r"[\p{Cf}\p{Cc}\p{Z}͏︀-️]", ""), _PLAIN[0] + BLANKS, _PLAIN[1])


def parts_of(plain: Column) -> Column:
    """STRUCT<surah, start_ayah, end_ayah> (BIGINT) of a readable ``s:a`` or ``s:a-b``."""
    shape = r"^([0-9]+):([0-9]+)(?:-([0-9]+))?$"

    def number(group: int) -> Column:
        digits = F.regexp_replace(F.regexp_extract(plain, shape, group), "^0+(?=.)", "")
        return F.when(F.length(digits) > _DIGITS, F.lit(10**_DIGITS)).when(digits != "", digits.try_cast("bigint"))

    return F.when(plain.rlike(shape), F.struct(number(1).alias("surah"), number(2).alias("start_ayah"), number(3).alias("end_ayah")))


def reference_parts(reference: Column) -> Column:
    """``parts_of`` a reference as written; null for null or anything else; end_ayah is
    null for a single verse."""
    return parts_of(readable(reference))


def null_masks(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``null_mask``: one character for each key, '1' where it is null."""
    return df.withColumn("null_mask", F.concat(*[F.col(k).isNull().cast("int").cast("string") for k in keys]))


def find_orphans(refs: DataFrame, target: DataFrame, keys: list[str], match: str = "simple", hot: dict[int, int] | None = None) -> DataFrame:
    """Rows of ``refs`` whose composite key names no row of ``target``.

    ``match`` declares what a partly null key means, as in SQL's referential
    constraints: 'simple' (any null: never an orphan), 'partial' (the non-null
    columns must be found together in some row), 'full' (all null: no orphan; partly
    null: always one).  Each null mask is anti-joined on its own non-null columns,
    over distinct keys; null keys of ``target`` match nothing.  The result has the
    columns of ``refs`` plus null_mask.  Repeated rows stay repeated; an empty target
    makes every complete key an orphan; other columns of ``target`` are ignored.  ``hot``: the hot buckets of
    complete keys, where they are at hand.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    masked = null_masks(refs, keys)
    known = target.select(*keys).distinct()
    lost = []
    for mask in product("01", repeat=len(keys)):
        held = [k for k, m in zip(keys, mask, strict=True) if m == "0"]
        rows = masked.where(F.col("null_mask") == "".join(mask))
        if len(held) < len(keys) and match == "simple" or not held:
            continue
        if len(held) < len(keys) and match == "full":
            lost.append(rows)
            continue
        named = rows.select(*held).distinct()
        missing = named.join(known.select(*held).distinct(), held, "left_anti")
        lost.append(salted_join(rows, missing, held, hot=hot if held == keys else None).select(masked.columns))
    return union_all(lost) if lost else masked.limit(0)


def reference_kinds(keys: DataFrame, surahs: DataFrame, verses: DataFrame, match: str = "simple") -> DataFrame:
    """What is wrong with distinct complete keys (surah, start_ayah, last): a row with
    ``fixed_kind`` ('no_surah', 'beyond' or 'no_verse') for those that never name
    something, and one with ``gone_from`` (earliest removal in the range) and
    ``there_from`` (when the last verse of the range had first been loaded) for the rest.

    Kinds are successive anti-joins: chapters on (surah); then, for the ranges within
    their chapter's count, every verse of the range on (surah, ayah).
    """
    key = ["surah", "start_ayah", "last"]
    counted = verses.groupBy("surah", "ayah").agg(F.min("removed_at").alias("removed_at"), F.min("loaded_at").alias("first_loaded"))
    most = verses.groupBy("surah").agg(F.max("ayah").alias("most"))
    dims = surahs.select(F.col("number").alias("surah"), "verses_count").groupBy("surah").agg(F.max("verses_count").alias("verses_count"))
    none = find_orphans(keys, dims, ["surah"], match).select(*key, F.lit("no_surah").alias("fixed_kind"))
    known = keys.join(dims, "surah").join(most, "surah", "left")
    outside = F.coalesce((F.col("start_ayah") < 1) | (F.col("last") > F.col("verses_count")), F.col("start_ayah") < 1)
    # Where a chapter's count is null, its last verse bounds what is looked up.
    unheld = F.col("last") > F.coalesce("verses_count", "most", F.lit(0))
    judged = known.select(*key, F.when(outside, "beyond").when(unheld, "no_verse").alias("fixed_kind"))
    bounded = judged.where(F.col("fixed_kind").isNull()).select(*key)  # at most verses_count ayahs a range
    named = materialize(bounded.withColumn("ayah", F.explode(F.sequence("start_ayah", "last"))))
    hot = hot_buckets(named, ["surah", "ayah"])
    missing = find_orphans(named, counted, ["surah", "ayah"], match, hot).select(*key).distinct()
    times = salted_join(named, counted, ["surah", "ayah"], hot=hot).groupBy(*key).agg(F.min("removed_at").alias("gone_from"), F.max("first_loaded").alias("there_from"))
    fixed = none.unionByName(judged.where(F.col("fixed_kind").isNotNull())).unionByName(missing.select(*key, F.lit("no_verse").alias("fixed_kind")))
    return fixed.unionByName(times.join(missing, key, "left_anti"), allowMissingColumns=True)


def orphan_references(refs: DataFrame, surahs: DataFrame, verses: DataFrame, match: str = "simple") -> DataFrame:
    """Orphans among ``refs`` (table_name, rec_id, surah, start_ayah, end_ayah, at).

    Returns (table_name, rec_id, month_key, orphan_kind); kinds in the order
    no_surah, beyond, no_verse, removed, late, the first that holds.  References are
    grouped by the null mask of (surah, start_ayah), and ``match`` declares what a
    partly null one means, as in ``find_orphans``: 'simple' leaves it aside; 'partial'
    makes it 'no_surah' or 'no_verse' where what it does name stands in no verse; 'full'
    makes it 'incomplete'.  A null end_ayah isn't unknown but names one verse; a range
    with end before start is left aside.  A null time has no month and is never
    'removed' or 'late'.  Repeated rows count once; other columns are ignored.
    """
    given = refs.select("table_name", "rec_id", "surah", "start_ayah", "end_ayah", "at").distinct()
    masked = null_masks(given.where(F.coalesce(F.col("end_ayah") >= F.col("start_ayah"), F.lit(True))), ["surah", "start_ayah"])
    rows = materialize(masked.withColumn("last", F.coalesce("end_ayah", "start_ayah")))
    whole = rows.where(F.col("null_mask") == "00")
    key = ["surah", "start_ayah", "last"]
    kinds = reference_kinds(materialize(whole.select(*key).distinct()), surahs, verses, match)
    kind = F.coalesce(
        "fixed_kind",
        F.when(F.col("gone_from") <= F.col("at"), "removed"),
        F.when(F.col("there_from") > F.col("at"), "late"),
    )
    shown = ("table_name", "rec_id", F.date_format("at", "yyyy-MM").alias("month_key"))
    found = [salted_join(whole, kinds, key).select(*shown, kind.alias("orphan_kind")).where(F.col("orphan_kind").isNotNull())]
    if match != "simple":
        partly = rows.where(F.col("null_mask") != "00").withColumn("ayah", F.col("start_ayah")).drop("null_mask")
        lost = find_orphans(partly, verses, ["surah", "ayah"], match)
        why = F.when(F.lit(match == "full"), "incomplete").when(F.col("surah").isNull(), "no_verse").otherwise("no_surah")
        found.append(lost.select(*shown, why.alias("orphan_kind")))
    return union_all(found)


def quote_references(quotes: DataFrame) -> DataFrame:
    """References written in quotes, as ``orphan_references`` takes them."""
    written = quotes.where(F.col("reference").isNotNull()).select("quote_id", "found_at", once(readable(F.col("reference"))).alias("plain"))
    parts = written.select("quote_id", "found_at", once(parts_of(F.col("plain"))).alias("r")).where(F.col("r").isNotNull())
    return parts.select(
        F.lit("quotes").alias("table_name"), F.col("quote_id").alias("rec_id"), F.col("r.surah").alias("surah"),
        F.col("r.start_ayah").alias("start_ayah"), F.col("r.end_ayah").alias("end_ayah"), F.col("found_at").alias("at"),
    )


def parsed_references(parsed: DataFrame) -> DataFrame:
    """Rows of parsed_references, as ``orphan_references`` takes them."""
    return parsed.select(
        F.lit("parsed_references").alias("table_name"), F.col("ref_id").alias("rec_id"),
        *[F.col(c).cast("bigint").alias(c) for c in ("surah", "start_ayah", "end_ayah")], F.col("parsed_at").alias("at"),
    )
