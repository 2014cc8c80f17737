"""Quotes resolved to verses: exact, normalized, containment, similarity, as a cascade.

Each distinct text is resolved once; a stage sees only what the stages before left.
No stage compares all quotes with all verses: the first two are equi-joins, containment
joins on the rarest n-gram of the contained text, similarity counts n-grams in blocks of like length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.functions.text import DIFF_TYPE, contains_arabic, find_differences, normalize_arabic, reference_text, similarity, strip
from quotelens.operators import grams, near
from quotelens.operators.skew import hot_counts, once, salted_join
from quotelens.options import ValidatorOptions
from quotelens.plans.runtime import materialize, materialize_packed

VERSE = ("id", "surah", "ayah", "text")
SUGGESTIONS = "array<struct<verse_id:int,reference:string,confidence:double>>"
#: Containing texts of one n-gram in a tile, and pairs that a tile may have to compare.
HAYS, TILE_PAIRS = 50_000, 2_000_000


def _verse(*more: str) -> Column:
    return F.struct(*VERSE, *more)


def exact_verses(corpus: DataFrame) -> DataFrame:
    """(text, v): the first verse in corpus order of each distinct text."""
    first = corpus.groupBy("text").agg(F.min_by(F.struct("id", "surah", "ayah"), "ord").alias("f"))
    return first.select("text", F.struct("f.id", "f.surah", "f.ayah", "text").alias("v"))


def normalized_verses(corpus: DataFrame, keep: int) -> DataFrame:
    """(norm, v, suggestions, n): first verse of each normalized text, the first ``keep``
    of them, and whether there are several."""
    rank = F.row_number().over(Window.partitionBy("norm").orderBy("ord"))
    few = corpus.withColumn("rn", rank).where(F.col("rn") <= max(keep, 2))
    listed = F.array_sort(F.collect_list(F.struct("rn", F.col("id").alias("verse_id"), reference_text(F.col("surah"), F.col("ayah")).alias("reference"))))
    grouped = few.groupBy("norm").agg(F.min_by(_verse(), "ord").alias("v"), listed.alias("l"))
    all_of = F.transform(F.slice("l", 1, keep), lambda x: F.struct(x["verse_id"].alias("verse_id"), x["reference"].alias("reference"), F.lit(0.95).alias("confidence")))
    return grouped.select("norm", "v", F.when(F.size("l") > 1, all_of).otherwise(F.array()).cast(SUGGESTIONS).alias("suggestions"))


def _gram_rows(df: DataFrame, text: str, sizes: tuple[int, ...], own: bool) -> DataFrame:
    """(id, gram) of the distinct n-grams of a column of distinct texts."""
    named = df.select(F.xxhash64(text).alias("id"), F.col(text).alias("s"))
    return named.mapInArrow(partial(grams.distinct_grams, sizes=sizes, own=own), "id long, gram long")


def contained_pairs(needles: DataFrame, hays: DataFrame, tile: int = HAYS, tile_pairs: int = TILE_PAIRS) -> DataFrame:
    """(needle, hay): texts of ``needles`` (needle) that stand in texts of ``hays`` (hay).

    Both distinct and not empty.  A needle is looked up by its rarest n-gram among the
    hays (n = 3, or its length), and only those hits are compared.  An n-gram with many
    hays or needles is cut into tiles of both, so that no task has more than
    ``tile_pairs`` of its pairs to look at.
    """
    sizes = tuple(sorted(r[0] for r in needles.select(F.least(F.length("needle"), F.lit(3)).alias("n")).distinct().collect()))  # three at most
    if not sizes:
        return needles.select("needle", F.lit(None).cast("string").alias("hay")).limit(0)
    held = _gram_rows(hays, "hay", sizes, False)
    counts = held.groupBy("gram").count()
    own = _gram_rows(needles, "needle", sizes, True)
    # A needle with an n-gram that no hay has stands in none; such a gram is its rarest.
    known = own.join(counts, "gram", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = known.groupBy("id").agg(F.min(F.struct("count", "gram")).alias("r")).where("r.count > 0")
    left = materialize(rarest.select("r.gram", "r.count", "id").join(needles.select(F.xxhash64("needle").alias("id"), "needle"), "id").drop("id"))
    wide, tall = F.ceil(F.first("count") / tile).cast("int"), F.ceil(F.count("*") * F.least(F.first("count"), F.lit(tile)) / tile_pairs).cast("int")
    cut = left.groupBy("gram").agg(F.first("count").alias("count"), wide.alias("wide"), tall.alias("tall"))
    most = cut.agg(F.max("wide"), F.max("tall"), F.max("count")).first()
    by, right = ["gram"], held.withColumnRenamed("id", "b")
    if max(most[0] or 1, most[1] or 1) > 1:
        cut, by = materialize(cut), ["gram", "i", "j"]
        salt = lambda column, parts: F.pmod(F.xxhash64(F.lit(5), column), F.col(parts)).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        left = salted_join(left.drop("count"), cut, ["gram"]).select("gram", "needle", salt("needle", "tall").alias("i"), every("wide").alias("j"))
        right = salted_join(right, cut, ["gram"], hot=hot_counts(cut, ["gram"])).select("gram", "b", salt("b", "wide").alias("j"), every("tall").alias("i"))
    pairs = materialize(left.join(right, by).select("needle", "b"))
    return salted_join(pairs, hays.select(F.xxhash64("hay").alias("b"), "hay"), ["b"]).where(F.contains("hay", "needle")).select("needle", "hay")


def partial_matches(texts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(nq, v, confidence): for ``texts`` (nq, distinct) the first verse in corpus order
    that contains the text or stands in it; not the closest one.

    An empty text stands in the first verse; a verse that normalizes to nothing stands
    in every text.
    """
    firsts = corpus.groupBy("norm").agg(F.min_by(_verse("ord"), "ord").alias("v"))
    known = firsts.where(F.col("norm") != "")
    asked = texts.where(F.col("nq") != "")
    met = first_contained(asked, known.select("norm", F.col("v.ord").alias("ord")))
    found = met.join(known, "norm").select("nq", "norm", "inside", "v")
    first = corpus.agg(F.min_by(F.struct("norm", _verse("ord").alias("v")), "ord").alias("f")).where(F.col("f").isNotNull()).select("f.*")  # one row
    blank = firsts.where(F.col("norm") == "")  # one row at most
    one = F.lit(1).alias("one")
    every = asked.select("nq", one).join(F.broadcast(blank.select("*", one)), "one").select("nq", "norm", F.lit(False).alias("inside"), "v")
    none = texts.where(F.col("nq") == "").select("nq", one).join(F.broadcast(first.select("*", one)), "one").select("nq", "norm", F.lit(True).alias("inside"), "v")
    best = found.unionByName(every).unionByName(none).groupBy("nq").agg(F.min_by(F.struct("norm", "inside", "v"), F.struct(F.col("v.ord"), ~F.col("inside"))).alias("b"))
    q, n = F.length("nq"), F.length("b.norm")
    confidence = F.when(F.col("b.inside"), F.lit(0.7) + F.coalesce(F.try_divide(q, n), F.lit(0.0)) * F.lit(0.2)).otherwise(F.lit(0.6) + F.coalesce(F.try_divide(n, q), F.lit(0.0)) * F.lit(0.2))
    return best.select("nq", "b.v", confidence.alias("confidence"))


#: Lengths of texts that are compared in one block: up to this ratio.
LENGTHS = 1.25
#: Characters of either side of a block, and products of the numbers of texts and of characters that a task takes, at most and at least.
BLOCK_CHARS, MOST_WORK, LEAST_WORK = 12_000_000, 5e11, 2e9
#: Characters of texts below which a block is not split for more tasks, where containment is looked for.
LEAST_CHARS = 200_000


def _length_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(LENGTHS)) + F.lit(1e-9)).cast("int")


def _similar(texts: tuple[list[str], list[str]], threshold: float, size: int) -> Iterator[pa.RecordBatch]:
    """(q, norm) of one block: pairs that may be similar."""
    sides = [pa.array(x, pa.string()) for x in texts]
    for i, j in near.near_pairs(*texts, threshold, size):
        for k in range(0, len(i), 10_000):
            yield pa.RecordBatch.from_arrays([side.take(pa.array(x[k : k + 10_000])) for side, x in zip(sides, (i, j), strict=True)], names=["q", "norm"])


def _contained(texts: tuple[list[str], list[str]]) -> Iterator[pa.RecordBatch]:
    """(nq, norm, inside) of one block: the first text that contains another or stands in it."""
    asked, known = texts
    found = list(near.first_contained(asked, known)) if asked and known else []
    for k in range(0, len(found), 10_000):
        i, j, inside = zip(*found[k : k + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([asked[x] for x in i], pa.string()), pa.array([known[x] for x in j], pa.string()), pa.array(inside)], names=["nq", "norm", "inside"])


def _by_block(batches: Iterator[pa.RecordBatch], work: Callable[[tuple[list[str], list[str]]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``work`` on the two sides of each block (block, side, n, s), one block after the other."""
    current, texts = None, ([], [])
    for batch in batches:
        block, side, s = (batch.column(c) for c in ("block", "side", "s"))
        ends = np.flatnonzero(np.diff(block.to_numpy())) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if block[a].as_py() != current:
                yield from work(texts)
                current, texts = block[a].as_py(), ([], [])
            first = int(np.searchsorted(side.to_numpy()[a:b], 1)) + a
            texts[0].extend(s.slice(a, first - a).to_pylist())
            texts[1].extend(s.slice(first, b - first).to_pylist())
    yield from work(texts)


def _laid_out(asked: DataFrame, known: DataFrame, parts: dict[int, tuple[int, int, int]], blocks: int) -> DataFrame:
    """(block, side, n, s) of both sides (c, n, s), sorted: class c is cut into ``parts``
    (tall, wide, first block), by texts of ``asked`` and of ``known``."""
    of = lambda k: F.create_map(*[F.lit(x) for c, p in parts.items() for x in (c, p[k])])[F.col("c")]
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = lambda k: F.pmod(F.xxhash64(F.lit(5), F.col("s")), F.col(k)).cast("int")

    def side(df: DataFrame, number: int) -> DataFrame:
        split = df.where(F.col("c").isin(list(parts))).select("s", "n", of(0).alias("tall"), of(1).alias("wide"), of(2).alias("base"))
        placed = split.select("*", own("tall").alias("i"), every("wide").alias("j")) if number == 0 else split.select("*", every("tall").alias("i"), own("wide").alias("j"))
        return placed.select((F.col("base") + F.col("i") * F.col("wide") + F.col("j")).cast("int").alias("block"), F.lit(number).alias("side"), F.col("n").cast("long").alias("n"), "s")

    return side(asked, 0).unionAll(side(known, 1)).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side", "n")


def first_contained(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(nq, norm, inside): for texts of ``asked`` (nq) the first of ``known`` (norm, ord) of
    each block that contains the text (inside) or stands in it; all distinct, none empty."""
    left = asked.select(F.col("nq").alias("s"), F.length("nq").alias("n"), F.lit(0).alias("c"))
    right = known.select(F.col("norm").alias("s"), F.col("ord").alias("n"), F.lit(0).alias("c"))
    asks, knows = (df.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0] for df in (left, right))
    wide = max(1, -(-knows // BLOCK_CHARS))
    tall = max(1, -(-asks // BLOCK_CHARS), min(-(-2 * asked.sparkSession.sparkContext.defaultParallelism // wide), asks // LEAST_CHARS))
    return _laid_out(left, right, {0: (tall, wide, 0)}, tall * wide).mapInArrow(partial(_by_block, work=_contained), "nq string, norm string, inside boolean")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, size: int | None = None) -> DataFrame:
    """(q, norm, sim): texts of ``left`` (q) and ``right`` (norm), both distinct and not
    empty, whose similarity is at least ``threshold``; nothing is lost.

    Texts are put into blocks by length, each of ``right`` into all whose texts of
    ``left`` it can be similar to; a task takes one block and compares what shares enough
    n-grams of up to ``size``, or 3, (``near``), so that no candidates are written.  Blocks with
    much to do are split on either side.
    """
    if size is not None and size * (1 - threshold) >= 1:
        raise ValueError("texts of this similarity need not share any n-gram of this size")
    n = F.length("s")
    asked = left.select(F.col("q").alias("s")).withColumn("n", n).withColumn("c", _length_class(F.col("n")))
    shortest, longest = F.greatest(F.ceil(F.lit(threshold) * F.col("n") - 1e-9), F.lit(1)), F.floor(F.col("n") / F.lit(threshold) + 1e-9)
    known = right.select(F.col("norm").alias("s")).withColumn("n", n).withColumn("c", F.explode(F.sequence(_length_class(shortest), _length_class(longest))))
    size_of = lambda df: {r[0]: (r[1], r[2]) for r in df.groupBy("c").agg(F.count("*"), F.sum("n")).collect()}  # noqa: E731  a row a class of lengths
    asks, knows = size_of(asked), size_of(known)
    work = {c: asks[c][0] * knows[c][1] for c in asks.keys() & knows.keys()}
    one = min(MOST_WORK, max(LEAST_WORK, sum(work.values()) / (3 * left.sparkSession.sparkContext.defaultParallelism)))
    parts, blocks = {}, 0
    for c, done in sorted(work.items()):
        wide = -(-knows[c][1] // BLOCK_CHARS)
        tall = max(1, -(-asks[c][1] // BLOCK_CHARS), math.ceil(done / wide / one))
        parts[c] = (tall, wide, blocks)
        blocks += tall * wide
    if not blocks:
        return left.select("q", F.lit(None).cast("string").alias("norm"), F.lit(None).cast("double").alias("sim")).limit(0)
    met = _laid_out(asked, known, parts, blocks).mapInArrow(partial(_by_block, work=partial(_similar, threshold=threshold, size=size or 3)), "q string, norm string")
    return with_similarity(met, threshold)


def with_similarity(pairs: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (q, norm, ..) with ``sim`` of at least ``threshold``; the edit distance is
    computed with its bound, then the exact measure decides."""
    distance = F.expr(f"levenshtein(q, norm, cast(ceil((1.0D - {threshold!r}D) * greatest(length(q), length(norm)) + 1e-9D) as int))")
    near = pairs.withColumn("d", once(distance)).where(F.col("d") >= 0)
    sim = F.when(F.col("q") == F.col("norm"), F.lit(1.0)).otherwise(F.lit(1.0) - F.col("d") / F.greatest(F.length("q"), F.length("norm")))
    return near.withColumn("sim", sim).where(F.col("sim") >= F.lit(threshold)).drop("d")


def fuzzy_matches(texts: DataFrame, corpus: DataFrame, opts: ValidatorOptions, with_suggestions: bool = True) -> DataFrame:
    """(nq, v, confidence, suggestions): the most similar verse of ``texts`` (nq, distinct)
    if it reaches the threshold; suggestions may lie a tenth below it.

    The texts with such a verse are found first; only for them are the weaker
    candidates looked for, in the same way.  Without ``with_suggestions`` those are not
    looked for and suggestions are empty.
    """
    known = corpus.select("norm").distinct().where(F.length("norm") > 0)
    asked = texts.where(F.length("nq") > 0).select(F.col("nq").alias("q"))
    met = similar_pairs(asked, known, opts.fuzzy_threshold)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "ord"))
    if not with_suggestions:
        best = met.join(corpus.select(*VERSE, "ord", "norm"), "norm").withColumn("rn", rank).where(F.col("rn") == 1)
        return best.select(F.col("q").alias("nq"), _verse().alias("v"), F.col("sim").alias("confidence"), F.array().cast(SUGGESTIONS).alias("suggestions"))
    met = similar_pairs(materialize(met.select("q").distinct()), known, opts.fuzzy_threshold * 0.9)
    keep = max(opts.max_suggestions, 1)
    top = met.join(corpus.select(*VERSE, "ord", "norm"), "norm").withColumn("rn", rank).where(F.col("rn") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("rn", F.col("id").alias("verse_id"), reference_text(F.col("surah"), F.col("ayah")).alias("reference"), F.col("sim").alias("confidence"))))
    grouped = top.groupBy("q").agg(F.min_by(_verse(), "rn").alias("v"), F.max("sim").alias("confidence"), listed.alias("l"))
    named = F.transform(F.slice("l", 1, opts.max_suggestions), lambda x: F.struct(x["verse_id"].alias("verse_id"), x["reference"].alias("reference"), x["confidence"].alias("confidence")))
    return grouped.where(F.col("confidence") >= F.lit(opts.fuzzy_threshold)).select(F.col("q").alias("nq"), "v", "confidence", named.cast(SUGGESTIONS).alias("suggestions"))


def resolve(texts: DataFrame, corpus: DataFrame, opts: ValidatorOptions = ValidatorOptions(), with_suggestions: bool = True, with_text: bool = True) -> DataFrame:
    """Verdicts (q, match_type, confidence, v, suggestions) of ``texts`` (q, distinct and
    stripped) that match some verse of the prepared ``corpus``.  Without
    ``with_suggestions`` these are empty, without ``with_text`` the verse's text is null."""
    corpus = materialize_packed(corpus)  # normalized once, read by every stage
    gated = texts.where(contains_arabic(F.col("q"))).withColumn("nq", normalize_arabic(F.col("q")))
    no_text = F.lit(None).cast("string")
    exact = exact_verses(corpus).select(F.col("text").alias("q"), (F.col("v") if with_text else F.col("v").withField("text", no_text)).alias("exact_v"))
    corpus = corpus if with_text else corpus.withColumn("text", no_text)
    normal = normalized_verses(corpus, opts.max_suggestions if with_suggestions else 0).select(F.col("norm").alias("nq"), F.col("v").alias("normal_v"), "suggestions")
    none = F.array().cast(SUGGESTIONS)
    kind = F.when(F.col("exact_v").isNotNull(), "exact").when(F.col("normal_v").isNotNull(), "normalized")
    # Only what is still needed is written: a resolved text's verse once, the normalized form of the others.
    first = materialize_packed(gated.join(exact, "q", "left").join(normal, "nq", "left").select(
        "q", F.when(kind.isNull(), F.col("nq")).alias("nq"), kind.alias("match_type"), F.coalesce("exact_v", "normal_v").alias("v"),
        F.when(kind == "normalized", F.col("suggestions") if with_suggestions else none).alias("suggestions"),
    ))
    resolved = F.col("match_type").isNotNull()
    early = first.where(resolved).select("q", "match_type", F.when(F.col("match_type") == "exact", 1.0).otherwise(0.95).alias("confidence"), "v", F.coalesce("suggestions", none).alias("suggestions"))
    left = first.where(~resolved).select("q", "nq")
    asked = materialize_packed(left.select("nq").distinct())
    stages = []
    if opts.include_partial:
        held = materialize_packed(partial_matches(asked, corpus))
        stages.append(held.select("nq", F.lit("partial").alias("match_type"), "confidence", F.struct(*[F.col(f"v.{c}").alias(c) for c in VERSE]).alias("v"), none.alias("suggestions")))
        asked = materialize_packed(asked.join(held.select("nq"), "nq", "left_anti"))
    # Written, so that the shuffles of this stage are gone before those of the joins below.
    stages.append(materialize_packed(fuzzy_matches(asked, corpus, opts, with_suggestions)).select("nq", F.lit("fuzzy").alias("match_type"), "confidence", "v", "suggestions"))
    late = stages[0] if len(stages) == 1 else stages[0].unionByName(stages[1])
    return early.unionByName(left.join(late, "nq").select("q", "match_type", "confidence", "v", "suggestions"))


VERDICT = ("is_valid", "match_type", "confidence", "verse_id", "verse_text", "reference", "suggestions", "differences")


def validate(
    quotes: DataFrame, corpus: DataFrame, opts: ValidatorOptions = ValidatorOptions(), with_differences: bool = True, distinct: bool = False,
    with_suggestions: bool = True, with_text: bool = True,
) -> DataFrame:
    """``quotes`` (.., text) with is_valid, match_type, confidence, verse_id, verse_text,
    reference, suggestions and differences; columns of these names are replaced.

    ``corpus`` is prepared.  Without a match: false, 'none', 0.0, null verse, empty
    arrays.  Null texts have null verdicts and empty arrays.  Repeated texts are
    resolved once; an empty corpus matches nothing.  With ``distinct``, equal rows of
    ``quotes`` give one.  Without ``with_suggestions`` (or ``with_text``), suggestions (or
    verse_text, and differences) are left out, and what they alone need is not done.
    """
    kept = [c for c in quotes.columns if c not in VERDICT]
    with_differences &= with_text
    q, text = strip(F.col("text")), F.coalesce("__raw", "__q")
    # A text that differs from its stripped form is kept beside it; most don't.
    stripped = quotes.select(*[F.col(f"`{c}`") for c in kept if c != "text"], q.alias("__q"), F.when(F.col("text") != q, F.col("text")).alias("__raw"))
    verdicts = resolve(stripped.where(F.col("__q").isNotNull()).select(F.col("__q").alias("q")).distinct(), corpus, opts, with_suggestions, with_text)
    differ = F.when(F.col("match_type") == "exact", F.array().cast(DIFF_TYPE)).otherwise(find_differences(F.col("q"), F.col("v.text")).cast(DIFF_TYPE))
    shown = verdicts.withColumn("differences", differ) if with_differences else verdicts
    joined = salted_join(stripped, shown.select(*[F.col(c).alias(f"__{c}") for c in shown.columns]), ["__q"], "left", distinct=distinct)
    known, verse = F.col("__q").isNotNull(), F.col("__v")
    out = [
        F.when(known, F.col("__match_type").isNotNull()).alias("is_valid"),
        F.when(known, F.coalesce("__match_type", F.lit("none"))).alias("match_type"),
        F.when(known, F.coalesce("__confidence", F.lit(0.0))).alias("confidence"),
        verse["id"].alias("verse_id"), *[verse["text"].alias("verse_text")] * with_text,
        F.when(verse.isNotNull(), reference_text(verse["surah"], verse["ayah"])).alias("reference"),
        *[F.coalesce("__suggestions", F.array().cast(SUGGESTIONS)).alias("suggestions")] * with_suggestions,
    ]
    if with_differences:
        out.append(F.coalesce("__differences", F.array().cast(DIFF_TYPE)).alias("differences"))
    return joined.select(*[F.col(f"`{c}`") if c != "text" else text.alias("text") for c in kept], *out)


def similarity_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("similarity", similarity(F.col(a), F.col(b)))
