"""Records that share most of their words (problem 2).

Method: tiled exact comparison.  Each distinct word set gets a bitmap; rows of a tile
are compared with exclusive-or and bit counts in numpy, and two tiles are skipped
when their population counts differ by more than the radius.  Two sets with Jaccard
similarity t or more differ in at most (1-t)/(1+t) of their joint size, and bitmaps
never differ in more bits than sets differ in words, so the radius loses nothing.

Comparing all tiles with all would be quadratic, so tiles are filled by necessary
keys: similar sets share one of the words in the short prefix of their rarest words
(any common order is lossless; counts of word buckets over all sets give it).  A key
held by many sets is cut into several tiles and each pair of tiles is a task's work
of its own.  Equal sets are compared once.  An exact check of the sets follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.operators.skew import hot_buckets, salted_join
from quotelens.plans.runtime import materialize

#: Words are counted in 2**WORD_BITS buckets: the size of the only broadcast, whatever the data.
WORD_BITS = 21
#: Bits of a set's bitmap, rows of a tile that shares a key, rows of a compared block.
BITMAP, TILE, BLOCK = 256, 4096, 256
#: Groups up to this size are compared together, by distance within the group.
SMALL = 48

_TILES = "token long, ti int, tj int, side int, k1 long, k2 long, n int, pop int, sig binary"
_PAIRS = "a1 long, a2 long, b1 long, b2 long"


def word_sets(records: DataFrame, min_words: int) -> DataFrame:
    """(rec_id, k1, k2, words) of ``records`` (rec_id, plain): the set's 128-bit key and
    the 64-bit hashes of its distinct words; smaller sets are dropped."""
    words = records.where(F.col("plain") != "").select("rec_id", F.array_sort(F.array_distinct(F.split("plain", " "))).alias("w")).where(F.size("w") >= min_words)
    return words.select("rec_id", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(7), "w").alias("k2"), F.transform("w", lambda x: F.xxhash64(x)).alias("words"))


def _scale(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each: exact to 15, then logarithmic, rounded up."""
    big = 15 + np.ceil(8 * np.log2(np.maximum(counts, 1) / 16))
    return np.where(counts < 16, counts, np.clip(big, 16, 255)).astype(np.uint8)


def _unscale(codes: np.ndarray) -> np.ndarray:
    """The largest count that a code stands for."""
    codes = codes.astype(np.int64)
    return np.where(codes < 16, codes, np.ceil(16 * 2 ** ((codes - 15) / 8))).astype(np.int64)


def word_counts(sets: DataFrame, bits: int = WORD_BITS) -> np.ndarray:
    """For each word bucket the (scaled) number of sets; over all sets, of fixed size."""
    bucket = F.col("w").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    counted = sets.select(F.explode("words").alias("w")).groupBy(bucket.alias("b")).count().where("count > 1").toArrow()
    out = np.ones(1 << bits, np.uint8)
    out[counted["b"].to_numpy()] = _scale(counted["count"].to_numpy())
    return out


def _emit_tiles(batches: Iterator[pa.RecordBatch], counts, threshold: float, tile: int) -> Iterator[pa.RecordBatch]:
    """One row for each prefix word of each set (and for each tile pair of a large key)."""
    scaled = counts.value
    mask = len(scaled) - 1
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("words")
        flat = lists.flatten().to_numpy()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        code = scaled[flat & mask]
        order = np.lexsort((flat, code, owner))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
        bits = np.zeros((len(sizes), BITMAP), bool)
        bits[owner, (flat >> 40) & (BITMAP - 1)] = True
        sig = np.packbits(bits, axis=1)
        pop = bits.sum(1).astype(np.int32)
        sets, words, codes = owner[order], flat[order], code[order]
        keep = (place < prefix[sets]) & (codes > 1)  # a word of one set pairs nothing
        sets, words, codes = sets[keep], words[keep], codes[keep]
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        tiles = -(-_unscale(codes) // tile)
        reps = np.repeat(np.arange(len(sets)), tiles)
        other = np.arange(len(reps)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        sets, words, tiles = sets[reps], words[reps], tiles[reps]
        own = (k2[sets].astype(np.uint64) % tiles.astype(np.uint64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words), pa.array(np.minimum(own, other).astype(np.int32)), pa.array(np.maximum(own, other).astype(np.int32)),
                pa.array((own > other).astype(np.int32)), pa.array(k1[sets]), pa.array(k2[sets]), pa.array(sizes[sets].astype(np.int32)), pa.array(pop[sets]),
                pa.array(list(map(bytes, sig[sets])), pa.binary()) if len(sets) else pa.array([], pa.binary()),
            ],
            names=["token", "ti", "tj", "side", "k1", "k2", "n", "pop", "sig"],
        )


class _Rows:
    """Columns of the tile rows as numpy arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        get = lambda c: batch.column(c).to_numpy()
        self.key = np.stack([get("token"), get("ti"), get("tj")], 1)
        self.side, self.n, self.pop, self.k = get("side"), get("n").astype(np.int64), get("pop").astype(np.int64), np.stack([get("k1"), get("k2")], 1)
        sig = batch.column("sig")
        sig = sig.combine_chunks() if isinstance(sig, pa.ChunkedArray) else sig
        self.sig = np.frombuffer(b"".join(sig.to_pylist()), np.uint64).reshape(len(sig), BITMAP // 64)


def _alike(r: _Rows, i: np.ndarray, j: np.ndarray, ratio: float, threshold: float) -> np.ndarray:
    """Which of the row pairs pass the bounds of size, population count and distance."""
    a, b = r.n[i], r.n[j]
    radius = np.floor(ratio * (a + b) + 1e-9)
    near = (np.abs(r.pop[i] - r.pop[j]) <= radius) & (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
    i, j, radius = i[near], j[near], radius[near]
    hit = np.zeros(len(near), bool)
    hit[np.flatnonzero(near)[np.bitwise_count(r.sig[i] ^ r.sig[j]).sum(1) <= radius]] = True
    return hit


def _large_group(r: _Rows, lo: int, hi: int, ratio: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one large group, block by block in order of population count."""
    rows = np.arange(lo, hi)
    cross = r.key[lo, 1] != r.key[lo, 2]
    sides = [rows[r.side[lo:hi] == s] for s in (0, 1)] if cross else [rows, rows]
    sides = [s[np.argsort(r.pop[s], kind="stable")] for s in sides]
    widest = math.floor(2 * ratio * r.n[lo:hi].max() + 1e-9)
    for x in range(0, len(sides[0]), BLOCK):
        left = sides[0][x : x + BLOCK]
        for y in range(0 if cross else x, len(sides[1]), BLOCK):
            right = sides[1][y : y + BLOCK]
            if r.pop[right[-1]] < r.pop[left[0]] - widest:
                continue
            if r.pop[right[0]] > r.pop[left[-1]] + widest:
                break
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
            if not cross and x == y:
                upper = np.repeat(np.arange(len(left)), len(right)) < np.tile(np.arange(len(right)), len(left))
                i, j = i[upper], j[upper]
            hit = _alike(r, i, j, ratio, threshold)
            yield i[hit], j[hit]


def _compare(r: _Rows, upto: int, ratio: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of all whole groups in the first ``upto`` rows."""
    if not upto:
        return
    new = np.flatnonzero(np.r_[True, (r.key[1:upto] != r.key[: upto - 1]).any(1)])
    length = np.diff(np.r_[new, upto])
    group = np.repeat(np.arange(len(new)), length)
    small = np.repeat(length <= SMALL, length)
    for d in range(1, min(SMALL, int(length.max()))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
        if not len(i):
            break
        j = i + d
        ok = (r.key[i, 1] == r.key[i, 2]) | (r.side[i] != r.side[j])
        i, j = i[ok], j[ok]
        hit = _alike(r, i, j, ratio, threshold)
        yield i[hit], j[hit]
    for g in np.flatnonzero(length > SMALL):
        yield from _large_group(r, new[g], new[g] + length[g], ratio, threshold)


def _compare_tiles(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of the sorted tile rows; a group may span batches."""
    ratio = (1 - threshold) / (1 + threshold)

    def found(r: _Rows, upto: int) -> Iterator[pa.RecordBatch]:
        for i, j in _compare(r, upto, ratio, threshold):
            if len(i):
                a, b = r.k[i], r.k[j]
                swap = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])
                a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[:, 0], a[:, 1], b[:, 0], b[:, 1])], names=["a1", "a2", "b1", "b2"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = [tuple(b.column(c)[k].as_py() for c in ("token", "ti", "tj")) for b, k in ((held[0], 0), (batch, batch.num_rows - 1))]
        if ends[0] == ends[1]:
            continue  # one group so far
        whole = pa.Table.from_batches(held)
        r = _Rows(whole)
        last = r.key[-1]
        upto = int(np.flatnonzero((r.key == last).all(1))[0])
        yield from found(r, upto)
        held = whole.slice(upto).combine_chunks().to_batches()
    if held:
        r = _Rows(pa.Table.from_batches(held))
        yield from found(r, len(r.n))


def similar_sets(sets: DataFrame, threshold: float, bits: int = WORD_BITS, tile: int = TILE) -> DataFrame:
    """Pairs (a1, a2, b1, b2) of different sets (k1, k2, words) with Jaccard similarity
    of at least ``threshold``, verified on the words."""
    counts = sets.sparkSession.sparkContext.broadcast(word_counts(sets, bits))
    tiles = sets.select("k1", "k2", "words").mapInArrow(partial(_emit_tiles, counts=counts, threshold=threshold, tile=tile), _TILES)
    sorted_tiles = tiles.repartition("token", "ti", "tj").sortWithinPartitions("token", "ti", "tj")
    near = materialize(sorted_tiles.mapInArrow(partial(_compare_tiles, threshold=threshold), _PAIRS).distinct())
    side = lambda s: sets.select(F.col("k1").alias(f"{s}1"), F.col("k2").alias(f"{s}2"), F.col("words").alias(f"{s}_words"))
    # A set with very many neighbours is split on both sides before its words are attached.
    first = salted_join(near, side("a"), ["a1", "a2"])
    both = salted_join(first, side("b"), ["b1", "b2"], hot=hot_buckets(near, ["b1", "b2"]))
    common = F.size(F.array_intersect("a_words", "b_words"))
    exact = common >= F.lit(threshold) * (F.size("a_words") + F.size("b_words") - common) - 1e-9
    return both.where(exact).select("a1", "a2", "b1", "b2")


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.7, min_words: int = 8, bits: int = WORD_BITS, tile: int = TILE) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: records whose sets of distinct words are similar.

    ``records`` (rec_id, plain), each rec_id once.  Null, empty and short texts match
    nothing; equal texts match; texts of any length are compared whole; an empty table
    gives no rows; other columns are ignored.
    """
    members = materialize(word_sets(records, min_words))
    sets = materialize(members.select("k1", "k2", "words").distinct())
    held = members.select("k1", "k2", "rec_id")
    repeated = held.groupBy("k1", "k2").count().where("count > 1").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    pairs = similar_sets(sets, threshold, bits, tile).unionByName(repeated)
    as_side = lambda s: held.select(F.col("k1").alias(f"{s}1"), F.col("k2").alias(f"{s}2"), F.col("rec_id").alias(f"{s}_id"))
    first = salted_join(as_side("a"), pairs, ["a1", "a2"])
    both = salted_join(as_side("b"), first, ["b1", "b2"])
    same = (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))
    kept = both.where(~same | (F.col("a_id") < F.col("b_id")))
    return kept.select(F.least("a_id", "b_id").alias("rec_a"), F.greatest("a_id", "b_id").alias("rec_b"))


def near_duplicate_groups(records: DataFrame, threshold: float = 0.7, min_words: int = 8) -> DataFrame:
    """(rec_id, group_id, n_links): every record with at least ``min_words`` distinct
    words, the smallest record of its group (linked directly or through others), and
    its number of links; links between equal texts are counted, never listed."""
    members = materialize(word_sets(records, min_words))
    sets = materialize(members.groupBy("k1", "k2", "words").agg(F.min("rec_id").alias("rep"), F.count("*").alias("copies")))
    pairs = similar_sets(sets, threshold)
    reps = sets.select("k1", "k2", "rep", "copies")
    named = lambda s: reps.select(F.col("k1").alias(f"{s}1"), F.col("k2").alias(f"{s}2"), F.col("rep").alias(f"{s}_rep"), F.col("copies").alias(f"{s}_copies"))
    links = materialize(pairs.join(named("a"), ["a1", "a2"]).join(named("b"), ["b1", "b2"]).select("a_rep", "a_copies", "b_rep", "b_copies"))
    both = links.select(F.col("a_rep").alias("x"), F.col("b_rep").alias("y"), F.col("b_copies").alias("n")).unionAll(links.select("b_rep", "a_rep", "a_copies"))
    groups = components(both.select("x", "y"))
    linked = both.groupBy(F.col("x").alias("rep")).agg(F.sum("n").alias("others"))
    sizes = reps.join(groups.withColumnRenamed("x", "rep"), "rep", "left").join(linked, "rep", "left")
    labelled = sizes.select("k1", "k2", F.coalesce("label", "rep").alias("group_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return salted_join(members.select("rec_id", "k1", "k2"), labelled, ["k1", "k2"]).select("rec_id", "group_id", "n_links")


def _each_least(links: DataFrame) -> DataFrame:
    """(x, least): the smallest of each node ``x`` of ``links`` (x, y) and its neighbours."""
    return links.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("least"))


def components(links: DataFrame, on_round: Callable[[int], None] | None = None) -> DataFrame:
    """(x, label): the smallest node that each node of the symmetric ``links`` (x, y)
    reaches.

    Alternating large stars (every larger neighbour is hooked to the smallest) and small
    stars (every smaller one, and the node itself), after Kiveris et al. 2014: the rounds
    grow with the square of the logarithm of the nodes at most, in practice with the
    logarithm, whatever the order of ids along a chain.  Each round is written once
    and read from there; the joins are salted, since a component's smallest node
    comes to be the neighbour of all others.  ``on_round`` is told each round's number.
    """
    edges = materialize(links.where(F.col("x") > F.col("y")).select("x", "y").distinct())
    rounds = 0
    while True:
        rounds += 1
        if on_round:
            on_round(rounds)
        both = edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hot = hot_buckets(both, ["x"])
        large = salted_join(both, _each_least(both), ["x"], hot=hot).where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("least").alias("y"))
        down = materialize(large.distinct())
        joined = salted_join(down, _each_least(down), ["x"])
        hooked = F.array(F.struct("x", F.col("least").alias("y")), F.struct(F.col("y").alias("x"), F.col("least").alias("y")))
        small = joined.select(F.explode(hooked).alias("e")).select("e.x", "e.y").where(F.col("x") > F.col("y"))
        new = materialize(small.distinct())
        # Stars at last: nothing that is hooked to another node has one hooked to it.
        still = new.join(new.select(F.col("y").alias("x")).distinct(), "x", "left_semi").limit(1).count() or new.groupBy("x").count().where("count > 1").limit(1).count()
        edges = new
        if not still:
            break
    own = edges.select(F.col("y").alias("x"), F.col("y").alias("label")).distinct()
    alone = links.select("x").distinct().join(edges.select("x").unionAll(edges.select("y")), "x", "left_anti").select("x", F.col("x").alias("label"))
    return edges.select("x", F.col("y").alias("label")).unionAll(own).unionAll(alone)
