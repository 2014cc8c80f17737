"""Long exact spans shared between records (problem 5).

Method: a compressed FM-index for each shard; backward search over its wavelet matrix
computes the matching statistics of streamed texts and reports the intervals above the
threshold (see ``fm_index``).

Searching every shard for every record would be quadratic, so texts are cut at anchors:
k-mers with the least hash in some window.  Every stretch of ``least`` characters holds
an anchor, and equal stretches the same one, so a shard that indexes the surroundings
of an anchor's places finds every match across it.  An anchor's surroundings all go to
one shard.  An anchor with very many places is refined: its key becomes each stretch of
``least`` characters around it, of which a match holds at least one.  Of a refined key's
places only two, of the smallest and the largest document, are indexed; all search, spread
over as many shards as there are places for, so that the work grows with the places and
not with their square.  Equal records are indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.llm.fm_index import FMIndex
from quotelens.operators.skew import hot_buckets, parts_of, salted_join
from quotelens.plans.runtime import materialize

#: Characters of an anchor, and surroundings that one index takes.
ANCHOR, SHARD_CHARS = 20, 1_500_000
#: Places of one key in a shard, whatever the data; an anchor with more is refined.
PLACES = 20_000
#: Characters of texts whose anchors are looked for at once.
SCAN_CHARS = 4_000_000

_ANCHORS = "anchor long, doc long, n_chars int, start int, around string"
_SPANS = "doc long, n_chars int, start int, end int"
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Extreme of each window of ``width`` values."""
    out, step = x, 1
    while step * 2 <= width:
        out = best(out[:-step], out[step:])
        step *= 2
    n = len(x) - width + 1
    return best(out[:n], out[width - step : width - step + n])


def find_anchors(code: np.ndarray, owner: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in joined texts of at least ``least`` characters, and their
    hashes; equal k-mers have equal hashes wherever they stand."""
    n, window = len(code), least - k + 1
    base = np.uint64(_MIX[0])
    power = np.ones(n + 1, np.uint64)
    power[1:] = base
    power = np.multiply.accumulate(power)
    back = np.ones(n + 1, np.uint64)
    back[1:] = np.uint64(pow(_MIX[0], -1, 1 << 64))
    back = np.multiply.accumulate(back)
    total = np.concatenate([[np.uint64(0)], np.cumsum(code.astype(np.uint64) * power[:n], dtype=np.uint64)])
    h = (total[k:] - total[:-k]) * back[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(_MIX[1])
    h ^= h >> np.uint64(29)
    inside = owner[: n - k + 1] == owner[k - 1 :]
    lowest = _slide(np.where(inside, h, np.uint64(2**64 - 1)), window, np.minimum)
    whole = owner[: len(lowest)] == owner[least - 1 :][: len(lowest)]
    lowest = np.where(whole, lowest, np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    chosen = (_slide(np.concatenate([pad, lowest, pad]), window, np.maximum) == h) & inside & (h > 0)
    at = np.flatnonzero(chosen)
    return at, h[at].view(np.int64)


def _emit_anchors(batches: Iterator[pa.RecordBatch], least: int, k: int, bare: bool = False) -> Iterator[pa.RecordBatch]:
    """A row for each anchor: hash, document, its length, where the surroundings start,
    they; only the hash if ``bare``."""
    margin = least - k

    def rows(docs: list[int], texts: list[str]) -> pa.RecordBatch:
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        at, h = find_anchors(code, owner, least, k)
        if bare:
            return pa.RecordBatch.from_arrays([pa.array(h)], names=["anchor"])
        o = owner[at]
        inner = at - first[o]
        start = np.maximum(inner - margin, 0)
        end = np.minimum(inner + k + margin, sizes[o])
        around = [texts[a][b:c] for a, b, c in zip(o.tolist(), start.tolist(), end.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(np.array(docs, np.int64)[o]), pa.array(sizes[o].astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(around, pa.string())],
            names=["anchor", "doc", "n_chars", "start", "around"],
        )

    for batch in batches:
        docs, texts, chars = [], [], 0
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            docs.append(doc)
            texts.append(text)
            chars += len(text)
            if chars >= SCAN_CHARS:
                yield rows(docs, texts)
                docs, texts, chars = [], [], 0
        if texts:
            yield rows(docs, texts)


def _search_shard(t: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Shared stretches of one shard's surroundings, in the places of their documents."""
    anchor, tile = t.column("anchor").to_numpy(), t.column("tile").to_numpy()
    doc, start, size = t.column("doc").to_numpy(), t.column("start").to_numpy().astype(np.int64), t.column("n_chars").to_numpy()
    indexed, asks = (t.column(c).to_numpy(zero_copy_only=False) for c in ("indexed", "asks"))
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])]
    group = np.cumsum(new) - 1
    # Places of an anchor that only one document has match nothing across it.
    low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    row = np.flatnonzero((low != high)[group])
    if not len(row):
        return
    texts = pa.compute.dictionary_encode(t.column("around").combine_chunks().take(pa.array(row)))
    kind, words = texts.indices.to_numpy(), texts.dictionary.to_pylist()
    known = indexed[row]
    name = np.unique(doc, return_inverse=True)[1]  # documents numbered within the shard
    owner = np.full(len(words), -3, np.int64)  # of the indexed copies: -1 for several owners
    owner[kind[known]] = name[row][known]
    several = np.zeros(len(words), bool)
    several[kind[known][owner[kind[known]] != name[row][known]]] = True
    owner[several] = -1
    code = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    held = np.flatnonzero(owner > -3)
    if not len(held):
        return
    index = FMIndex([code[i] for i in held], owner[held])
    asking = asks[row]
    row, kind = row[asking], kind[asking]
    # Copies of one text by one document ask once.
    asked = np.unique(np.stack([kind, name[row]]), axis=1)
    back = {pair: n for n, pair in enumerate(map(tuple, asked.T.tolist()))}
    which = np.fromiter((back[p] for p in zip(kind.tolist(), name[row].tolist())), np.int64, len(row))
    places = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[places], np.arange(asked.shape[1] + 1))
    for q, a, b in index.matches([code[i] for i in asked[0]], asked[1], least):
        n = bounds[q + 1] - bounds[q]
        reps = np.repeat(np.arange(len(q)), n)
        each = row[places[np.repeat(bounds[q] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[each]), pa.array(size[each]), pa.array((start[each] + a[reps]).astype(np.int32)), pa.array((start[each] + b[reps]).astype(np.int32))],
            names=["doc", "n_chars", "start", "end"],
        )


def _search(batches: Iterator[pa.RecordBatch], least: int, shard_chars: int) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted partition into shards at anchors' borders and searches each."""
    held: list[pa.RecordBatch] = []
    chars = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        chars += batch.column("around").nbytes // 2
        if chars < shard_chars:
            continue
        t = pa.Table.from_batches(held)
        anchor, tile = t.column("anchor").to_numpy(), t.column("tile").to_numpy()
        border = np.flatnonzero((anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])) + 1
        if not len(border):
            continue
        yield from _search_shard(t.slice(0, int(border[-1])), least)
        held = t.slice(int(border[-1])).combine_chunks().to_batches()
        chars = sum(b.column("around").nbytes // 2 for b in held)
    if held:
        yield from _search_shard(pa.Table.from_batches(held), least)


def shared_stretches(docs: DataFrame, least: int = 50, k: int = ANCHOR, places: int = PLACES, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc, n_chars, start, end): maximal stretches of at least ``least`` characters of
    ``docs`` (doc, text; different texts) that stand in another document too.  A
    stretch may come more than once or in overlapping pieces."""
    if not 0 < k < least:
        raise ValueError("an anchor must be shorter than the stretches looked for")
    long = docs.where(F.length("text") >= least)
    anchors = long.mapInArrow(partial(_emit_anchors, least=least, k=k), _ANCHORS)
    hot = hot_buckets(long.mapInArrow(partial(_emit_anchors, least=least, k=k, bare=True), "anchor long"), ["anchor"], places)
    plain = (F.lit(0).alias("tile"), F.lit(True).alias("indexed"), F.lit(True).alias("asks"))
    columns = ("anchor", "doc", "n_chars", "start", "around")
    rows = anchors.select(*columns, *plain)
    if hot:
        often = parts_of(hot, ["anchor"]) > 1
        at = F.explode(F.sequence(F.lit(0), F.length("around") - least)).alias("at")
        windows = anchors.where(often).select("doc", "n_chars", "start", "around", at)
        stretch = F.substring("around", F.col("at") + 1, F.lit(least))
        # One row for each place of a stretch, however many anchors it holds.
        fine = materialize(windows.select(F.xxhash64(F.lit(3), stretch).alias("anchor"), "doc", "n_chars", (F.col("start") + F.col("at")).alias("start"), stretch.alias("around")).distinct())
        split = hot_buckets(fine, ["anchor"], places)
        own = F.pmod(F.xxhash64("doc", "start"), parts_of(split, ["anchor"])).cast("int")
        ends = fine.groupBy("anchor", "around").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
        every = F.explode(F.sequence(F.lit(0), parts_of(split, ["anchor"]) - 1)).alias("tile")
        held = ends.select("anchor", "around", F.explode(F.array("lo", "hi")).alias("doc")).select("*", every)
        known = held.select("anchor", "doc", F.lit(least).alias("n_chars"), F.lit(0).alias("start"), "around", "tile", F.lit(True).alias("indexed"), F.lit(False).alias("asks"))
        asking = fine.select(*columns, own.alias("tile"), F.lit(False).alias("indexed"), F.lit(True).alias("asks"))
        rows = anchors.where(~often).select(*columns, *plain).unionByName(known).unionByName(asking)
    shards = rows.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile")
    return shards.mapInArrow(partial(_search, least=least, shard_chars=shard_chars), _SPANS)


def covered_chars(stretches: DataFrame) -> DataFrame:
    """(doc, n_chars, shared_chars): characters of each document in some stretch."""
    order = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(order), F.lit(0))
    fresh = stretches.distinct().select("doc", "n_chars", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)).alias("fresh"))
    return fresh.groupBy("doc", "n_chars").agg(F.sum("fresh").alias("shared_chars"))


def shared_shares(records: DataFrame, least: int = 50, **how: int) -> DataFrame:
    """(rec_id, n_chars, shared_chars) of ``records`` (rec_id, text): how many characters
    lie in stretches of at least ``least`` that also stand in a record with another id.

    Texts are compared as stored.  Null texts have null n_chars and share nothing, as do
    empty and short ones; a record repeated under the same id counts once; equal texts
    of different ids share all; texts are read whole; an empty table gives no rows; other
    columns are ignored.
    """
    hashed = records.select("rec_id", "text", F.length("text").alias("n_chars"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    long = hashed.where(F.col("n_chars") >= least)
    # A text's copies: two different ids are enough to know.
    docs = materialize(long.groupBy("k1", "k2", "text").agg(F.min("rec_id").alias("doc"), (F.min("rec_id") < F.max("rec_id")).alias("copied")))
    covered = covered_chars(shared_stretches(docs.select("doc", "text"), least, **how))
    known = docs.select("k1", "k2", "doc", "copied").join(covered.select("doc", "shared_chars"), "doc", "left")
    verdicts = known.where(F.col("shared_chars").isNotNull() | F.col("copied")).select("k1", "k2", "copied", "shared_chars")
    members = hashed.select("rec_id", "n_chars", "k1", "k2").distinct()
    joined = salted_join(members, verdicts, ["k1", "k2"], "left")
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0)))
    return joined.select("rec_id", "n_chars", shared.cast("int").alias("shared_chars"))
