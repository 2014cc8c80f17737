"""Evaluation passages that stand in corpus documents (problem 7).

Method: prefix-filtered set join.  Texts become words, words become shingles of five.
An item is leaked where ``min_words`` of its words stand in a row in a document, so
each item-sized window of that many words has ``min_words - 4`` shingles and all of
them must be there: the necessary prefix of a window is its one rarest shingle, by its
count over the whole corpus.  Documents are scanned once; what is kept of
them are runs of shingles that occur in items, long enough to hold a window (length
bound).  Runs and windows meet on the rarest shingle; its place in both fixes where
the window would begin (positional bound), and the whole window is compared there.

A shingle is a 64-bit number made of its words' 64-bit hashes.  The scan knows the items'
shingles from a bitmap of fixed size, however many items there are (a bit set by chance
only keeps a run that finds no window); items never pass through the driver.  Whole
windows are compared by all their shingles, which cover every word several times.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.chars import BLANKS
from quotelens.llm.house_form import is_invisible
from quotelens.operators.skew import hot_buckets, salted_join
from quotelens.plans.runtime import materialize

SHINGLE = 5
#: Bits of the map of the items' shingles, the only thing that is broadcast (8 MB).
FILTER_BITS = 26
#: Words of a process's table before it is built anew.
CACHE_WORDS = 1_000_000

_HIDDEN = re.compile("[" + "".join(f"\\u{c:04x}" for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in BLANKS and is_invisible(chr(c))) + "]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑⁃][^\S\n]*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_RUNS = "row long, shingles array<long>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters or digits in one spelling: compatibility-composed, without case,
    invisible characters and line-end hyphens."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.casefold()
    else:
        text = text.lower()
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text)


class _Hashes(dict):
    """Word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles_of(words: np.ndarray) -> np.ndarray:
    """The shingle that begins at each place of the word hashes."""
    n = len(words) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out = (out ^ words[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _texts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(rows, word hashes) of texts (row, text) of at least ``least`` words, batch by batch."""
    known = _Hashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            if len(known) > CACHE_WORDS:
                known = _Hashes()
            rows, words = [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                if text and len(w := words_of(text)) >= least:
                    rows.append(row)
                    words.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
            yield rows, words


def _place(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each shingle in a map of 2**bits."""
    return ((shingles * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _emit(rows: list[int], runs: list[np.ndarray]) -> pa.RecordBatch:
    flat = [r.view(np.int64) for r in runs]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(flat, pa.list_(pa.int64()))], names=["row", "shingles"])


def _windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The windows of each item, as its shingles."""
    size = min_words - SHINGLE + 1
    for rows, words in _texts(batches, min_words):
        own, found = [], []
        for row, w in zip(rows, words):
            each = np.lib.stride_tricks.sliding_window_view(shingles_of(w), size)
            own += [row] * len(each)
            found += list(np.ascontiguousarray(each))
        yield _emit(own, found)


def _bit_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(w, b): the 64-bit words of the map in which the shingles set bits."""
    for batch in batches:
        at = np.unique(_place(batch.column("shingle").to_numpy().view(np.uint64), bits))
        first = np.flatnonzero(np.r_[True, (at[1:] >> 6) != (at[:-1] >> 6)]) if len(at) else np.empty(0, np.int64)
        each = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array((at[first] >> 6).astype(np.int32)), pa.array(each.view(np.int64))], names=["w", "b"])


def _scan(batches: Iterator[pa.RecordBatch], filled, bits: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """The runs of item shingles of each document that can hold a window."""
    held, least = filled.value, min_words - SHINGLE + 1
    for rows, words in _texts(batches, min_words):
        own, found = [], []
        if words:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes)
            s = shingles_of(np.concatenate(words))
            at = _place(s, bits)
            hit = (held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            # A shingle over the border of two documents is none.
            for k in range(1, SHINGLE):
                hit[ends[:-1] - k] = 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int64), [0]])))
            a, b = edge[::2], edge[1::2]
            long = b - a >= least
            for x, y, d in zip(a[long].tolist(), b[long].tolist(), np.searchsorted(ends, a[long], side="right").tolist()):
                own.append(rows[d])
                found.append(s[x:y])
        yield _emit(own, found)


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = 16, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id): at least ``min_words`` words in a row of the item stand in a
    row in the document.

    ``documents`` (doc_id, text) and ``items`` (item_id, item_text).  Null and short
    texts match nothing, repeated rows count once, texts are read whole, empty tables
    give no rows, other columns are ignored.  ``min_words`` is at least five.
    """
    if min_words < SHINGLE:
        raise ValueError(f"min_words must be at least {SHINGLE}")
    if not 6 <= filter_bits <= 32:
        raise ValueError("filter_bits must be from 6 to 32")
    size = min_words - SHINGLE + 1
    named = lambda df, key, text: df.where(F.col(text) != "").select(F.col(key).cast("bigint").alias("row"), F.col(text).alias("text"))
    kept = named(items, "item_id", "item_text").mapInArrow(partial(_windows, min_words=min_words), _RUNS)
    # Windows go by a 128-bit key; only where they are compared do they stand in full.
    key = [F.xxhash64("shingles").alias("w1"), F.xxhash64(F.lit(7), "shingles").alias("w2")]
    windows = materialize(kept.select(*key, F.col("shingles").alias("window"), F.col("row").alias("item_id")).distinct())
    each = windows.select("w1", "w2", F.posexplode("window").alias("place", "shingle")).distinct()
    known = each.select("shingle").distinct()
    filled = np.zeros(1 << (filter_bits - 6), np.uint64)
    parts = known.mapInArrow(partial(_bit_words, bits=filter_bits), "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most the map
    filled[parts["w"].to_numpy()] = parts["b"].to_numpy().view(np.uint64)
    shared = documents.sparkSession.sparkContext.broadcast(filled)
    runs = materialize(named(documents, "doc_id", "text").mapInArrow(partial(_scan, filled=shared, bits=filter_bits, min_words=min_words), _RUNS))
    # Runs that hold each shingle of an item, over all documents.
    counted = runs.select(F.explode(F.array_distinct("shingles")).alias("shingle")).groupBy("shingle").count()
    placed = each.join(counted, "shingle", "left")
    rarest = placed.groupBy("w1", "w2").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "shingle", "place")).alias("r"))
    # A window with a shingle of no document is nowhere.
    wanted = materialize(rarest.where("r.n > 0").select("w1", "w2", "r.shingle", "r.place").join(windows.select("w1", "w2", "window").distinct(), ["w1", "w2"]))
    begins = runs.select("row", "shingles", F.posexplode("shingles").alias("at", "shingle"))
    often = hot_buckets(begins.join(wanted.select("shingle").distinct(), "shingle", "left_semi").select("shingle"), ["shingle"])
    start = F.col("at") - F.col("place")
    met = salted_join(begins, wanted, ["shingle"], hot=often).where((start >= 0) & (start + size <= F.size("shingles")))
    fits = met.where(F.slice("shingles", start + 1, size) == F.col("window")).select("row", "w1", "w2").distinct()
    found = fits.join(windows, ["w1", "w2"]).select(F.col("row").alias("doc_id"), F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"))
    return found.distinct()
