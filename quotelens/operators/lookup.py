"""Look-ups in the corpus: verses, ranges, chapters, and search by similarity."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.functions.text import normalize_arabic
from quotelens.operators.distance import distances, padded
from quotelens.operators.skew import salted_join, tasks_for
from quotelens.plans.runtime import jvm_function, materialize


def first_by_place(corpus: DataFrame) -> DataFrame:
    """The first verse in corpus order of each (surah, ayah)."""
    rest = [c for c in corpus.columns if c not in ("surah", "ayah")]
    return corpus.groupBy("surah", "ayah").agg(F.min_by(F.struct(*rest), "ord").alias("v")).select("surah", "ayah", "v.*")


def get_verses(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """``wanted`` (.., surah, ayah) with the verse's columns, null where there is none;
    columns of these names are replaced."""
    verses = first_by_place(corpus)
    kept = [c for c in wanted.columns if c not in verses.columns or c in ("surah", "ayah")]
    return salted_join(wanted.select(*kept), verses, ["surah", "ayah"], "left")


def verse_ranges(ranges: DataFrame, corpus: DataFrame) -> DataFrame:
    """(surah, start_ayah, end_ayah, text, text_simple, verse_ids) of distinct ranges all
    of whose verses are there; reversed, incomplete and null ranges give no row."""
    keys = ranges.select("surah", "start_ayah", "end_ayah").distinct().where(F.col("start_ayah") <= F.col("end_ayah"))
    verses = first_by_place(corpus).select("surah", "ayah", "id", "text", "text_simple")
    # Ranges beyond a surah's last verse are never whole; the rest name its verses one by one.
    held = corpus.groupBy("surah").agg(F.min("ayah").alias("first"), F.max("ayah").alias("last"))
    inside = keys.join(held, "surah").where((F.col("start_ayah") >= F.col("first")) & (F.col("end_ayah") <= F.col("last")))
    # The ranges are distinct, so at most the square of a surah's verses name one verse.
    met = inside.select("surah", "start_ayah", "end_ayah", F.explode(F.sequence("start_ayah", "end_ayah")).alias("ayah")).join(verses, ["surah", "ayah"])
    in_order = F.array_sort(F.collect_list(F.struct("ayah", "id", "text", "text_simple"))).alias("v")
    grouped = met.groupBy("surah", "start_ayah", "end_ayah").agg(in_order)
    whole = grouped.where(F.size("v") == F.col("end_ayah").cast("bigint") - F.col("start_ayah") + 1)
    return whole.select(
        "surah", "start_ayah", "end_ayah", F.array_join(F.col("v.text"), " ").alias("text"),
        F.array_join(F.col("v.text_simple"), " ").alias("text_simple"), F.col("v.id").alias("verse_ids"),
    )


def surah_verses(corpus: DataFrame, number: int) -> DataFrame:
    return corpus.where(F.col("surah") == number).orderBy("ord")


def get_surah(surahs: DataFrame, number: int) -> DataFrame:
    return surahs.where(F.col("number") == number).limit(1)


#: Queries and texts of the corpus that are compared in one block.
QUERIES, TEXTS = 4000, 10_000
#: Characters of a table of texts, filled up to the longest, that are compared at once.
CELLS = 4_000_000


def _search_block(queries: pa.Table, verses: pa.Table, limit: int, floor: float) -> pa.Table:
    """The best ``limit`` verses of the block for each query of the block: what `Nearest.java` gives,
    stated in numpy for tests."""
    shape = pa.schema([("q", pa.string()), ("id", pa.int32()), ("surah", pa.int32()), ("ayah", pa.int32()), ("ord", pa.int64()), ("similarity", pa.float64())])
    if not queries.num_rows or not verses.num_rows:
        return shape.empty_table()
    verses = verses.take(pc.sort_indices(pc.utf8_length(verses.column("norm"))))
    asked, norms = queries.column("q").to_pylist(), verses.column("norm").to_pylist()
    order, rows, owners, found = verses.column("ord").to_numpy(), [], [], []
    at = 0
    while at < len(norms):  # verses of like length, as many as fit the table of their characters
        end = at + 1
        while end < len(norms) and (end + 1 - at) * len(norms[end]) <= CELLS:
            end += 1
        symbols, sizes = padded(norms[at:end])
        alphabet = np.unique(symbols)
        symbols = np.searchsorted(alphabet, symbols).astype(np.uint16 if len(alphabet) < 1 << 16 else np.int32)
        for k, q in enumerate(asked):
            # A similarity above the floor bounds the ratio of lengths.
            a, b = np.searchsorted(sizes, int(len(q) * floor)), np.searchsorted(sizes, len(q) / floor + 1, side="right") if floor > 0 else len(sizes)
            if a >= b:
                continue
            longer = np.maximum(sizes[a:b], len(q))
            near = np.where(longer > 0, 1.0 - distances(q, symbols[: int(sizes[b - 1]), a:b], sizes[a:b], alphabet) / np.maximum(longer, 1), 1.0)
            hit = np.flatnonzero(near > floor)
            best = hit[np.lexsort((order[at + a : at + b][hit], -near[hit]))[:limit]]
            rows.append(at + a + best)
            owners.append(np.full(len(best), k))
            found.append(near[best])
        at = end
    if not rows:
        return shape.empty_table()
    taken = verses.take(pa.array(np.concatenate(rows))).select(["id", "surah", "ayah", "ord"])
    texts = queries.column("q").take(pa.array(np.concatenate(owners)))
    return pa.Table.from_arrays([texts, *taken.columns, pa.array(np.concatenate(found))], names=shape.names).cast(shape)


def search(queries: DataFrame, corpus: DataFrame, limit: int = 10, floor: float = 0.3) -> DataFrame:
    """(qid, id, surah, ayah, similarity, rank): the ``limit`` most similar verses of each
    query (qid, query), above ``floor`` only, ties in corpus order.

    ``corpus`` is prepared.  Every query meets every verse of a length that can pass: both
    sides are cut into blocks of bounded size, a task compares one block with another
    in the JVM (`Nearest.java`) and keeps the best of each query, so that little is left
    to rank.  Null queries have no rows; an empty query finds verses that normalize to
    nothing.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    asked = materialize(queries.select("qid", normalize_arabic(F.col("query")).alias("q")).where(F.col("q").isNotNull()))
    texts = materialize(asked.select("q").distinct())
    verses = corpus.select(F.col("id").cast("int").alias("id"), F.col("surah").cast("int").alias("surah"), F.col("ayah").cast("int").alias("ayah"), F.col("ord").cast("long").alias("ord"), "norm").where(F.col("norm").isNotNull())
    n_queries, n_verses = texts.count(), verses.count()
    wide = max(1, -(-n_verses // TEXTS))
    tall = max(1, -(-n_queries // QUERIES), min(-(-tasks_for(queries.sparkSession) // wide), n_queries))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.select("q", part("q", tall).alias("i"), every(wide).alias("j"))
    right = verses.select(F.struct("norm", "id", "surah", "ayah", "ord").alias("v"), part("id", wide).alias("j"), every(tall).alias("i"))
    block = lambda df, c, name: df.repartition(wide * tall, "i", "j").groupBy("i", "j").agg(F.collect_list(c).alias(name))
    tiles = block(left, "q", "queries").join(block(right, "v", "verses"), ["i", "j"])
    nearest = jvm_function(queries.sparkSession, Path(__file__).with_name("Nearest.java"), "array<struct<q: string, id: int, surah: int, ayah: int, ord: bigint, similarity: double>>")
    met = tiles.select(F.inline(F.call_function(nearest, F.struct("queries", "verses", F.lit(min(limit, 2**31 - 1)), F.lit(float(floor))))))
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "ord")
    top = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return salted_join(asked, top.select("q", "id", "surah", "ayah", "similarity", "rank"), ["q"]).select("qid", "id", "surah", "ayah", "similarity", "rank")
