"""Documents in containers of a fixed number of tokens (problem 6).

Method: shortest-pack-first over the length histogram.  Lengths are placed longest
first; each goes to the pack with the most space left if it fits there, else to a new
pack.  Packs of the same content are one pattern with a count, so the work depends on
the number of lengths, not of documents, and the histogram (at most ``capacity`` counts)
is all that the driver sees.  Patterns are joined back by rank: the documents of one
length are numbered, split into parts where there are many, and each stretch of
numbers belongs to one pattern.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelens.plans.runtime import materialize

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Documents of one length that one task numbers.
RANKED = 500_000
#: Ids of the packing table's stretches that are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_STRETCHES = 200_000

# Fixed value: how the public byte-level vocabulary splits text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(path).encode_ordinary
    for batch in batches:
        counts = [len(encode(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of documents whose text is not null or blank."""
    kept = documents.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "text")
    return kept.mapInArrow(partial(_count_tokens, path=tokenizer), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one pack, longest first) with their counts."""
    spaces: list[int] = []  # spaces left in open packs, ascending
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    full: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, space: int) -> None:
        if not space:
            full.append((pattern, count))
        elif space in open_packs:
            open_packs[space].append((pattern, count))
        else:
            open_packs[space] = [(pattern, count)]
            bisect.insort(spaces, space)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit capacity {capacity}")
        while left:
            if spaces and spaces[-1] >= length:
                space = spaces[-1]
                pattern, count = open_packs[space].pop()
                if not open_packs[space]:
                    del open_packs[space]
                    spaces.pop()
                used = min(count, left)
                if count > used:
                    put(pattern, count - used, space)
                put((*pattern, length), used, space - length)
                left -= used
            else:  # new packs; items of one length go on filling the pack they opened
                each = capacity // length
                packs, rest = divmod(left, each)
                if packs:
                    put((length,) * each, packs, capacity - each * length)
                if rest:
                    put((length,) * rest, 1, capacity - rest * length)
                left = 0
    return full + [p for s in spaces for p in open_packs[s]]


def stretches(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first container, items of the length in each)."""
    out, base, used = [], 0, {}
    for pattern, count in patterns:
        for length in sorted(set(pattern)):
            copies = pattern.count(length)
            first = used.get(length, 0)
            used[length] = first + copies * count
            out.append((length, first, used[length], base, copies))
        base += count
    return out


def pack_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, part_tokens, container_id) of ``items`` (doc_id, n_tokens).

    An item of at most ``capacity`` tokens is one part; a longer one fills whole
    containers and its rest is placed like any other item.  Items of null, zero or
    negative size need no container.  Repeated rows are items of their own.  An
    empty table gives no rows.
    """
    sized = items.where(F.col("n_tokens") > 0).select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    parts = materialize(
        sized.select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("part", "p"))
        .select("doc_id", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("p").cast("bigint") * capacity).cast("int").alias("part_tokens"))
        .withColumn("at", F.xxhash64("doc_id", "part"))
    )
    histogram = dict(parts.groupBy("part_tokens").count().toArrow().to_pandas().itertuples(index=False, name=None))
    table = stretches(pack_histogram(histogram, capacity))
    spark = items.sparkSession
    pieces = {n: -(-c // RANKED) for n, c in histogram.items() if c > RANKED}
    split = F.coalesce(F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv])[F.col("part_tokens")], F.lit(1)) if pieces else F.lit(1)
    placed = parts.withColumn("piece", F.pmod("at", split).cast("int"))
    sizes = placed.groupBy("part_tokens", "piece").count()
    before = Window.partitionBy("part_tokens").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part_tokens", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("part_tokens", "piece").orderBy("at", "doc_id", "part")
    ranked = placed.withColumn("n", F.row_number().over(order)).join(offsets, ["part_tokens", "piece"]).withColumn("rank", F.col("offset") + F.col("n") - 1)
    places = spark.createDataFrame(table, "part_tokens int, first_rank long, end_rank long, base long, copies int")
    places = F.broadcast(places) if len(table) <= BROADCAST_STRETCHES else places
    found = ranked.join(places, "part_tokens").where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    container = F.col("base") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("copies"))
    return found.select("doc_id", "part", "part_tokens", container.cast("bigint").alias("container_id"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack_items`` of ``documents`` (doc_id, text), sized in tokens; blank texts need none."""
    return pack_items(token_counts(documents, tokenizer), capacity)
