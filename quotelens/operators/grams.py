"""n-grams of whole Arrow batches at once, as 64-bit hashes that are the same in every
process.  Two n-grams that fall together only add candidates: what is found by n-grams
is always compared text by text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of texts that are worked on at once.
SCAN_CHARS = 2_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers whose bits all depend on all bits of ``h``."""
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[0]
    return h ^ (h >> np.uint64(30))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(ids, texts) of batches (id, s), a bounded number of characters at a time."""
    for batch in batches:
        ids, texts, at, chars = batch.column("id").to_numpy(), batch.column("s").to_pylist(), 0, 0
        for k, t in enumerate(texts):
            chars += len(t)
            if chars >= SCAN_CHARS or k == len(texts) - 1:
                yield ids[at : k + 1], texts[at : k + 1]
                at, chars = k + 1, 0


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the joined texts, the text that each belongs to, and the lengths."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return code, np.repeat(np.arange(len(texts)), sizes), sizes


def gram_hashes(code: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every n-gram, in order."""
    count = len(code) - n + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = h * _MIX[0] + code[k : k + count]
    whole = owner[:count] == owner[n - 1 :]
    return owner[:count][whole], mixed(h[whole])


def distinct_grams(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], own: bool) -> Iterator[pa.RecordBatch]:
    """(id, gram): distinct n-grams of each text (id, s), of all ``sizes``; with ``own`` only
    of the largest size that the text is long enough for."""
    for ids, texts in pieces(batches):
        code, owner, length = packed(texts)
        found = []
        for n in sizes:
            o, h = gram_hashes(code, owner, n)
            if own:
                mine = (length[o] == n) if n < max(sizes) else np.ones(len(o), bool)
                o, h = o[mine], h[mine]
            order = np.lexsort((h, o))
            o, h = o[order], h[order]
            new = np.r_[True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])] if len(h) else np.empty(0, bool)
            found.append((ids[o[new]], h[new]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b.view(np.int64))], names=["id", "gram"])
