"""Edit distance of one text to many at once, bit-parallel (Myers 1999, in blocks of 64 as
Hyyrö 2003): a column of the table is two bit vectors, and numpy takes one step of all
texts together.  Unbounded distances of many pairs are an order faster so than with the
built-in expression, which fills the whole table of each pair."""

from __future__ import annotations

import numpy as np

_ONE, _TOP = np.uint64(1), np.uint64(63)


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one text a column, and the lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), int(sizes.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(out.T), sizes


def distances(pattern: str, symbols: np.ndarray, sizes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Edit distances of ``pattern`` to texts in ascending order of length.

    ``symbols`` holds a text a column, as places in the sorted ``alphabet``; rows beyond
    a text's length are ignored.
    """
    m, n = len(pattern), len(sizes)
    if not m or not n:
        return sizes.copy()
    code = np.frombuffer(pattern.encode("utf-32-le", "surrogatepass"), np.uint32)
    blocks = -(-m // 64)
    at = np.minimum(np.searchsorted(alphabet, code), max(len(alphabet) - 1, 0))
    there = alphabet[at] == code if len(alphabet) else np.zeros(m, bool)
    masks = np.zeros((blocks, max(len(alphabet), 1)), np.uint64)
    place = np.flatnonzero(there)
    np.bitwise_or.at(masks, (place // 64, at[place]), _ONE << (place % 64).astype(np.uint64))
    up, down = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    out = np.full(n, m, np.int64)
    last = np.uint64((m - 1) % 64)
    start = np.searchsorted(sizes, np.arange(symbols.shape[0]), side="right")  # texts that go on
    for j in range(symbols.shape[0]):
        a = int(start[j])
        if a >= n:
            break
        row = symbols[j, a:]
        plus, minus = np.ones(n - a, np.uint64), np.zeros(n - a, np.uint64)  # carried into a block's lowest place
        for b in range(blocks):
            eq, vp, vn = masks[b][row], up[b, a:], down[b, a:]
            xv = eq | vn
            eq |= minus
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp, hn = vn | ~(xh | vp), vp & xh
            if b == blocks - 1:
                out[a:] += ((hp >> last) & _ONE).astype(np.int64) - ((hn >> last) & _ONE).astype(np.int64)
            plus, hp, minus, hn = hp >> _TOP, (hp << _ONE) | plus, hn >> _TOP, (hn << _ONE) | minus
            up[b, a:] = hn | ~(xv | hp)
            down[b, a:] = hp & xv
    return out
