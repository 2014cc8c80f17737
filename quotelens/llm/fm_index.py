"""A compressed full-text index of many short texts, searched for many texts at once.

The index is the Burrows-Wheeler transform of the joined texts in a wavelet matrix
(one bit a character and level, with block counts), the boundaries of its suffixes'
common prefixes, and each suffix's owner.  Backward search runs for all queries in
lockstep; where a query cannot be extended to the left it falls back to the parent
interval, a shorter match ending earlier, so that every maximal match is met once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class _Bits:
    """A bit vector with rank in constant time: packed words and a count for each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class Wavelet:
    """Wavelet matrix of a sequence of symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[_Bits] = []
        current = symbols
        for b in range(levels - 1, -1, -1):
            bit = ((current >> b) & 1).astype(bool)
            self.levels.append(_Bits(bit))
            current = np.concatenate([current[~bit], current[bit]])
        every = np.arange(1 << levels)
        self.first = self._walk(every, np.zeros(1 << levels, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        top = len(self.levels) - 1
        for k, level in enumerate(self.levels):
            ones = level.rank(i)
            i = np.where((symbol >> (top - k)) & 1, level.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._walk(symbol, i) - self.first[symbol]


class FMIndex:
    """Index of ``texts`` (code-point arrays); each belongs to an owner, numbered from 0, -1
    to several.  Beside the wavelet bits it keeps five numbers of 32 bits a character."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray):
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = np.zeros(int((sizes + 1).sum()), np.uint32)
        ends = np.cumsum(sizes + 1) - 1
        body = np.ones(len(joined), bool)
        body[ends] = False
        joined[body] = np.concatenate(texts) if len(texts) else joined[body]
        self.alphabet = np.unique(joined[body])
        code = np.zeros(len(joined), np.int64)
        code[body] = np.searchsorted(self.alphabet, joined[body]) + 1
        n = len(code)
        bits = max(1, int(len(self.alphabet)).bit_length())
        order, lcp = self._sort(code, bits, int(sizes.max(initial=0)), ends)
        self.n = n
        last = code[order - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.alphabet) + 1))])
        self.wavelet = Wavelet(last, bits)
        own = np.repeat(np.asarray(owners, np.int64), sizes + 1)[order]
        self.owner = np.append(own, -2).astype(np.int32)
        change = np.flatnonzero(np.r_[own[1:] != own[:-1], True]) + 1
        self.other = np.append(change[np.searchsorted(change, np.arange(n), side="right")], n).astype(np.int32)  # next suffix of another owner
        self.lcp = lcp.astype(np.int32)
        self.left = (n - self._smaller(self.lcp[::-1])[::-1]).astype(np.int32)
        self.right = self._smaller(self.lcp).astype(np.int32)

    @staticmethod
    def _sort(code: np.ndarray, bits: int, depth: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their first ``depth`` symbols at least, and the length
        of the common prefix of each with the one before it (-1 at both ends)."""
        n, packed = len(code), max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for k in range(packed):
            key <<= bits
            if k < n:
                key[: n - k] |= code[k:]
        ranks, reach = [], packed
        while True:
            order = np.argsort(key)
            new = np.r_[False, key[order[1:]] != key[order[:-1]]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) + 1
            ranks.append((reach, rank))
            if reach > depth:
                break
            key = rank * (n + 2)
            if reach < n:
                key[: n - reach] += rank[reach:]
            reach *= 2
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int64)

        def follow(same: np.ndarray, by: int) -> None:
            common[same] += by
            a[same] += by
            b[same] += by

        for h, rank in reversed(ranks):
            room = (a + h <= n) & (b + h <= n) & (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[room] = rank[a[room]] == rank[b[room]]
            follow(same, h)
        alive = np.ones(len(a), bool)
        for _ in range(packed):
            alive &= (a < n) & (b < n)
            alive[alive] = code[a[alive]] == code[b[alive]]
            follow(alive, 1)
        rest = ends[np.searchsorted(ends, order[1:])] - order[1:]  # a match ends with its text
        return order, np.concatenate([[-1], np.minimum(common, rest), [-1]])

    @staticmethod
    def _smaller(x: np.ndarray) -> np.ndarray:
        """For each place the next one to the right with a smaller value (the last: itself)."""
        n = len(x)
        nxt = np.minimum(np.arange(1, n + 1), n - 1)
        todo = np.flatnonzero(x[nxt] >= x)
        todo = todo[todo < n - 1]
        while len(todo):
            nxt[todo] = nxt[nxt[todo]]
            todo = todo[(x[nxt[todo]] >= x[todo]) & (nxt[todo] < n - 1)]
        return nxt

    def matches(self, queries: list[np.ndarray], owners: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Maximal stretches (query, start, end) of at least ``least`` characters that also
        stand in an indexed text of another owner."""
        sizes = np.array([len(q) for q in queries], np.int64)
        if not len(sizes) or self.n <= 1:
            return
        flat = np.concatenate(queries)
        at = np.searchsorted(self.alphabet, flat)
        at[at == len(self.alphabet)] = 0
        code = np.where(self.alphabet[at] == flat, at + 1, 0)
        base = np.cumsum(sizes) - sizes
        q = np.flatnonzero(sizes >= least)
        p = sizes[q] - 1
        lo, hi, length = np.zeros(len(q), np.int64), np.full(len(q), self.n), np.zeros(len(q), np.int64)
        own = np.asarray(owners, np.int64)[q]
        while len(q):
            c = np.where(p >= 0, code[base[q] + np.maximum(p, 0)], 0)
            both = self.wavelet.rank(np.r_[c, c], np.r_[lo, hi])
            new_lo, new_hi = self.less[c] + both[: len(q)], self.less[c] + both[len(q) :]
            go = (c > 0) & (new_hi > new_lo)
            first = np.where(go, new_lo, 0)
            go &= (self.owner[first] != own) | (self.other[first] < new_hi)
            stuck = ~go
            hit = stuck & (length >= least)
            if hit.any():
                yield q[hit], p[hit] + 1, p[hit] + 1 + length[hit]
            lo, hi = np.where(go, new_lo, lo), np.where(go, new_hi, hi)
            length, p = length + go, p - go
            # Fall back to the parent interval; from the empty match go one place on.
            k = np.where(self.lcp[lo] >= self.lcp[hi], lo, hi)
            short = self.lcp[k]
            none = stuck & (length == 0)
            fall = stuck & ~none
            root = fall & (short <= 0)
            inner = fall & ~root
            lo = np.where(inner, self.left[k], np.where(root | none, 0, lo))
            hi = np.where(inner, self.right[k], np.where(root | none, self.n, hi))
            length = np.where(inner, short, np.where(root | none, 0, length))
            p = p - none
            keep = (p + 1 + length >= least) & ((p >= 0) | ~stuck)
            if not keep.all():
                q, p, lo, hi, length, own = (x[keep] for x in (q, p, lo, hi, length, own))
