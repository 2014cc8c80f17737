"""Pairs of similar texts of two blocks, by counting the n-grams that they share, and texts
that stand in one another, by the rarest of them.

Texts within d edits share all but d times n of the longer one's n-grams, so a text is
looked up by its rarest ones until those that are left cannot make up for it.  What
meets often enough is compared by its letters; the edit distance is left to the caller.
Nothing is written: the counts of a block are kept in memory, text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quotelens.operators.grams import SCAN_CHARS, gram_hashes, mixed, packed

#: n-grams are told apart by so many bits; those that fall together only add candidates.
BITS = 22
#: Characters up to which the n-grams shared are counted length by length.
SHARED_CHARS = 4096
#: Least part of a text's n-grams that a similar one must share for this n to be used.
LEAST_PART = 0.12
#: n-grams that must meet among the rarest ones, where the texts share as many: so many, or
#: this part of them; more where the texts need not share a third of all.
MEETINGS, MEET_PART, WEAK_MEETINGS = 10, 0.4, 24
#: Letters counted one by one; the rest are counted together.
LETTERS = 31
#: Pairs of letters are counted in so many buckets, in texts of at most so many characters.
DUOS, DUO_CHARS = 512, 255
#: Candidates that are compared by letters at once.
PAIRS = 200_000


def longest(n: int, threshold: float) -> int:
    """Characters of the longest text that can be similar to one of n."""
    return int(n / threshold + 1e-9)


def least_shared(n: int, size: int, threshold: float) -> int:
    """n-grams that a text of n characters shares at least with a similar one that is no
    shorter: each edit spoils ``size`` of the longer one's."""
    of = lambda m: m - size + 1 - size * int((1 - threshold) * m + 1e-9)
    if n > SHARED_CHARS and size * (1 - threshold) < 1:  # grows with m, but for one edit's worth
        return max(of(n) - size, 0)
    return min(map(of, range(n, longest(n, threshold) + 1)))


def size_for(n: int, threshold: float, largest: int) -> int:
    """The longest n-grams of which texts similar to one of n characters share a good part."""
    usable = [s for s in range(largest, 1, -1) if s * (1 - threshold) < 1]
    return next((s for s in usable if least_shared(n, s, threshold) >= max(2, LEAST_PART * n)), 1)


def numbered(keys: np.ndarray) -> np.ndarray:
    """Sorted (n-gram, text) keys, equal ones told apart by their number, sorted again."""
    same = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    if not len(same):
        return keys
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    number = (same - first[np.searchsorted(first, same, side="right") - 1]).astype(np.uint64)
    other = mixed((keys[same].view(np.uint64) >> np.uint64(32)) + (number << np.uint64(40))) & np.uint64((1 << BITS) - 1)
    keys[same] = (other << np.uint64(32)).view(np.int64) | keys[same] & 0xFFFFFFFF
    keys.sort()
    return keys


def gram_keys(texts: list[str], size: int, each: bool = True) -> np.ndarray:
    """(n-gram, text) of all n-grams in one number each, sorted; without ``each``, n-grams
    that a text has several times count once."""
    found, at, chars = [], 0, 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= SCAN_CHARS or k == len(texts) - 1:
            code, owner, _ = packed(texts[at : k + 1])
            o, h = gram_hashes(code, owner, size)
            found.append((h & np.uint64((1 << BITS) - 1)).astype(np.int64) << 32 | o + at)
            at, chars = k + 1, 0
    keys = np.concatenate(found) if found else np.empty(0, np.int64)
    keys.sort()
    return numbered(keys) if each else keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def letters(texts: list[str], own: np.ndarray) -> np.ndarray:
    """How often each text has each letter of ``own``, and any other."""
    out = np.zeros((len(texts), len(own) + 1), np.int32)
    place_of = np.full(0x110000, len(own), np.uint8)
    place_of[own] = np.arange(len(own))
    at, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= SCAN_CHARS or k == len(texts) - 1:
            code, owner, _ = packed(texts[at : k + 1])
            out[at : k + 1] = np.bincount(owner * (len(own) + 1) + place_of[code], minlength=(k + 1 - at) * (len(own) + 1)).reshape(-1, len(own) + 1)
            at, chars = k + 1, 0
    return out


def duos(texts: list[str]) -> np.ndarray:
    """How many pairs of neighbouring letters of each text fall into each bucket; none are
    counted of texts that are too long for it."""
    out, step = np.zeros((len(texts), DUOS), np.uint8), SCAN_CHARS // DUO_CHARS
    for at in range(0, len(texts), step):
        code, owner, _ = packed([t if len(t) <= DUO_CHARS else "" for t in texts[at : at + step]])
        o, h = gram_hashes(code, owner, 2)
        n = min(step, len(texts) - at)
        out[at : at + n] = np.bincount(o * DUOS + (h % np.uint64(DUOS)).astype(np.int64), minlength=n * DUOS).reshape(n, DUOS)
    return out


def near_pairs(left: list[str], right: list[str], threshold: float, largest: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``left`` and ``right`` of all pairs, and of few others, whose similarity is
    at least ``threshold``; no text is empty, and both are in ascending order of length."""
    if not left or not right:
        return
    a_len, b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    low = np.searchsorted(b_len, np.ceil(threshold * a_len - 1e-9).astype(np.int64))
    high = np.searchsorted(b_len, np.array([longest(n, threshold) for n in a_len.tolist()]), side="right")
    code = packed(right[:: max(1, len(right) // 20_000)])[0]
    symbol, often = np.unique(code, return_counts=True)
    own = symbol[np.argsort(-often)[:LETTERS]]
    a_bag, b_bag = letters(left, own), letters(right, own)
    sizes = {n: size_for(n, threshold, largest) for n in np.unique(a_len).tolist()}
    size_of = np.array([sizes[n] for n in a_len.tolist()])
    weak = any(3 * least_shared(n, s, threshold) < n for n, s in sizes.items())
    a_duo, b_duo = (duos(left), duos(right)) if weak else (None, None)

    def close(a: list[int], b: list[np.ndarray], met: list[np.ndarray], slack: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
        n = [len(x) for x in b]
        i, j = np.repeat(np.array(a), n), np.concatenate(b)
        longer = np.maximum(a_len[i], b_len[j])
        shared = longer - size + 1 - size * ((1 - threshold) * longer + 1e-9).astype(np.int64)
        kept = np.concatenate(met) >= shared - np.repeat(np.array(slack), n)
        i, j = i[kept], j[kept]
        longer = longer[kept]
        more = a_bag[i] - b_bag[j]
        plus, both = np.maximum(more, 0).sum(axis=1), more.sum(axis=1)
        kept = np.maximum(plus, plus - both) <= (1 - threshold) * longer + 1e-9
        i, j, longer = i[kept], j[kept], longer[kept]
        if weak:
            shared = longer - 1 - 2 * ((1 - threshold) * longer + 1e-9).astype(np.int64)
            common = [np.minimum(a_duo[i[k : k + 20_000]], b_duo[j[k : k + 20_000]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 20_000)]
            kept = (np.concatenate(common) >= shared) | (longer > DUO_CHARS) if common else kept[:0]
            i, j = i[kept], j[kept]
        return i, j

    for size in np.unique(size_of).tolist():
        mine = np.flatnonzero(size_of == size)
        base, end = int(low[mine].min()), int(high[mine].max())
        if base >= end:
            continue
        keys = gram_keys(right[base:end], size)
        held = (keys & 0xFFFFFFFF).astype(np.int32)
        shared = {n: least_shared(n, size, threshold) for n in np.unique(a_len[mine]).tolist()}
        at = 0
        a, b, met, slack, total = [], [], [], [], 0
        while at < len(mine):
            step = mine[at : at + max(1, SCAN_CHARS // 8 // int(a_len[mine[min(at + 1000, len(mine) - 1)]]))][:1000]
            at += len(step)
            own_keys = gram_keys([left[k] for k in step.tolist()], size)
            own_text = own_keys & 0xFFFFFFFF
            gram = own_keys - own_text
            start = np.searchsorted(keys, gram + (low[step] - base)[own_text])
            stop = np.searchsorted(keys, gram + (high[step] - base)[own_text])
            order = np.lexsort((stop - start, own_text))
            start, stop = start[order].tolist(), stop[order].tolist()
            first = np.searchsorted(own_text[order], np.arange(len(step) + 1)).tolist()
            for k, text in enumerate(step.tolist()):
                share = shared[int(a_len[text])]
                meet = max(1, min(share, max(MEETINGS if 3 * share >= int(a_len[text]) else WEAK_MEETINGS, int(share * MEET_PART))))
                s, e = first[k], first[k + 1] - share + meet
                hits = np.concatenate([held[x:y] for x, y in zip(start[s:e], stop[s:e], strict=True) if x < y] or [held[:0]])
                if len(hits) < meet:
                    continue
                width = int(high[text] - low[text])
                if len(hits) * 4 > width:
                    count = np.bincount(hits - (low[text] - base), minlength=width)
                    there = np.flatnonzero(count >= meet)
                    count, there = count[there], there + low[text]
                else:
                    hits.sort()
                    there = hits[meet - 1 :][hits[meet - 1 :] == hits[: len(hits) - meet + 1]]
                    there = there[np.r_[True, there[1:] != there[:-1]]] if len(there) else there
                    count = np.searchsorted(hits, there, side="right") - np.searchsorted(hits, there)
                    there = there.astype(np.int64) + base
                if not len(there):
                    continue
                a.append(text)
                b.append(there)
                met.append(count)
                slack.append(share - meet)
                total += len(there)
                if total >= PAIRS:
                    yield close(a, b, met, slack, size)
                    a, b, met, slack, total = [], [], [], [], 0
        if a:
            yield close(a, b, met, slack, size)


def first_contained(asked: list[str], known: list[str]) -> Iterator[tuple[int, int, bool]]:
    """Of each text of ``asked`` that stands in one of ``known``, or in which one stands: its
    place, the place of the first such text, and whether ``asked`` is the one inside.  No
    text is empty, and no two of one side are equal.

    A text is looked for by its rarest n-gram (n = 3, or its length): among the texts of
    ``known`` that have it, and, the other way round, where it turns up in ``asked``; then
    its next rarest ones must be there too.
    """
    short = {len(t) for t in asked + known if len(t) < 3}
    sizes = (*sorted(short), 3)
    keys = {n: gram_keys(known, n, False) for n in sizes}
    held = {n: (keys[n] & 0xFFFFFFFF).astype(np.int32) for n in sizes}
    often = {n: np.bincount(keys[n] >> 32, minlength=1 << BITS) for n in sizes}
    length = np.fromiter(map(len, known), np.int64, len(known))
    anchors = {}  # by size: grams in order, their texts, and two more grams of each text
    for n in sizes:
        mine, found = np.flatnonzero(length == n if n < 3 else length >= 3), []
        for at in range(0, len(mine), 20_000):
            some = mine[at : at + 20_000]
            own = gram_keys([known[k] for k in some.tolist()], n, False)
            gram, text = own >> 32, own & 0xFFFFFFFF
            order = np.lexsort((often[n][gram], text))
            gram, text = gram[order], text[order]
            first, last = np.searchsorted(text, np.arange(len(some))), np.searchsorted(text, np.arange(len(some)), side="right") - 1
            found.append((gram[first], some, gram[np.minimum(first + 1, last)], gram[np.minimum(first + 2, last)]))
        if found:
            each = [np.concatenate(x) for x in zip(*found, strict=True)]
            by = np.argsort(each[0], kind="stable")
            anchors[n] = tuple(x[by] for x in each)
    seen = {n: np.zeros(1 << BITS, bool) for n in anchors}
    for at in range(0, len(asked), 1000):
        some = asked[at : at + 1000]
        own = {n: gram_keys(some, n, False) for n in sizes}
        bounds = {}
        for n, k in own.items():
            order = np.argsort(k & 0xFFFFFFFF, kind="stable")
            gram, text = k[order] >> 32, k[order] & 0xFFFFFFFF
            bounds[n] = (gram, np.searchsorted(text, np.arange(len(some) + 1)).tolist())
        for i, t in enumerate(some):
            best, inside = len(known), False
            n = min(len(t), 3)
            gram, cut = bounds[n]
            gram = gram[cut[i] : cut[i + 1]]
            gram = gram[np.argsort(often[n][gram], kind="stable")[:3]]
            start, stop = np.searchsorted(keys[n], gram << 32).tolist(), np.searchsorted(keys[n], gram + 1 << 32).tolist()
            met = held[n][start[0] : stop[0]]
            for a, b in zip(start[1:], stop[1:], strict=True):
                if len(met) > 8:
                    other = held[n][a:b]
                    place = np.searchsorted(other, met)
                    met = met[(place < len(other)) & (other[np.minimum(place, max(len(other) - 1, 0))] == met)] if len(other) else met[:0]
            for k in met.tolist():
                if t in known[k]:
                    best, inside = k, True
                    break
            for n, (grams, texts, second, third) in anchors.items():
                if n > len(t):
                    continue
                gram, cut = bounds[n]
                gram = gram[cut[i] : cut[i + 1]]
                start, stop = np.searchsorted(grams, gram), np.searchsorted(grams, gram, side="right")
                some_of = [(a, b) for a, b in zip(start.tolist(), stop.tolist(), strict=True) if a < b]
                if not some_of:
                    continue
                seen[n][gram] = True
                place = np.concatenate([np.arange(a, b) for a, b in some_of])
                place = place[seen[n][second[place]] & seen[n][third[place]]]
                seen[n][gram] = False
                place = texts[place]
                for k in np.sort(place[(length[place] <= len(t)) & (place < best)]).tolist():
                    if known[k] in t:
                        best, inside = k, False
                        break
            if best < len(known):
                yield at + i, best, inside
