"""Language of documents and of passages within them (problem 8).

Method: rank-order profiles.  Each language's samples give a list of its most frequent
n-grams; a segment's own list is compared with each of them by out-of-place distance:
the sum over the segment's n-grams of how far their ranks are apart, with a fixed
penalty for those the language's list lacks.  Segments are sentences, with short ones
joined to the next; the words of a text are looked up in a table of their n-grams, and
all segments of an Arrow batch are counted, ranked and compared at once in numpy.

Profiles come from a bounded, documented sample (``MAX_SAMPLES`` labelled rows);
everything else covers every character of every document.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows used for the profiles at most; n-gram lengths; ranks kept per language.
MAX_SAMPLES, LENGTHS, PROFILE = 20_000, (1, 2, 3, 4), 300
#: Ranks of a segment that are compared; words after which a sentence end ends a segment.
RANKS, SEGMENT_WORDS = 120, 10
#: Words that carry evidence (not names) which a segment needs for a language of its own.
EVIDENCE = 6
#: Words in a row that make a language part of a document.
RUN_WORDS = 20
#: A segment of less confidence has no language of its own and goes with its neighbours.
LEAST_CONFIDENCE = 0.08
#: Words of a process's table before it is built anew.
CACHE_WORDS = 400_000

#: What a text is called whose words hold no n-gram of any profile.
UNKNOWN = "und"

_TOKEN = re.compile(r"[^\W\d_]+|[.;!?:…؟؛۔]+(?=[\s»”\"')])|\n")
#: Vowel marks of Hebrew and Arabic: optional in writing, and they would cut words.
_MARKS = re.compile("[\u0591-\u05c7\u064b-\u065f\u0670\u06d6-\u06ed]")
_RUN_NAMES = ("segment", "first_word", "n_words", "seg_lang", "confidence", "n_languages")
_RUNS = "segment int, first_word int, n_words int, seg_lang string, confidence double, n_languages int"

# How the languages are named besides their two-letter codes.
LANGUAGE_NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"), "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch"),
}


def ngrams(word: str) -> list[str]:
    """All n-grams of a word with '_' at both ends."""
    w = f"_{word}_"
    return [w[i : i + n] for n in LENGTHS for i in range(len(w) - n + 1) if not (n == 1 and w[i] == "_")]


def tokens(text: str) -> list[str]:
    """Words, sentence ends and line ends of a text, canonically composed."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _MARKS.sub("", text)
    return _TOKEN.findall(text)


def caseless(word: str) -> bool:
    """Of a script without upper and lower case, in which names can't be told."""
    return word.lower() == word.upper()


class Profiles:
    """Rank lists of the languages over one common list of n-grams."""

    def __init__(self, samples: list[tuple[str, str]]):
        counts: dict[str, Counter] = {}
        for lang, text in samples:
            own = counts.setdefault(lang, Counter())
            words = [w for w in tokens(text) if w[0].isalpha()]
            for w in [w for w in words if w.islower() or caseless(w)] or words:
                own.update(ngrams(w.lower()))
        counts = {lang: own for lang, own in counts.items() if own}
        self.languages = sorted(counts)
        lists = [[g for g, _ in sorted(counts[x].items(), key=lambda kv: (-kv[1], kv[0]))[:PROFILE]] for x in self.languages]
        best: dict[str, int] = {}
        for own in lists:
            for r, g in enumerate(own):
                best[g] = min(r, best.get(g, r))
        self.grams = {g: i for i, g in enumerate(sorted(best, key=lambda g: (best[g], g)))}
        # Rank of each n-gram in each language; one past the list where it is absent.
        self.ranks = np.full((len(self.languages), len(self.grams)), PROFILE, np.int32)
        for k, own in enumerate(lists):
            for r, g in enumerate(own):
                self.ranks[k, self.grams[g]] = r


class _Words(dict):
    """Token -> number; 0 is a line end, 1 a sentence end, 2 a word without evidence.

    Capitalized words are mostly names and give evidence only if ``names`` is set."""

    def __init__(self, grams: dict[str, int], names: bool = False):
        super().__init__({"\n": 0})
        self.known, self.table, self.names = grams, [(), (), ()], names

    def __missing__(self, token: str) -> int:
        if not token[0].isalpha():
            n = 1
        elif not (self.names or token.islower() or len(token) > 1 and token.isupper() or caseless(token)):
            n = 2
        else:
            found = [g for x in ngrams(token.lower()) if (g := self.known.get(x)) is not None]
            self.table.append(found)
            n = len(self.table) - 1
        self[token] = n
        return n


def _distances(words: np.ndarray, segment: np.ndarray, n_segments: int, table: list, prof: Profiles) -> np.ndarray:
    """Out-of-place distance of each segment to each language, as a share of the worst."""
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    flat = np.fromiter((g for x in table for g in x), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    d = len(prof.grams)
    bits = d.bit_length()
    if bits > 30:
        raise ValueError("too many n-grams in the profiles")
    out = np.empty((n_segments, len(prof.languages)))
    step = max(1, 2_000_000 // d)
    cuts = np.searchsorted(segment, np.arange(0, n_segments + step, step))
    for part in range(len(cuts) - 1):
        w, s = words[cuts[part] : cuts[part + 1]], segment[cuts[part] : cuts[part + 1]] - part * step
        n = min(step, n_segments - part * step)
        if n <= 0:
            break
        reps = sizes[w]
        total = int(reps.sum())
        place = np.repeat(starts[w] - (np.cumsum(reps) - reps), reps) + np.arange(total)
        counts = np.bincount(np.repeat(s * d, reps) + flat[place], minlength=n * d).reshape(n, d)
        # Count and n-gram in one number, in half the width where that is wide enough.
        kind = np.int32 if int(counts.max()) < 1 << (31 - bits) else np.int64
        coded = (counts.astype(kind) << bits) + np.arange(d - 1, -1, -1, dtype=kind)
        top = -np.sort(-coded if d <= RANKS else -np.partition(coded, d - RANKS, axis=1)[:, d - RANKS :], axis=1)
        gram, held = d - 1 - (top & ((1 << bits) - 1)), top >= 1 << bits
        rank = np.arange(top.shape[1], dtype=np.int32)
        worst = np.maximum(held.sum(1), 1) * PROFILE
        for k in range(len(prof.languages)):
            gap = np.abs(prof.ranks[k][gram] - rank)
            gap[prof.ranks[k][gram] == PROFILE] = PROFILE
            out[part * step : part * step + n, k] = (gap * held).sum(1) / worst
    return out


def _segment(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Segment number of each token.  A line's end and a document's always end a
    segment, a sentence's end does once the segment has enough words."""
    is_word = words >= 2
    hard = (words == 0) | np.r_[doc[1:] != doc[:-1], True]
    ends = np.flatnonzero(~is_word | hard)
    total = np.cumsum(is_word)[ends]
    seg = np.empty(len(words), np.int64)
    current, at, held = 0, 0, 0
    for e, n, always in zip(ends.tolist(), total.tolist(), hard[ends].tolist()):
        if always or n - held >= SEGMENT_WORDS:
            seg[at : e + 1] = current
            current, at, held = current + 1, e + 1, n
    return seg


def _runs(parts: list[np.ndarray], table: list, prof: Profiles, whole: bool = False) -> list[list[tuple[int, int, str, float]]]:
    """For each text, given as word numbers, its runs of one language: first word, words,
    language, confidence.  ``whole``: each text is one segment and its nearest language
    counts, however little evidence there is."""
    words = np.concatenate(parts)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    out: list[list] = [[] for _ in parts]
    if not len(words):
        return out
    seg = np.unique(doc, return_inverse=True)[1] if whole else _segment(words, doc)
    n = int(seg[-1]) + 1
    dist = _distances(words, seg, n, table, prof)
    order = np.argsort(dist, axis=1, kind="stable")
    best = np.take_along_axis(dist, order[:, :1], 1)[:, 0]
    second = np.take_along_axis(dist, order[:, 1:2], 1)[:, 0] if dist.shape[1] > 1 else np.ones(n)
    conf = np.where(second > 0, (second - best) / np.maximum(second, 1e-9), 0)
    n_words, evidence = np.bincount(seg[words >= 2], minlength=n), np.bincount(seg[words >= 3], minlength=n)
    sure = n_words > 0 if whole else (evidence >= EVIDENCE) & (conf >= LEAST_CONFIDENCE)
    known = np.bincount(seg, np.fromiter(map(len, table), np.int64, len(table))[words], n) > 0
    seg_doc = np.zeros(n, np.int64)
    seg_doc[seg] = doc
    at, last_doc = 0, -1
    for d, c, b, x, ok, some in zip(seg_doc.tolist(), n_words.tolist(), order[:, 0].tolist(), conf.tolist(), sure.tolist(), known.tolist()):
        if d != last_doc:
            at, last_doc = 0, d
        if ok:
            own, lang = out[d], prof.languages[b] if some else UNKNOWN
            if own and own[-1][2] == lang:
                a, _, _, y, k = own[-1]
                own[-1] = (a, at + c - a, lang, y + x * c, k + c)
            else:
                own.append((at, c, lang, x * c, c))
        at += c
    all_words = np.bincount(doc[words >= 2], minlength=len(parts))
    for d, own in enumerate(out):
        if own and not any(r[1] >= RUN_WORDS for r in own):
            most = Counter()
            for r in own:
                most[r[2]] += r[1]
            lang = most.most_common(1)[0][0]
            own[:] = [(0, int(all_words[d]), lang, sum(r[3] for r in own if r[2] == lang), sum(r[4] for r in own if r[2] == lang))]
    return [[(a, m, lang, y / k) for a, m, lang, y, k in own] for own in out]


def classify(texts: list[str | None], prof: Profiles, caches: tuple[_Words, _Words]) -> list[list[tuple[int, int, str, float]]]:
    """For each text its runs of one language: first word, words, language, confidence.

    A segment without enough evidence or confidence counts with a run that goes on after
    it.  Where no run is long enough, the language of most words gets the whole text.  A
    text without any sure segment is looked at again with its capitalized words, then as
    one segment of whatever evidence, so that every text with a word has a language
    (``UNKNOWN`` where no n-gram of its words is known).
    """
    out: list[list] = [[] for _ in texts]
    if not prof.languages:
        return out
    spelt = [tokens(t) if t else [] for t in texts]
    todo = [k for k, own in enumerate(spelt) if own]
    for cache, whole in ((caches[0], False), (caches[1], False), (caches[1], True)):
        if todo:
            parts = [np.fromiter(map(cache.__getitem__, spelt[k]), np.int64, len(spelt[k])) for k in todo]
            for k, own in zip(todo, _runs(parts, cache.table, prof, whole), strict=True):
                out[k] = own
            todo = [k for k in todo if not out[k]]
    return out


def word_caches(prof: Profiles) -> tuple[_Words, _Words]:
    """The word tables ``classify`` takes: without and with names."""
    return _Words(prof.grams), _Words(prof.grams, names=True)


def _label(batches: Iterator[pa.RecordBatch], prof, by_language: bool) -> Iterator[pa.RecordBatch]:
    """Adds to each document's other columns its runs, or one row for each language."""
    profiles = prof.value
    caches = word_caches(profiles)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            if max(map(len, caches)) > CACHE_WORDS:
                caches = word_caches(profiles)
            found = classify(batch.column("text").to_pylist(), profiles, caches)
            rows, cols = [], ([], [], [], [], [], [])
            for k, runs in enumerate(found):
                enough = [r for r in runs if r[1] >= RUN_WORDS] or runs  # a short text has one run
                names = {r[2] for r in enough}
                if by_language:
                    kept = []
                    for x in sorted(names):
                        own = [r for r in enough if r[2] == x]
                        n = sum(r[1] for r in own)
                        kept.append((own[0][0], n, x, sum(r[3] * r[1] for r in own) / n))
                else:
                    kept = enough
                for j, (a, m, x, y) in enumerate(kept):
                    rows.append(k)
                    for c, v in zip(cols, (j, a, m, x, round(y, 6), len(names)), strict=True):
                        c.append(v)
            kept_columns = [c for c in batch.schema.names if c != "text"]
            taken = batch.select(kept_columns).take(pa.array(rows, pa.int64()))
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[*kept_columns, *_RUN_NAMES])


def build_profiles(samples: DataFrame, lang: str, text: str) -> Profiles:
    """Profiles from at most ``MAX_SAMPLES`` labelled rows, taken in a fixed order."""
    rows = samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text).distinct()
    taken = rows.orderBy(F.xxhash64(text), text, lang).limit(MAX_SAMPLES).collect()
    return Profiles([(r[0], r[1]) for r in taken])


def language_runs(documents: DataFrame, prof: Profiles, by_language: bool = False) -> DataFrame:
    """``documents`` (.., text) without the text, a row for each run of at least
    ``RUN_WORDS`` words of one language: segment, first_word, n_words, seg_lang,
    confidence, n_languages (of the document); columns of these names are replaced.
    With ``by_language`` the runs of one language in a document are one row.

    A text without such a run, however short, has one row with the language of most of
    it; one of whose words no profile knows anything is ``UNKNOWN`` with confidence 0.
    Null, empty and blank texts and texts without a letter give no rows.  confidence is
    how much nearer the language's profile is than the next one's, from 0 to 1.
    """
    sc = documents.sparkSession.sparkContext
    kept = [f for f in documents.schema.fields if f.name != "text" and f.name not in _RUN_NAMES]
    documents = documents.select(*[F.col(f"`{f.name}`") for f in kept], "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), _RUNS])
    return documents.mapInArrow(partial(_label, prof=sc.broadcast(prof), by_language=by_language), schema)


def named_language(label: Column) -> Column:
    """The two-letter code that a label names, else null: a code of two or three letters,
    a code with region or an English name, in any case."""
    names = {x: code for code, others in LANGUAGE_NAMES.items() for x in (code, *others)}
    head = F.lower(F.trim(F.regexp_extract(label, r"^\s*([A-Za-z]+)(?:[-_][A-Za-z0-9]+)*\s*$", 1)))
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[head]


def mislabelled(documents: DataFrame, prof: Profiles) -> DataFrame:
    """(doc_id, seg_lang): the languages of each document (doc_id, text, lang) that holds
    more than one or whose label does not name its language; languages that stand
    nowhere with ``RUN_WORDS`` words in a row are in no document."""
    held = language_runs(documents.select("doc_id", "text", "lang").where(F.length(F.trim("text")) > 0), prof, by_language=True)
    named = F.coalesce(named_language(F.col("lang")), F.lit(""))
    held = held.where((F.col("n_words") >= RUN_WORDS) & (F.col("seg_lang") != UNKNOWN))
    return held.where((F.col("n_languages") > 1) | (named != F.col("seg_lang"))).select("doc_id", "seg_lang")
