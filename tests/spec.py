"""Row-at-a-time statement of what the operators must give, for the tests only."""

from __future__ import annotations

import re

# Marks, letter variants and blocks.
MARK = dict.fromkeys([*range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6EE), 0x640])
FOLD = MARK | str.maketrans("أإآٱىةؤئ", "اااايهوي")
A = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"


def norm(t):
    return " ".join(t.translate(FOLD).split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sim(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 1 - distance(a, b) / max(len(a), len(b))


def validate(text, corpus, threshold=0.8, partial=True):
    """(match_type, confidence, verse) with ``corpus`` a list of (ref, text) in order."""
    t = text.strip()
    if not re.search(f"[{A}]", t):
        return "none", 0.0, None
    for v in corpus:
        if v[1] == t:
            return "exact", 1.0, v
    n = norm(t)
    for v in corpus:
        if norm(v[1]) == n:
            return "normalized", 0.95, v
    if partial:
        for v in corpus:
            m = norm(v[1])
            if n in m:
                return "partial", 0.7 + len(n) / len(m) * 0.2, v
            if m in n:
                return "partial", 0.6 + len(m) / len(n) * 0.2, v
    best = max(corpus, key=lambda v: sim(n, norm(v[1])), default=None)
    if best and sim(n, norm(best[1])) >= threshold:
        return "fuzzy", sim(n, norm(best[1])), best
    return "none", 0.0, None


def differences(a, b):
    m, out, i = min(len(a), len(b)), [], 0
    while i < m:
        if a[i] == b[i]:
            i += 1
            continue
        j = i
        while j < m and a[j] != b[j]:
            j += 1
        if j == m:
            return [*out, (a[i:], b[i:], i)]
        out.append((a[i:j], b[i:j], i))
        i = j
    if len(a) != len(b):
        out.append((a[m:] or "(missing)", b[m:] or "(extra)", m))
    return out


# The tag formats and what announces a quote.
D = r"\d+:\d+(?:-\d+)?"
TAGS = {
    "xml": rf"(?i)<quran\s+ref=[\"']({D})[\"']>([\s\S]*?)</quran>",
    "markdown": rf"(?i)```quran\s+ref=[\"']({D})[\"'][\r\n]+([\s\S]*?)[\r\n]+```",
    "bracket": rf"\[\[Q:({D})\|([\s\S]*?)\]\]",
}
TRIGGERS = [
    r"(?i)(?:Allah\s+says?|God\s+says?|the\s+Quran\s+says?|in\s+the\s+Quran|Quranic\s+verse|verse\s+states?|ayah|ayat|surah)\s*[:\-]?\s*",
    r"(?:قال\s+الله|قال\s+تعالى|يقول\s+الله|في\s+القرآن|الآية|سورة)\s*[:\-]?\s*",
    r"\(?\d{1,3}:\d{1,3}(?:-\d{1,3})?\)?",
    r"\[[\w\-]+:\d+(?:-\d+)?\]",
]


def tagged(text, fmt):
    out = [(m[1], m[2].strip(), m.start(), m.end(), m[0]) for m in re.finditer(TAGS[fmt], text)]
    tags = list(out)
    for m in re.finditer(rf"(?<![{A}\s])([{A}\s]+)\(({D})\)", text):
        if not any(r[2] <= m.start() < r[3] for r in tags):
            out.append((m[2], m[1].strip(), m.start(), m.end(), m[0]))
    return out


def hit(s, e, r):
    return r[0] <= s < r[1] or r[0] < e <= r[1]


def process(text, corpus, fmt="xml", least=0.85, fix=True):
    """(corrected text, all valid, quotes, warnings)."""
    verse = dict(reversed(corpus))
    quotes, warnings, out = [], [], text

    def analyze(t, ref, s, e, how):
        m = re.fullmatch(r"(\d+):(\d+)-(\d+)", ref or "")
        if m and int(m[3]):
            whole = [verse.get(f"{int(m[1])}:{k}") for k in range(int(m[2]), int(m[3]) + 1)]
            if not whole or None in whole:
                return [t, t, False, ref, 0.0, how, s, e, False]
            whole = " ".join(whole)
            x = 1.0 if t == whole else 0.95 if norm(t) == norm(whole) else sim(norm(t), norm(whole))
            ok = x >= 0.85
            return [t, whole if ok and t != whole else t, ok, ref, x, how, s, e, ok and t != whole]
        kind, conf, v = validate(t, corpus)
        moved = kind not in ("exact", "none")
        ok = kind != "none" and not (ref and v[0] != ref)
        return [t, v[1] if moved else t, ok, v[0] if v else ref, conf, how, s, e, moved]

    tags = tagged(text, fmt)
    for ref, t, s, e, full in tags:
        q = analyze(t, ref, s, e, "tagged")
        quotes.append(q)
        if fix and q[8]:
            new = {"xml": f'<quran ref="{q[3]}">{q[1]}</quran>', "markdown": f'```quran ref="{q[3]}"\n{q[1]}\n```', "bracket": f"[[Q:{q[3]}|{q[1]}]]"}[fmt]
            out = out.replace(full, new, 1)
    for p in TRIGGERS:
        for m in re.finditer(p, text):
            run = re.match(rf"[{A}\s]*", text[m.end() :])[0]
            s, e = m.end(), m.end() + len(run)
            if len(run.strip()) >= 10 and not any(hit(s, e, r[2:4]) for r in tags):
                q = analyze(run.strip(), None, s, e, "contextual")
                if q[2] or q[4] >= least:
                    quotes.append(q)
                    if fix and q[8]:
                        out = out.replace(q[0], q[1], 1)
    early = list(quotes)
    for m in re.finditer(rf"[{A}][{A}\s]*", text):
        t = m[0].strip()
        if len(t) >= 15 and not any(hit(m.start(), m.end(), r[6:8]) for r in early):
            q = analyze(t, None, m.start(), m.end(), "fuzzy")
            if q[4] >= least:
                quotes.append(q)
                warnings.append(f'Potential untagged Quran quote detected: "{t[:50]}..." (possibly {q[3]}, {q[4] * 100:.0f}% confidence)')
                if fix and q[8]:
                    out = out.replace(q[0], q[1], 1)
    return out, all(q[2] and not q[8] for q in quotes), quotes, warnings
