"""One canonical form for text that looks the same (problem 3).

``house_form`` brings a string to what a reader sees: every character is the
ordinary character of the same look, marks are composed and in canonical order,
nothing invisible stays, and words are separated by one plain blank.

Method: the quick-check properties of Unicode normalization (NFC_QC, the
canonical combining class, plus "has another ordinary look-alike") define one
character class of *unstable* characters.  A single compiled pattern finds the
unstable segments together with their boundary context (the starter before them
and every mark after them); only those segments are normalized and spliced back
between the untouched stretches.  A text without an unstable segment is returned
as the same object.

Defined results: null stays null; a text of nothing but invisible characters or
blanks becomes ''; any length is processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quotelens.chars import BLANKS

# Letters of other scripts or shapes that look like an ordinary
# letter of the Latin alphabet (key: look-alikes, value: the ordinary letters).
LATIN_LOOKALIKES = (
    ("аеорсухіјѕһӏԁԛԝѵ", "aeopcyxijshldqwv"),  # Cyrillic small
    ("АВЕКМНОРСТХЅІЈУԌԚԜӀѴ", "ABEKMHOPCTXSIJYGQWIV"),  # Cyrillic capital
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek capital
    ("οινρϲϳ", "oivpcj"),  # Greek small
    ("ոսօզհյցԼՍՕՏ", "nuoqhjgLUOS"),  # Armenian
    ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᏀᎡ", "ABCDEHJKLMPSTVWZGR"),  # Cherokee
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"),  # Roman numerals of one letter
    ("ɑɡɩıƖ", "agiil"),  # Latin letters of other shape
)

# Arabic-script letters and digits that look like a letter of the
# standard alphabet wherever they stand.
ARABIC_LOOKALIKES = (
    ("کڪ", "كك"),
    ("ھہە", "ههه"),
    ("ٮ", "ٮ"),
    ("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩"),
)

# Letters whose look depends on the place in the word: inside the
# word they look like the first letter, at its end like the second.
POSITIONAL = {"ی": ("ي", "ى"), "ں": ("ن", "ں"), "ې": ("ې", "ې")}

# Ordinary characters for dashes, quotes and dots of the same look.
SIGN_LOOKALIKES = (("‐‑", "--"), ("ʼ", "’"), ("٬", "،"))

# Conjoining Hangul letters that join the syllable before them: vowels and final consonants.
_HANGUL_LATER = (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))

# Compatibility decompositions that do not change the look of a character.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


def is_invisible(ch: str) -> bool:
    """Format characters, variation selectors, fillers and other controls."""
    cp = ord(ch)
    if cp in (0x06DD, 0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x070F, 0x08E2, 0x0890, 0x0891, 0x110BD, 0x110CD):
        return False  # signs that are drawn although their category is Cf
    if unicodedata.category(ch) in ("Cf", "Cc"):
        return True
    return 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0)


def _charset(chars: list[int]) -> str:
    """A regular-expression class body of the given code points, as ranges."""
    out, start, prev = [], None, None
    for cp in [*sorted(chars), None]:
        if start is not None and (cp is None or cp != prev + 1):
            out.append(f"\\u{start:04x}" if start == prev else f"\\u{start:04x}-\\u{prev:04x}")
            start = cp
        elif start is None:
            start = cp
        prev = cp
    return "".join(out)


def _plane() -> list[int]:
    """The code points that can be unstable: the basic plane without the large
    ideographic, syllable, surrogate and private blocks."""
    return [c for c in range(0x10000) if not (0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xF8FF)]


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], re.Pattern, re.Pattern, re.Pattern]:
    """Character map and the patterns of unstable characters, of segments and of
    characters whose look depends on their place; built once a process."""
    mapped: dict[int, str] = {}
    marks: list[int] = []
    later: set[int] = set(_HANGUL_LATER)  # later parts of canonical compositions: NFC_QC is Maybe
    for cp in [*_plane(), *range(0x1D400, 0x1D800)]:
        ch = chr(cp)
        if unicodedata.combining(ch) and cp < 0x10000:
            marks.append(cp)
        if ch in BLANKS:
            if ch != " ":
                mapped[cp] = " "
            continue
        if is_invisible(ch):
            mapped[cp] = ""
            continue
        parts = unicodedata.decomposition(ch).split(" ")
        if parts[0] in _SAME_LOOK or 0xFB00 <= cp <= 0xFB06:
            # Narrow Hangul letters stand alone and form no syllable.
            new = chr(int(parts[1], 16)) if parts[0] == "<narrow>" and 0xFFA1 <= cp <= 0xFFDC else unicodedata.normalize("NFKC", ch)
            if len(new) > 1 and new[0] == " ":  # a mark drawn alone
                new = new.strip(" ")
            mapped[cp] = new
        elif parts[0] and parts[0][0] != "<":
            if len(parts) == 2:
                later.add(int(parts[1], 16))
            if not unicodedata.is_normalized("NFC", ch):
                mapped[cp] = unicodedata.normalize("NFC", ch)
    for pairs in (LATIN_LOOKALIKES, ARABIC_LOOKALIKES, SIGN_LOOKALIKES):
        for alike, plain in pairs:
            mapped.update({ord(a): b for a, b in zip(alike, plain, strict=True) if a != b})
    for cp in _plane():  # letters with accents look like the ordinary letter with them
        base, *accents = unicodedata.normalize("NFD", chr(cp))
        if accents and ord(base) in mapped and cp not in mapped:
            mapped[cp] = unicodedata.normalize("NFC", mapped[ord(base)] + "".join(accents))
    # A mapped value may hold further look-alikes (a full form of a foreign letter).
    for cp, new in list(mapped.items()):
        mapped[cp] = "".join(mapped.get(ord(c), c) for c in new)
    unstable = _charset(sorted(c for c in {*mapped, *later, *map(ord, POSITIONAL)} if c < 0x10000)) + "\U00010000-\U0010ffff"
    mark = _charset(marks)
    segment = re.compile(f"[^{mark}]?[{mark}]*[{unstable}][{unstable}{mark}]*|[^{mark}]?[{mark}]{{2,}}")
    places = re.compile(f"[{''.join(POSITIONAL)}]([{mark}]*)(?=(.?))", re.S)
    return mapped, re.compile(f"[{unstable}]|^ | $|  "), segment, places


def _placed(m: re.Match) -> str:
    inner, final = POSITIONAL[m.group(0)[0]]
    joins = m.group(2) and unicodedata.category(m.group(2)) in ("Lo", "Lm") and "\u0600" <= m.group(2) <= "\u08ff" and m.group(2) != "ء"
    return (inner if joins else final) + m.group(1)


def house_form(text: str | None) -> str | None:
    """The house form of one text; see the module's docstring."""
    if text is None:
        return None
    mapped, unstable, segment, places = _tables()
    if unstable.search(text) is None and unicodedata.is_normalized("NFC", text):
        return text

    def splice(m: re.Match) -> str:
        return unicodedata.normalize("NFC", m.group(0).translate(mapped))

    out = segment.sub(splice, text)
    moved = not POSITIONAL.keys().isdisjoint(out)
    if moved:
        out = places.sub(_placed, out)
    if "ٔ" in out:  # a hamza over the dotless seat looks like the seat with hamza
        out = re.sub("[ىي]([ً-ْٰ]*)ٔ", "ئ\\1", out)
        moved = True
    if moved:
        out = unicodedata.normalize("NFC", out)
    if "  " in out or out[:1] == " " or out[-1:] == " ":
        out = " ".join(x for x in out.split(" ") if x)
    return out


def _house_forms(texts: pd.Series) -> pd.Series:
    return texts.map(house_form, na_action="ignore")


def house_form_col(text: Column | str) -> Column:
    """Column form; Arrow batches, one process-wide set of tables.

    Declared nondeterministic so that a filter on its result isn't pushed below it, which
    would compute it once for the filter and once more for the result.
    """
    return F.pandas_udf(_house_forms, StringType()).asNondeterministic()(F.col(text) if isinstance(text, str) else text)
