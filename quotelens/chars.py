"""Character classes, kept in one place for Spark expressions and oracle SQL."""

from __future__ import annotations

# The script blocks that count as Arabic (first and last code point).
ARABIC_BLOCKS = ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))

# Marks deleted by normalization (first and last code point).
MARK_RANGES = ((0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED))

# Unicode white space as str.strip() and \s of Python see it.
BLANK_RANGES = (
    (0x0009, 0x000D), (0x001C, 0x0020), (0x0085, 0x0085), (0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)

# Letter variants of each normalization option.
ALEF_FORMS, ALEF = "أإآٱ", "ا"
MAQSURA, YEH = "ى", "ي"
MARBUTA, HEH = "ة", "ه"
TATWEEL = "ـ"
HAMZA_SEATS, HAMZA_PLAIN = "ؤئ", "وي"

# Characters removed when raw downloads are cleaned.
JUNK = "﻿​‌‍￾￿"


def spell(ranges: tuple[tuple[int, int], ...]) -> str:
    """Every character of the ranges, in order."""
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


def java_class(ranges: tuple[tuple[int, int], ...]) -> str:
    """Body of a Java character class."""
    return "".join(f"\\u{a:04X}" if a == b else f"\\u{a:04X}-\\u{b:04X}" for a, b in ranges)


def re2_class(ranges: tuple[tuple[int, int], ...]) -> str:
    """Body of a character class for RE2 (DuckDB)."""
    return "".join(f"\\x{{{a:04X}}}" if a == b else f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges)


MARKS = spell(MARK_RANGES)
BLANKS = spell(BLANK_RANGES)
A_JAVA, WS_JAVA = java_class(ARABIC_BLOCKS), java_class(BLANK_RANGES)
A_RE2, WS_RE2 = re2_class(ARABIC_BLOCKS), re2_class(BLANK_RANGES)

# Decimal digits of other scripts (a rule, not a table: every code point whose
# Unicode decimal value is 0 starts a run of ten digits).
DIGIT_ZEROS = tuple(c for c in range(0x80, 0x20000) if chr(c).isdecimal() and int(chr(c)) == 0)
OTHER_DIGITS = "".join(chr(z + i) for z in DIGIT_ZEROS for i in range(10))
PLAIN_DIGITS = "0123456789" * len(DIGIT_ZEROS)

# Signs read as a plain hyphen or colon in references.
DASHES = "‐‑‒–—―−﹘﹣－"
COLONS = "：﹕︓"
