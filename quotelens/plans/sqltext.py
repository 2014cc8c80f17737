"""Pieces of DuckDB SQL that the oracle queries share."""

from __future__ import annotations

from quotelens.chars import OTHER_DIGITS, PLAIN_DIGITS
from quotelens.options import NormalizationOptions

# The oracles' own statement of the character classes, apart from the library's.
WS_RE2 = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
A_RE2 = r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
MARKS_RE2 = r"\x{64B}-\x{65F}\x{670}\x{6D6}-\x{6ED}"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{WS_RE2}]+', ''), '[{WS_RE2}]+$', '')"


def norm(x: str, opts: NormalizationOptions = NormalizationOptions()) -> str:
    if opts.remove_diacritics:
        x = f"regexp_replace({x}, '[{MARKS_RE2}]', '', 'g')"
    if opts.normalize_alef:
        x = f"translate({x}, 'أإآٱ', 'اااا')"
    if opts.normalize_alef_maqsura:
        x = f"replace({x}, 'ى', 'ي')"
    if opts.normalize_teh_marbuta:
        x = f"replace({x}, 'ة', 'ه')"
    if opts.remove_tatweel:
        x = f"replace({x}, 'ـ', '')"
    if opts.normalize_hamza:
        x = f"replace(replace({x}, 'ؤ', 'و'), 'ئ', 'ي')"
    return strip(f"regexp_replace({x}, '[{WS_RE2}]+', ' ', 'g')") if opts.normalize_whitespace else x


def has_arabic(x: str) -> str:
    return f"regexp_matches({x}, '[{A_RE2}]')"


def clean(x: str) -> str:
    return f"translate({x}, concat(chr(65279), chr(8203), chr(8204), chr(8205), chr(65534), chr(65535)), '')"


def plain_digits(x: str) -> str:
    return f"translate({x}, '{OTHER_DIGITS}', '{PLAIN_DIGITS}')"


_ASCII = "concat(" + ", ".join(f"chr({c})" for c in range(1, 128)) + ")"
_MOVED = "".join(chr(0xE000 + c) for c in range(1, 128))


def wide(x: str) -> str:
    """The text with its ASCII moved to private code points, so that codes are unambiguous."""
    return f"translate({x}, {_ASCII}, '{_MOVED}')"


def alphabet(x: str) -> str:
    """The distinct characters of a moved text."""
    return f"array_to_string(list_distinct(string_split({x}, '')), '')"


def coded(x: str, letters: str) -> str:
    """A moved text with one byte for each character, since the edit distance counts bytes:
    its own code for each of ``letters``, one and the same for all others."""
    return f"regexp_replace(translate({x}, {letters}, {_ASCII}), '[^\\x{{01}}-\\x{{7F}}]', '~', 'g')"


def distance(a: str, b: str) -> str:
    """Edit distance in code points; exact while ``a`` has fewer than 126 different ones."""
    letters = alphabet(wide(a))
    return f"levenshtein({coded(wide(a), letters)}, {coded(wide(b), letters)})"


def similarity(a: str, b: str, d: str | None = None) -> str:
    """1 - edit distance / longer length; ``d``: the distance where it is at hand."""
    return (
        f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE "
        f"ELSE 1.0::DOUBLE - ({d or distance(a, b)})::DOUBLE / greatest(length({a}), length({b})) END"
    )


#: The corpus of a verse table: each verse once, in order of ids, with its normalized text.
CORPUS = f"corpus AS (SELECT DISTINCT id, surah, ayah, text, text_simple, page, juz, id AS ord, {norm('text')} AS norm, {wide(norm('text'))} AS wide FROM quran_verses)"

#: Distinct quotes, stripped and normalized.
ASKED = f"asked AS (SELECT DISTINCT quote_id, original, {strip('original')} AS q FROM quotes WHERE original IS NOT NULL)"
