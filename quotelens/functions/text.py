"""Scalar text kernels as Column expressions; all of them run inside the JVM.

Lengths and offsets count code points.  Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelens.chars import (
    A_JAVA, ALEF, ALEF_FORMS, BLANKS, HAMZA_PLAIN, HAMZA_SEATS, HEH, JUNK, MAQSURA, MARBUTA, MARKS, OTHER_DIGITS, PLAIN_DIGITS, TATWEEL, WS_JAVA, YEH,
)
from quotelens.options import NormalizationOptions

SEGMENT = f"[{A_JAVA}][{A_JAVA}{WS_JAVA}]*"
SPAN_TYPE = "array<struct<text:string,start:int,end:int>>"
DIFF_TYPE = "array<struct<input:string,correct:string,position:int>>"
DEFAULT = NormalizationOptions()


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def translation(opts: NormalizationOptions) -> tuple[str, str]:
    """The character map of the options: what to replace, by what (then: deleted)."""
    swaps = [
        (opts.normalize_alef, ALEF_FORMS, ALEF * len(ALEF_FORMS)),
        (opts.normalize_alef_maqsura, MAQSURA, YEH),
        (opts.normalize_teh_marbuta, MARBUTA, HEH),
        (opts.normalize_hamza, HAMZA_SEATS, HAMZA_PLAIN),
    ]
    drops = MARKS * opts.remove_diacritics + TATWEEL * opts.remove_tatweel
    return "".join(a for on, a, _ in swaps if on) + drops, "".join(b for on, _, b in swaps if on)


def normalize_arabic(text: Column, opts: NormalizationOptions = DEFAULT) -> Column:
    """Marks and tatweel dropped, letter variants unified, blanks collapsed, as chosen."""
    old, new = translation(opts)
    out = F.translate(text, old, new) if old else text
    return strip(F.regexp_replace(out, f"[{WS_JAVA}]+", " ")) if opts.normalize_whitespace else out


def remove_diacritics(text: Column) -> Column:
    return F.translate(text, MARKS, "")


def contains_arabic(text: Column) -> Column:
    return text.rlike(f"[{A_JAVA}]")


def clean_text(text: Column) -> Column:
    """Without byte-order marks, zero-width characters and non-characters."""
    return F.translate(text, JUNK, "")


def strip_arabic_digits(text: Column) -> Column:
    """Without Arabic-Indic digits anywhere, then stripped; inner blanks stay."""
    return strip(F.translate(text, "٠١٢٣٤٥٦٧٨٩", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<text, start, end>> of all matches, in order.

    Offsets come from the lengths of the matches and of the gaps between them, since
    the regular-expression functions count UTF-16 units.  ``pattern`` must not match
    the empty string.
    """
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN_TYPE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["gap"])
        until = at + F.length(x["hit"])
        grown = F.concat(acc["out"], F.array(F.struct(x["hit"].alias("text"), at.alias("start"), until.alias("end"))))
        return F.struct(until.alias("pos"), grown.alias("out")).cast(f"struct<pos:int,out:{SPAN_TYPE}>")

    # The last gap follows the last match; it has no match of its own.
    zipped = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    pairs = F.filter(zipped, lambda x: x["hit"].isNotNull())
    return F.aggregate(pairs, start.cast(f"struct<pos:int,out:{SPAN_TYPE}>"), step, lambda acc: acc["out"])


def arabic_segments(text: Column) -> Column:
    """ARRAY<STRUCT<text, start, end>>: runs of Arabic script with inner blanks.

    ``text`` is stripped, ``end`` is the end before stripping; a segment of nothing
    but blanks cannot occur, one that is empty after stripping is left out.
    """
    found = F.transform(spans(text, SEGMENT), lambda s: F.struct(strip(s["text"]).alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    return F.filter(found, lambda s: s["text"] != "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for equal texts, 0 if just one is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)
    )


def find_differences(given: Column, correct: Column) -> Column:
    """ARRAY<STRUCT<input, correct, position>>: runs in which both texts differ, place
    by place.  A run still open where the shorter text ends takes both rests; else a
    rest of one text is a difference of its own against '(missing)' or '(extra)'."""
    m = F.least(F.length(given), F.length(correct))
    marks = F.zip_with(F.split(given, ""), F.split(correct, ""), lambda x, y: F.when(x.isNull() | y.isNull(), "").when(x == y, "0").otherwise("1"))
    mask = F.when(m == 0, F.lit("")).otherwise(F.array_join(marks, ""))

    def cut(text: Column, start: Column, n: Column) -> Column:
        return F.substring(text, start + 1, n)

    def run(start: Column, n: Column) -> Column:
        return F.struct(cut(given, start, n).alias("input"), cut(correct, start, n).alias("correct"), start.alias("position"))

    rest = F.lit(2**30)
    lone = F.array(
        F.struct(
            F.coalesce(F.nullif(cut(given, m, rest), F.lit("")), F.lit("(missing)")).alias("input"),
            F.coalesce(F.nullif(cut(correct, m, rest), F.lit("")), F.lit("(extra)")).alias("correct"),
            m.alias("position"),
        )
    )

    def listed(runs: Column) -> Column:
        inner = F.transform(runs, lambda r: F.when(r["end"] < m, run(r["start"], r["end"] - r["start"])).otherwise(run(r["start"], rest)))
        open_run = F.exists(runs, lambda r: r["end"] == m)
        return F.concat(inner.cast(DIFF_TYPE), F.when(~open_run & (F.length(given) != F.length(correct)), lone).otherwise(F.array()).cast(DIFF_TYPE))

    return F.when(given.isNotNull() & correct.isNotNull(), let(spans(mask, "1+"), listed))


def plain_digits(text: Column) -> Column:
    return F.translate(text, OTHER_DIGITS, PLAIN_DIGITS)


def parse_reference(ref: Column) -> Column:
    """STRUCT<surah, start_ayah, end_ayah, is_range> of ``s:a`` or ``s:a-b``, else null.

    Decimal digits of any script count; one final line feed is tolerated; numbers
    beyond BIGINT give null parts.
    """
    shape = r"^(\p{Nd}+):(\p{Nd}+)(?:-(\p{Nd}+))?\n?\z"

    def number(g: int) -> Column:
        return plain_digits(F.regexp_extract(ref, shape, g)).try_cast("bigint")

    end = number(3)
    return F.when(
        ref.rlike(shape),
        F.struct(number(1).alias("surah"), number(2).alias("start_ayah"), end.alias("end_ayah"), end.isNotNull().alias("is_range")),
    )


def reference_text(surah: Column, ayah: Column) -> Column:
    return F.concat_ws(":", surah.cast("string"), ayah.cast("string"))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the first occurrence of ``old`` replaced; an empty ``old`` puts
    ``new`` in front."""
    at = F.locate_col(old, text) if hasattr(F, "locate_col") else F.position(old, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.lit(2**30)))).otherwise(text)


def tagged(fmt: str, ref: Column, text: Column) -> Column:
    """A quote in the tag format; formats without a tag give 'text (ref)'."""
    ref = F.coalesce(ref, F.lit("None"))
    if fmt == "xml":
        return F.concat(F.lit('<quran ref="'), ref, F.lit('">'), text, F.lit("</quran>"))
    if fmt == "markdown":
        return F.concat(F.lit('```quran ref="'), ref, F.lit('"\n'), text, F.lit("\n```"))
    if fmt == "bracket":
        return F.concat(F.lit("[[Q:"), ref, F.lit("|"), text, F.lit("]]"))
    return F.concat(text, F.lit(" ("), ref, F.lit(")"))


def percent(x: Column) -> Column:
    """A share as whole per cent, halves rounded to even."""
    return F.bround(x * 100, 0).cast("bigint").cast("string")
