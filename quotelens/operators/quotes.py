"""Quotes within documents: detection, tagged, contextual and untagged extraction,
analysis, correction, and short verdicts.

All spans of all documents are laid out as rows, their distinct texts are resolved
once by the cascade, and what depends on order within a document (which contextual
quotes are accepted, which segments they shadow, the chain of replacements) is done on
each document's own array of quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.chars import A_JAVA, WS_JAVA
from quotelens.functions import text as T
from quotelens.operators import match
from quotelens.operators.lookup import verse_ranges
from quotelens.operators.skew import once, salted_join
from quotelens.options import TAG_FORMATS, ProcessorOptions, ValidatorOptions
from quotelens.plans.runtime import materialize_packed

RUN = f"[{A_JAVA}{WS_JAVA}]"
REF = r"\p{Nd}+:\p{Nd}+(?:-\p{Nd}+)?"

# The three tag formats (group 1 the reference, group 2 the body).
TAGS = {
    "xml": rf"""(?iu:<quran[{WS_JAVA}]+ref=["']({REF})["']>((?s:.*?))</quran>)""",
    "markdown": rf"""(?iu:```quran[{WS_JAVA}]+ref=["']({REF})["'][\r\n]+((?s:.*?))[\r\n]+```)""",
    "bracket": rf"\[\[Q:({REF})\|((?s:.*?))\]\]",
}

# What announces a quote, in the order in which it is looked for.
TRIGGERS = (
    rf"(?iu:(?:Allah[{WS_JAVA}]+says?|God[{WS_JAVA}]+says?|the[{WS_JAVA}]+Quran[{WS_JAVA}]+says?|in[{WS_JAVA}]+the[{WS_JAVA}]+Quran|"
    rf"Quranic[{WS_JAVA}]+verse|verse[{WS_JAVA}]+states?|ayah|ayat|surah)[{WS_JAVA}]*[:\-]?[{WS_JAVA}]*)",
    rf"(?:قال[{WS_JAVA}]+الله|قال[{WS_JAVA}]+تعالى|يقول[{WS_JAVA}]+الله|في[{WS_JAVA}]+القرآن|الآية|سورة)[{WS_JAVA}]*[:\-]?[{WS_JAVA}]*",
    r"\(?\p{Nd}{1,3}:\p{Nd}{1,3}(?:-\p{Nd}{1,3})?\)?",
    r"\[[\p{L}\p{N}_\-]+:\p{Nd}+(?:-\p{Nd}+)?\]",
)

# Least characters of a contextual quote and of an untagged one, and the
# similarity from which a range counts as valid.
CONTEXT_CHARS, UNTAGGED_CHARS, RANGE_SIMILARITY = 10, 15, 0.85

INLINE = rf"(?<!{RUN})({RUN}++)\(({REF})\)"
SPANS = "array<struct<ref:string,text:string,start:int,end:int,full:string>>"

PROMPTS = {
    "xml": 'Put every quoted verse between <quran ref="SURAH:AYAH"> and </quran>, or ref="SURAH:FIRST-LAST" for several in a row. Copy the Arabic with its marks; say so when you are not sure of the wording.',
    "markdown": 'Put every quoted verse in a block that begins with ```quran ref="SURAH:AYAH" (or SURAH:FIRST-LAST) and ends with ```. Copy the Arabic with its marks.',
    "bracket": "Write every quoted verse as [[Q:SURAH:AYAH|ARABIC TEXT]], or [[Q:SURAH:FIRST-LAST|ARABIC TEXT]] for several in a row.",
    "minimal": "After every quoted verse give its reference in brackets, as in (SURAH:AYAH) or (SURAH:FIRST-LAST).",
}


def system_prompt(tag_format: str = "xml") -> str:
    """What to tell a language model so that its quotes can be checked."""
    return PROMPTS[tag_format]


def _inside(start: Column, r: Column) -> Column:
    return (start >= r["start"]) & (start < r["end"])


def _overlaps(start: Column, end: Column, r: Column) -> Column:
    """One end of the span lies in ``r``; a span around ``r`` does not overlap it."""
    return _inside(start, r) | ((end > r["start"]) & (end <= r["end"]))


def _none() -> Column:
    return F.array().cast(SPANS)


def _in_parts(w: Column, pattern: str, ref: int, body: int) -> Column:
    """A match with its reference and body, from the match alone: it is found again there
    in the same way, since the patterns do not look at what follows them."""
    part = lambda g: F.regexp_extract(w["text"], pattern, g)
    return F.struct(part(ref).alias("ref"), T.strip(part(body)).alias("text"), w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("full"))


def tagged_spans(text: Column, fmt: str) -> Column:
    """Quotes in tags, in order."""
    if fmt not in TAG_FORMATS:
        raise KeyError(fmt)
    pattern = TAGS[fmt]
    return F.transform(T.spans(text, pattern), lambda w: _in_parts(w, pattern, 1, 2))


def inline_spans(text: Column, tagged: Column) -> Column:
    """Arabic with a reference in brackets after it, unless it begins inside a tag.  Blanks
    alone before the brackets count, with an empty text."""
    found = F.transform(T.spans(text, INLINE), lambda w: _in_parts(w, INLINE, 2, 1))
    return F.filter(found, lambda x: ~F.exists(tagged, lambda r: _inside(x["start"], r)))


def contextual_spans(text: Column, tagged: Column) -> Column:
    """Arabic right after an announcement, by announcement, then in order."""
    out = []
    for trigger in TRIGGERS:
        ahead = rf"(?:{trigger})(?=({RUN}*))"
        marks = T.spans(text, rf"(?:{trigger})")
        runs = F.regexp_extract_all(text, F.lit(ahead), F.lit(1))
        joined = F.arrays_zip(marks.alias("m"), runs.alias("r"))
        found = F.transform(
            joined,
            lambda z: F.struct(F.lit(None).cast("string").alias("ref"), T.strip(z["r"]).alias("text"), z["m"]["end"].alias("start"), (z["m"]["end"] + F.length(z["r"])).alias("end"), F.lit(None).cast("string").alias("full")),
        )
        kept = F.filter(found, lambda x: (F.length(x["text"]) >= CONTEXT_CHARS) & ~F.exists(tagged, lambda r: _overlaps(x["start"], x["end"], r)))
        out.append(F.when(text.rlike(rf"(?:{trigger})"), kept).otherwise(_none()))
    return F.concat(*out)


def untagged_spans(text: Column) -> Column:
    """Arabic segments long enough to be a quote."""
    found = F.transform(
        T.arabic_segments(text),
        lambda s: F.struct(F.lit(None).cast("string").alias("ref"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("full")),
    )
    return F.filter(found, lambda s: F.length(s["text"]) >= UNTAGGED_CHARS)


def _with_tagged(docs: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, text, tagged): documents with their tagged and inline spans."""
    tags = docs.select("doc_id", "text", once(tagged_spans(F.col("text"), fmt)).alias("tags"))
    return tags.select("doc_id", "text", once(F.concat("tags", inline_spans(F.col("text"), F.col("tags")))).alias("tagged"))


def laid_out(docs: DataFrame, opts: ProcessorOptions, every: bool = False) -> DataFrame:
    """(doc_id, stage, n, ref, text, start, end): all spans of documents (doc_id, text);
    with ``every``, also a row without span (n) for each stage in which a document has none."""
    tagged = _with_tagged(docs, opts.tag_format)
    untagged = untagged_spans(F.col("text")) if opts.scan_untagged else _none()
    stages = F.array(
        F.struct(F.lit(0).alias("stage"), F.col("tagged").cast(SPANS).alias("spans")),
        F.struct(F.lit(1).alias("stage"), contextual_spans(F.col("text"), F.col("tagged")).cast(SPANS).alias("spans")),
        F.struct(F.lit(2).alias("stage"), untagged.cast(SPANS).alias("spans")),
    )
    rows = tagged.select("doc_id", F.explode(stages).alias("s")).select("doc_id", "s.stage", (F.posexplode_outer if every else F.posexplode)("s.spans").alias("n", "x"))
    return rows.select("doc_id", "stage", "n", "x.ref", "x.text", "x.start", "x.end")


def _parsed(spans: DataFrame) -> DataFrame:
    """``spans``, written, with their parsed reference p."""
    return materialize_packed(spans.withColumn("p", once(T.parse_reference(F.col("ref")))))


def analyzed(spans: DataFrame, corpus: DataFrame) -> DataFrame:
    """``spans`` with is_valid, corrected, reference, confidence and was_corrected."""
    return _analyzed(_parsed(spans), corpus)


def _analyzed(parsed: DataFrame, corpus: DataFrame, with_corrected: bool = True) -> DataFrame:
    """As ``analyzed``, of parsed spans; without ``with_corrected``, corrected is null."""
    ranged = F.coalesce(F.col("p.is_range") & (F.col("p.end_ayah") != 0), F.lit(False))
    keep = [c for c in parsed.columns if c != "p"]
    single = match.validate(parsed.where(~ranged).select(*keep), corpus, ValidatorOptions(), with_differences=False, with_suggestions=False, with_text=with_corrected)
    moved = F.col("is_valid") & (F.col("match_type") != "exact")
    wrong = F.coalesce(F.col("ref") != F.col("reference"), F.lit(False))
    singles = single.select(
        *keep, (F.col("is_valid") & ~wrong).alias("is_valid"), (F.when(moved, F.col("verse_text")).otherwise(F.col("text")) if with_corrected else F.lit(None).cast("string")).alias("corrected"),
        F.coalesce("reference", "ref").alias("reference"), "confidence", moved.alias("was_corrected"),
    )
    wanted = parsed.where(ranged).select(*keep, F.col("p.surah").alias("surah"), F.col("p.start_ayah").alias("start_ayah"), F.col("p.end_ayah").alias("end_ayah"))
    known = verse_ranges(wanted.select("surah", "start_ayah", "end_ayah"), corpus).select("surah", "start_ayah", "end_ayah", F.col("text").alias("range_text"))
    met = salted_join(wanted, known, ["surah", "start_ayah", "end_ayah"], "left")
    a, b = T.normalize_arabic(F.col("text")), T.normalize_arabic(F.col("range_text"))
    exact, there = F.col("text") == F.col("range_text"), F.col("range_text").isNotNull()
    close = met.withColumn("sim", once(F.when(exact, 1.0).when(a == b, 0.95).otherwise(T.similarity(a, b)))).withColumn("same", once(a == b))
    valid = there & (exact | F.col("same") | (F.col("sim") >= RANGE_SIMILARITY))
    ranges = close.select(
        *keep, valid.alias("is_valid"), (F.when(valid & ~exact, F.col("range_text")).otherwise(F.col("text")) if with_corrected else F.lit(None).cast("string")).alias("corrected"),
        F.col("ref").alias("reference"), F.when(there, F.col("sim")).otherwise(0.0).alias("confidence"), (valid & ~exact).alias("was_corrected"),
    )
    return singles.unionByName(ranges)


def _warning(q: Column) -> Column:
    # Fixed value: the wording of a warning.
    return F.concat(
        F.lit('Potential untagged Quran quote detected: "'), F.substring(q["original"], 1, 50), F.lit('..." (possibly '),
        F.coalesce(q["reference"], F.lit("None")), F.lit(", "), T.percent(q["confidence"]), F.lit("% confidence)"),
    )


def process(docs: DataFrame, corpus: DataFrame, opts: ProcessorOptions = ProcessorOptions()) -> DataFrame:
    """(doc_id, corrected_text, all_valid, quotes, warnings) of documents (doc_id, text).

    ``corpus`` is prepared and doc_id unique.  Tagged quotes are always kept, contextual
    ones if valid or confident enough, untagged ones if confident enough and not within
    a kept quote.  Corrections replace the first occurrence in the text as it then is.  A
    document without quotes is valid; a null text stays null with no quotes.
    """
    rows = analyzed(laid_out(docs.select("doc_id", "text").where(F.col("text").isNotNull()), opts), corpus)
    final = _accepted(rows, opts)
    joined = docs.select("doc_id", "text").join(final, "doc_id", "left")
    shape = final.schema["q"].dataType
    held = joined.withColumn("q", F.coalesce("q", F.array().cast(shape)))

    def replaced(acc: Column, x: Column) -> Column:
        old = F.when(x["stage"] == 0, F.substring(F.col("text"), x["start_index"] + 1, x["end_index"] - x["start_index"])).otherwise(x["original"])
        new = F.when(x["stage"] == 0, T.tagged(opts.tag_format, x["reference"], x["corrected"])).otherwise(x["corrected"])
        return T.replace_first(acc, old, new)

    fixed = F.aggregate(F.filter("q", lambda x: x["was_corrected"]), F.col("text"), replaced) if opts.auto_correct else F.col("text")
    shown = F.transform("q", lambda x: x.dropFields("stage", "n"))
    return held.select("doc_id", fixed.alias("corrected_text"), _all_valid(), shown.alias("quotes"), _warnings().alias("warnings"))


def _all_valid() -> Column:
    return F.forall("q", lambda x: x["is_valid"] & ~x["was_corrected"]).alias("all_valid")


def _warnings() -> Column:
    return F.transform(F.filter("q", lambda x: x["stage"] == 2), _warning)


def _accepted(rows: DataFrame, opts: ProcessorOptions) -> DataFrame:
    """(doc_id, q): the quotes of each document that are kept, in order."""
    quote = F.struct(
        "stage", "n", F.col("text").alias("original"), "corrected", "is_valid", "reference", "confidence",
        F.element_at(F.array(F.lit("tagged"), F.lit("contextual"), F.lit("fuzzy")), F.col("stage") + 1).alias("detection_method"),
        F.col("start").alias("start_index"), F.col("end").alias("end_index"), "was_corrected",
    )
    confident = F.coalesce(F.col("confidence") >= F.lit(float(opts.min_confidence)), F.lit(False))
    kept = rows.where((F.col("stage") == 0) | (F.col("stage") == 1) & (F.col("is_valid") | confident) | (F.col("stage") == 2) & confident)
    # Written, so that the shuffles of the cascade are gone before those of the documents.
    grouped = materialize_packed(kept).groupBy("doc_id").agg(F.array_sort(F.collect_list(quote)).alias("q"))
    first = grouped.withColumn("early", once(F.filter("q", lambda x: x["stage"] < 2)))

    def shadowed(x: Column) -> Column:
        return F.exists("early", lambda r: (x["start_index"] >= r["start_index"]) & (x["start_index"] < r["end_index"]) | (x["end_index"] > r["start_index"]) & (x["end_index"] <= r["end_index"]))

    return first.select("doc_id", once(F.filter("q", lambda x: (x["stage"] < 2) | ~shadowed(x))).alias("q"))


def range_quotes(docs: DataFrame, corpus: DataFrame, fmt: str = "xml") -> DataFrame:
    """(doc_id, original, corrected, is_valid, reference, start_index, end_index,
    was_corrected, confidence): tagged quotes of documents (doc_id, text) whose reference
    in the end has a hyphen, as ``process`` gives them.

    Tagged quotes are kept whatever else a document has, so only they are resolved, and of
    them only those that name a range, unless the corpus itself has negative places.
    """
    tagged = _with_tagged(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), fmt)
    spans = tagged.select("doc_id", F.explode("tagged").alias("x")).select("doc_id", "x.ref", "x.text", "x.start", "x.end")
    if corpus.where(T.reference_text(F.col("surah"), F.col("ayah")).contains("-")).isEmpty():
        spans = spans.where(F.col("ref").contains("-"))
    rows = analyzed(spans, corpus).where(F.col("reference").contains("-"))
    return rows.select("doc_id", F.col("text").alias("original"), "corrected", "is_valid", "reference", F.col("start").alias("start_index"), F.col("end").alias("end_index"), "was_corrected", "confidence")


def quick_validate(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, has_quran_content, all_valid, issues) without correcting anything.

    Documents are read once: their ids come from their spans or the lack of them.  Of a
    quote only what its issue shows goes on after the cascade.
    """
    opts = ProcessorOptions(auto_correct=False)
    parsed = _parsed(laid_out(docs.select("doc_id", "text"), opts, every=True))
    ids = parsed.where((F.col("stage") == 0) & (F.coalesce("n", F.lit(0)) == 0)).select("doc_id")
    rows = _analyzed(parsed.where(F.col("n").isNotNull()), corpus, with_corrected=False)
    # Fixed value: characters of a quote that a warning shows; an issue shows fewer.
    final = _accepted(rows.withColumn("text", F.substring("text", 1, 50)), opts)
    held = ids.join(final, "doc_id", "left").withColumn("q", F.coalesce("q", F.array().cast(final.schema["q"].dataType)))

    def issue(x: Column) -> Column:
        # Fixed value: the wording of an issue.
        hint = F.when(F.coalesce(x["reference"], F.lit("")) != "", F.concat(F.lit(" (should be "), x["reference"], F.lit(")"))).otherwise("")
        return F.concat(F.lit('Quote "'), F.substring(x["original"], 1, 30), F.lit('..." is '), F.when(x["is_valid"], "imprecise").otherwise("invalid"), hint)

    bad = F.transform(F.filter("q", lambda x: ~x["is_valid"] | x["was_corrected"]), issue)
    return held.select("doc_id", (F.size("q") > 0).alias("has_quran_content"), _all_valid(), F.concat(bad, _warnings()).alias("issues"))


def validate_quotes(quotes: DataFrame, corpus: DataFrame, distinct: bool = False) -> DataFrame:
    """``quotes`` (.., text, expected_ref) with is_valid, correct_text and actual_ref.

    An invalid quote has neither; a valid one at another reference is invalid but has
    both; a null or empty expected_ref expects nothing.  Columns named like a verdict's
    are dropped.  With ``distinct``, equal rows give one.
    """
    kept = [c for c in quotes.columns if c not in (*match.VERDICT, "correct_text", "actual_ref")]
    v = match.validate(quotes.select(*kept), corpus, with_differences=False, distinct=distinct)
    expected = F.coalesce(F.col("expected_ref"), F.lit(""))
    wrong = F.col("is_valid") & (expected != "") & (expected != F.col("reference"))
    fixed = F.when(wrong | (F.col("match_type") != "exact"), F.col("verse_text"))
    return v.select(*kept, (F.col("is_valid") & ~wrong).alias("is_valid"), F.when(F.col("is_valid"), fixed).alias("correct_text"), F.when(F.col("is_valid"), F.col("reference")).alias("actual_ref"))


def detect(docs: DataFrame, corpus: DataFrame, opts: ValidatorOptions = ValidatorOptions()) -> DataFrame:
    """(doc_id, text, start, end, verdict columns): every Arabic segment of documents
    (doc_id, text) of at least ``min_detection_length`` characters, matched or not."""
    segments = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(T.arabic_segments(F.col("text"))).alias("s"))
    long = materialize_packed(segments.select("doc_id", "s.text", "s.start", "s.end").where(F.length("text") >= opts.min_detection_length))
    return match.validate(long, corpus, opts, with_differences=False)


def detected(docs: DataFrame, corpus: DataFrame, opts: ValidatorOptions = ValidatorOptions()) -> DataFrame:
    """(doc_id, n_segments, detected): whether any segment of a document is a verse."""
    found = detect(docs, corpus, opts).groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.bool_or("is_valid").alias("detected"))
    both = docs.select("doc_id").join(found, "doc_id", "left")
    return both.select("doc_id", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("detected", F.lit(False)).alias("detected"))


def all_spans(docs: DataFrame, fmt: str) -> DataFrame:
    """Tagged and inline quotes of documents, as rows."""
    tags = docs.select("doc_id", "text", once(tagged_spans(F.col("text"), fmt)).alias("tags"))
    both = tags.select("doc_id", F.explode(F.array(F.struct(F.lit("tag").alias("how"), F.col("tags").cast(SPANS).alias("x")), F.struct(F.lit("inline").alias("how"), inline_spans(F.col("text"), F.col("tags")).cast(SPANS).alias("x")))).alias("b"))
    return both.select("doc_id", "b.how", F.explode("b.x").alias("s")).select("doc_id", "how", "s.ref", "s.text", "s.start", "s.end")


__all__ = ["all_spans", "analyzed", "detect", "detected", "process", "quick_validate", "range_quotes", "system_prompt", "validate_quotes"]
