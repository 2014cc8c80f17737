import random

import pytest

from quotelens.operators import quotes as Q
from quotelens.options import ProcessorOptions
from quotelens.sources.corpus import prepared
from tests import spec

VERSES = ["قُلْ هُوَ ٱلنُّورُ ٱلبَعِيدُ وَٱلقَرِيبُ", "لَمْ يَكُنْ مِثْلُهُ شَيْءٌ فِي ٱلأَرْضِ", "وَٱلسَّمَاءُ رَفَعَهَا عَلَى عَمَدٍ طَوِيلٍ", "يَوْمَ يَقُومُ ٱلنَّاسُ جَمِيعًا إِلَى ٱلحِسَابِ", "قُلْ هُوَ ٱلنُّورُ ٱلبَعِيدُ"]


def corpus_rows():
    return [(i + 1, i // 3 + 1, i % 3 + 1, v, v.translate(spec.MARK), i + 1) for i, v in enumerate(VERSES)]


@pytest.fixture(scope="module")
def corpus(spark):
    return prepared(spark.createDataFrame(corpus_rows(), "id int, surah int, ayah int, text string, text_simple string, ord int")).cache()


def listed():
    return [(f"{s}:{a}", t) for _, s, a, t, _, _ in corpus_rows()]


def documents(n=60):
    r = random.Random(3)
    plain = [v.translate(spec.MARK) for v in VERSES]
    bent = [v[:-6] + "كل" + v[-4:] for v in VERSES]
    fixed = [
        "see (2:2)", "<quran ref=\"1:1\">" + VERSES[0] + "</quran> (1:1)", f"<QURAN ref='1:2'>{plain[1]}</quran>", f"<quran ref=\"1:9\">{bent[0]}</quran>", "none",
        f"Allah says: {VERSES[0]} and {plain[2]} (1:3)", f"😀 {plain[3]}\n", f"<quran ref=\"1:1-2\">{plain[0]} {plain[1]}</quran>", f"<quran ref=\"1:2-1\">{plain[0]}</quran>",
        f"<quran ref=\"1:1-0\">{VERSES[0]}</quran>", f"(٢:٢) {bent[1]}", f"سورة {plain[0]} قال الله: {bent[1]}", f"12:30 {VERSES[3]}", f"{bent[2]} {bent[2]}", f"in the Quran says {VERSES[1]}", "",
        f"[Al-X:2] {plain[1]} ﴿{VERSES[0]}﴾", f"{bent[0]}؛ x {bent[0]}; <quran ref=\"1:1\">{bent[0]}</quran>",
    ]
    pieces = [*VERSES, *plain, *bent, "Allah says: ", " (1:1) ", "(1:1-2)", " surah ", "<quran ref=\"1:1\">", "</quran>", "abc ", "\n", "\xa0", "، ", "😀"]
    return fixed + ["".join(r.choice(pieces) for _ in range(r.randint(1, 8))) for _ in range(n)]


@pytest.mark.parametrize("fmt", ["xml", "bracket", "markdown"])
def test_process_equals_the_statement(spark, corpus, fmt):
    docs = documents()
    if fmt == "bracket":
        docs = [d.replace('<quran ref="1:1">', "[[Q:1:1|").replace("</quran>", "]]") for d in docs]
    if fmt == "markdown":
        docs = [d.replace('<quran ref="1:1">', '```quran ref="1:1"\n').replace("</quran>", "\n```") for d in docs]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in Q.process(df, corpus, ProcessorOptions(tag_format=fmt)).collect()}
    for i, d in enumerate(docs):
        out, ok, quotes, warnings = spec.process(d, listed(), fmt)
        mine = [[q.original, q.corrected, q.is_valid, q.reference, q.confidence, q.detection_method, q.start_index, q.end_index, q.was_corrected] for q in got[i].quotes]
        assert [q[:4] + q[5:] for q in mine] == [q[:4] + q[5:] for q in quotes], d
        assert [q[4] for q in mine] == pytest.approx([q[4] for q in quotes]), d
        assert (got[i].corrected_text, got[i].all_valid, list(got[i].warnings)) == (out, ok, warnings), d


def test_null_document_and_unknown_format(spark, corpus):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    r = Q.process(df, corpus).collect()[0]
    assert r.corrected_text is None and r.all_valid and not r.quotes
    with pytest.raises(KeyError):
        Q.process(df, corpus, ProcessorOptions(tag_format="minimal"))


def test_validate_quotes(spark, corpus):
    rows = [(1, VERSES[0], "1:1"), (2, VERSES[0], "1:2"), (3, VERSES[1].translate(spec.MARK), ""), (4, "abc", "1:1"), (5, VERSES[1], None), (6, None, "1:1")]
    got = {r.k: (r.is_valid, r.correct_text, r.actual_ref) for r in Q.validate_quotes(spark.createDataFrame(rows, "k int, text string, expected_ref string"), corpus).collect()}
    assert got == {1: (True, None, "1:1"), 2: (False, VERSES[0], "1:1"), 3: (True, VERSES[1], "1:2"), 4: (False, None, None), 5: (True, None, "1:2"), 6: (None, None, None)}


def test_quick_validate_and_detection(spark, corpus):
    df = spark.createDataFrame([(1, f"x {VERSES[0]} y"), (2, "plain"), (3, "<quran ref=\"1:1\">كلام ليس منه شيء</quran>"), (4, None)], "doc_id long, text string")
    quick = {r.doc_id: (r.has_quran_content, r.all_valid, len(r.issues)) for r in Q.quick_validate(df, corpus).collect()}
    assert quick == {1: (True, True, 1), 2: (False, True, 0), 3: (True, False, 1), 4: (False, True, 0)}
    seen = {r.doc_id: (r.n_segments, r.detected) for r in Q.detected(df, corpus).collect()}
    assert seen == {1: (1, True), 2: (0, False), 3: (1, False), 4: (0, False)}
    assert set(Q.PROMPTS) == {"xml", "markdown", "bracket", "minimal"} and Q.system_prompt()


def test_ranges_are_resolved_without_the_other_quotes(spark, corpus, monkeypatch):
    df = spark.createDataFrame(list(enumerate(documents())), "doc_id long, text string")
    names = ("original", "corrected", "is_valid", "reference", "start_index", "end_index", "was_corrected", "confidence")
    want = [(r.doc_id, *(q[n] for n in names)) for r in Q.process(df, corpus).collect() for q in r.quotes if q.detection_method == "tagged" and "-" in q.reference]
    asked, validate = [], Q.match.validate

    def seen(quotes, *more, **named):
        asked.extend(r.ref for r in quotes.collect())
        return validate(quotes, *more, **named)

    monkeypatch.setattr(Q.match, "validate", seen)
    got = [(r.doc_id, *(r[n] for n in names)) for r in Q.range_quotes(df, corpus).collect()]
    assert sorted(got) == sorted(want) and len(got) > 3
    assert asked and all("-" in ref for ref in asked)


def test_short_verdicts_read_documents_once(spark, corpus, monkeypatch):
    docs = [*documents(), None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    done = {r.doc_id: r for r in Q.process(df, corpus, ProcessorOptions(auto_correct=False)).collect()}
    read, asked, validate = spark.sparkContext.accumulator(0), [], Q.match.validate

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    def seen(quotes, corpus, *more, **named):
        asked.append(named)
        return validate(quotes, corpus, *more, **named)

    monkeypatch.setattr(Q.match, "validate", seen)
    got = Q.quick_validate(df.mapInArrow(counted, df.schema), corpus).collect()
    assert read.value == len(docs) == len(got)
    assert [(x["with_suggestions"], x["with_text"]) for x in asked] == [(False, False)]
    for r in got:
        x = done[r.doc_id]
        assert (r.has_quran_content, r.all_valid) == (len(x.quotes) > 0, x.all_valid)
        assert len(r.issues) == sum(not q.is_valid or q.was_corrected for q in x.quotes) + len(x.warnings)
        assert r.issues[len(r.issues) - len(x.warnings) :] == x.warnings
