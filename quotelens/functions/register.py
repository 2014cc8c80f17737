"""Functions for SQL: scalar ones as SQL functions over built-in expressions, and a
table function for lateral joins."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quotelens.chars import ARABIC_BLOCKS, BLANKS, MARKS, WS_JAVA, A_JAVA
from quotelens.functions.text import DEFAULT, translation

_A = "".join(f"{chr(a)}-{chr(b)}" for a, b in ARABIC_BLOCKS)


@udtf(returnType="text: string, start: int, end: int")
class ArabicSegments:
    """Arabic segments of a text with their offsets in code points."""

    def eval(self, text: str):
        if text is not None:
            for m in re.finditer(f"[{_A}][{_A}\\s]*", text):
                if shown := m.group().strip():
                    yield shown, m.start(), m.end()


def _literal(s: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04X}" for c in s) + "'"


def register(spark: SparkSession) -> None:
    """Make normalize_arabic, remove_diacritics, contains_arabic, text_similarity and
    arabic_segments callable from SQL in this session."""
    old, new = translation(DEFAULT)
    ws = WS_JAVA.replace("\\", "\\\\")
    bodies = {
        "normalize_arabic(t STRING) RETURNS STRING": f"btrim(regexp_replace(translate(t, {_literal(old)}, {_literal(new)}), '[{ws}]+', ' '), {_literal(BLANKS)})",
        "remove_diacritics(t STRING) RETURNS STRING": f"translate(t, {_literal(MARKS)}, '')",
        "contains_arabic(t STRING) RETURNS BOOLEAN": "t RLIKE '[" + A_JAVA.replace("\\", "\\\\") + "]'",
        "text_similarity(a STRING, b STRING) RETURNS DOUBLE": (
            "CASE WHEN a = b THEN 1.0D WHEN length(a) = 0 OR length(b) = 0 THEN 0.0D ELSE 1.0D - levenshtein(a, b) / greatest(length(a), length(b)) END"
        ),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("arabic_segments", ArabicSegments)
