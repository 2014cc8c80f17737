"""Records of the text columns, each once, in house and plain form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.text import normalize_arabic
from quotelens.llm.house_form import house_form_col


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_id, text) of a table; redelivered rows, equal in both, come once."""
    return df.select(F.col(key).cast("bigint").alias("rec_id"), F.col(text).alias("text")).distinct()


def plain_form(text: Column) -> Column:
    """House form, then the default normalization."""
    return normalize_arabic(house_form_col(text))
