"""Pairs of records that look the same but are stored differently (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.house_form import house_form_col
from quotelens.operators.skew import salted_join, union_all
from quotelens.plans.runtime import materialize


def house_keys(records: DataFrame, min_words: int) -> DataFrame:
    """``records`` (.., text) with the text replaced by two 64-bit hashes of its house
    form and one of the stored text; texts of fewer words are dropped.

    128 bits of house form stand for equality; the stored text's hash only tells
    different spellings of one form apart.
    """
    housed = records.where(F.col("text").isNotNull()).withColumn("house", house_form_col("text"))
    long = housed.where(F.length("house") - F.length(F.translate("house", " ", "")) >= min_words - 1).where(F.col("house") != "")
    keys = (F.xxhash64("house").alias("k1"), F.xxhash64(F.lit(7), "house").alias("k2"), F.xxhash64("text").alias("stored"))
    return long.select(*[c for c in records.columns if c != "text"], *keys)


def lookalike_pairs(verses: DataFrame, quotes: DataFrame, processed: DataFrame, min_words: int = 6) -> DataFrame:
    """(verse_id, rec_id): equal house form of at least ``min_words`` words, stored
    differently; verse_id < rec_id.

    ``verses`` (id, text, text_simple), ``quotes`` (quote_id, original) and
    ``processed`` (proc_id, id, text_simple).  text meets originals and other
    verses' texts, text_simple meets processed texts of the same verse id.  Null
    and short texts match nothing; redelivered rows count once; empty tables are
    allowed; other columns are ignored.  A form shared by very many records is
    split over tasks by salt, not dropped.
    """
    whole, simple = F.lit(-1).cast("bigint"), F.col("id").cast("bigint")
    texts = union_all([
        verses.select(F.col("id").cast("bigint").alias("rec_id"), whole.alias("scope"), F.lit(True).alias("verse"), "text"),
        verses.select(F.col("id").cast("bigint").alias("rec_id"), simple.alias("scope"), F.lit(True).alias("verse"), F.col("text_simple").alias("text")),
        quotes.select(F.col("quote_id").alias("rec_id"), whole.alias("scope"), F.lit(False).alias("verse"), F.col("original").alias("text")),
        processed.where(F.col("id").isNotNull()).select(F.col("proc_id").alias("rec_id"), simple.alias("scope"), F.lit(False).alias("verse"), F.col("text_simple").alias("text")),
    ])
    keyed = materialize(house_keys(texts, min_words).distinct())
    left = keyed.where("verse").select(F.col("rec_id").alias("verse_id"), "scope", "k1", "k2", F.col("stored").alias("verse_stored"))
    right = keyed.where(~F.col("verse") | (F.col("scope") == -1)).drop("verse")
    pairs = salted_join(right, left, ["scope", "k1", "k2"])
    return pairs.where((F.col("verse_id") < F.col("rec_id")) & (F.col("stored") != F.col("verse_stored"))).select("verse_id", "rec_id").distinct()
