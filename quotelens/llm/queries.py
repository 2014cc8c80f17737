"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm import language, leakage, lookalikes, near_duplicates, oracles, packing, shared_spans, term_counts
from quotelens.llm.records import distinct_texts, plain_form
from quotelens.plans.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Words of quotes.original and processed_verses.text_simple that are too rare or too common."""
    return term_counts.marked_terms(_term_fields(spark, d), min_count=2, max_share=0.05)


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word of each field with occurrences, records and mark."""
    return term_counts.term_table(_term_fields(spark, d), min_count=2, max_share=0.05)


def _term_fields(spark: SparkSession, d: str) -> dict:
    return {
        "original": (table(spark, d, "quotes"), "quote_id", "original"),
        "text_simple": (table(spark, d, "processed_verses"), "proc_id", "text_simple"),
    }


def _verses_and_quotes(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, text) of quran_verses.text and quotes.original, each record once."""
    verses, quotes = table(spark, d, "quran_verses"), table(spark, d, "quotes")
    return distinct_texts(verses, "id", "text").unionByName(distinct_texts(quotes, "quote_id", "original"))


def _plain_records(spark: SparkSession, d: str) -> DataFrame:
    return _verses_and_quotes(spark, d).select("rec_id", plain_form(F.col("text")).alias("plain"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of verses and quotes with word sets of similarity 0.7 or more."""
    return near_duplicates.near_duplicate_pairs(_plain_records(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Verses and quotes with their group of near duplicates and number of links."""
    return near_duplicates.near_duplicate_groups(_plain_records(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Verses and records that look the same but are stored differently."""
    return lookalikes.lookalike_pairs(table(spark, d, "quran_verses"), table(spark, d, "quotes"), table(spark, d, "processed_verses"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every verse and quote with its characters in stretches shared with another record."""
    verses, quotes = table(spark, d, "quran_verses"), table(spark, d, "quotes")
    rows = verses.select(F.col("id").cast("bigint").alias("rec_id"), "text").unionAll(quotes.select("quote_id", "original"))
    return shared_spans.shared_shares(rows)  # counts redelivered rows once itself


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Verses and quotes at least half of which is shared."""
    return p5_shares(spark, d).where((F.col("shared_chars") > 0) & (2 * F.col("shared_chars") >= F.col("n_chars"))).select("rec_id").distinct()


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's parts with their container of 2,048 tokens."""
    return packing.pack_documents(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by number of parts: how many, and tokens used and unused."""
    one = p6_packing(spark, d).groupBy("container_id").agg(F.count("*").alias("n_parts"), F.sum("part_tokens").alias("used"))
    return one.groupBy("n_parts").agg(F.count("*").alias("n_containers"), F.sum("used").alias("used_tokens"), F.sum(packing.CAPACITY - F.col("used")).alias("unused_tokens"))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed, those split although they fit, and containers that hold too much."""
    parts = p6_packing(spark, d)
    docs = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("part_tokens").alias("tokens"))
    split = F.count_if((F.col("n") > 1) & (F.col("tokens") <= packing.CAPACITY)).alias("n_split")
    over = parts.groupBy("container_id").agg(F.sum("part_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("n_overfull"))
    return docs.agg(F.count("*").alias("n_documents"), split).join(over)  # one row each


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of held-out items."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the documents whose label is missing, wrong or not the only one."""
    prof = language.build_profiles(table(spark, d, "lang_samples"), "sample_lang", "sample_text")
    return language.mislabelled(table(spark, d, "documents"), prof)


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every document's runs of one language with confidence."""
    prof = language.build_profiles(table(spark, d, "lang_samples"), "sample_lang", "sample_text")
    return language.language_runs(table(spark, d, "documents").select("doc_id", "text"), prof)


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that have a language: all that have a word."""
    return p8_segments(spark, d).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_groups, p3_found, p5_found, p5_shares, p6_packing, p6_fill, p6_invariants, p7_found, p8_found, p8_segments, p8_documents)}

SQL = oracles.SQL
