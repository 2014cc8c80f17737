"""Verification of quotes that arrive as a stream.

There is no state and no window: each micro-batch goes through the batch cascade, whose
joins with the corpus are stream-static, and is written under its batch id, so that a
batch that is repeated after a failure overwrites what it wrote before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.operators.match import validate
from quotelens.options import ValidatorOptions
from quotelens.plans.runtime import release, shared_dir


def start_validation(quotes: DataFrame, corpus: DataFrame, out: str, checkpoint: str, opts: ValidatorOptions = ValidatorOptions(), short: bool = False, **trigger: object):
    """Start a query that validates the stream ``quotes`` (quote_id, text) into parquet
    folders ``out``/batch_id=N.  With ``short``, equal quotes of a batch are written once,
    without texts and suggestions."""

    def batch(df: DataFrame, batch_id: int) -> None:
        if short:
            verdicts = validate(df, corpus, opts, distinct=True, with_suggestions=False, with_text=False).drop("text")
        else:
            verdicts = validate(df, corpus, opts, with_differences=False)
        verdicts.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return quotes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet folder, or a single file, as a stream."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(p):
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def stream_validate(spark: SparkSession, path: str, corpus: DataFrame) -> DataFrame:
    """Verdicts of the quotes at ``path``, read as a stream until all of it is done."""
    source = parquet_stream(spark, path)
    quotes = source.select("quote_id", F.col("original").alias("text")).where(F.col("text").isNotNull())
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    start_validation(quotes, corpus, f"{base}/out", f"{base}/progress", short=True).awaitTermination()
    release(spark)
    done = spark.read.parquet(f"{base}/out")
    return done.select("quote_id", "is_valid", "match_type", F.round("confidence", 9).alias("confidence"), "verse_id", "reference").distinct()
