"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.plans.runtime import release

#: Key hashes are counted in this many buckets; what the driver sees is bounded by it.
BUCKETS = 4096
#: Rows of one key that one task of a join takes.
ROWS_PER_PART = 100_000
SALT = "__salt"


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, keys: list[str], rows_per_part: int = ROWS_PER_PART) -> dict[int, int]:
    """Key-hash buckets in which some key has more than ``rows_per_part`` rows, and into
    how many parts such a bucket must be split for none of its keys to have more in one.

    Rows are counted by bucket; only the keys of buckets with more rows than that are
    then counted one by one, pre-aggregated.  Two numbers a bucket reach the driver at
    most, ``BUCKETS`` times, however many keys or rows there are.
    """
    bucketed = df.withColumn(SALT, _bucket(keys))
    full = [r[0] for r in bucketed.groupBy(SALT).count().where(F.col("count") > rows_per_part).collect()]
    release(df.sparkSession)
    if not full:
        return {}
    return hot_counts(bucketed.where(F.col(SALT).isin(full)).groupBy(SALT, *keys).count(), keys, rows_per_part)


def hot_counts(counted: DataFrame, keys: list[str], rows_per_part: int = ROWS_PER_PART) -> dict[int, int]:
    """As ``hot_buckets``, from a table of each key with its ``count``."""
    most = counted.where(F.col("count") > rows_per_part).groupBy(_bucket(keys).alias("b")).agg(F.max("count").alias("most"))
    return {b: -(-n // rows_per_part) for b, n in most.collect()}


def parts_of(hot: dict[int, int], keys: list[str]) -> Column:
    """Into how many parts the rows of each key are split."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])[_bucket(keys)], F.lit(1)) if hot else F.lit(1)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows_per_part: int = ROWS_PER_PART, hot: dict[int, int] | None = None, distinct: bool = False) -> DataFrame:
    """Equi-join in which the hot keys of ``big`` are spread over several tasks.

    ``hot`` tells them where that is known already (``hot_buckets``); else they are
    counted first.  Rows of ``big`` in a hot bucket get a salt, rows of ``small`` there
    are repeated once for each salt.  ``how`` is 'inner' or 'left' (``big`` on the left).
    Null keys match nothing, as in SQL.  An empty side gives the result SQL gives.
    With ``distinct``, equal rows of ``big`` count once, in the join's own shuffle.  Columns other than the keys must have different names on both sides.
    """
    hot = hot_buckets(big, keys, rows_per_part) if hot is None else hot
    if not hot:
        return (big.repartition(*keys).distinct() if distinct else big).join(small, keys, how)
    parts = parts_of(hot, keys)
    hashable = [f"`{n}`" for n, kind in big.dtypes if "map<" not in kind and kind != "variant"]
    spread = F.pmod(F.xxhash64(*hashable), parts).cast("int")
    left = big.withColumn(SALT, spread)
    if distinct:  # equal rows have one salt
        left = left.repartition(*keys, SALT).distinct()
    right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [*keys, SALT], how).drop(SALT)


def once(value: Column) -> Column:
    """An expensive value that is computed once a row although several steps use it;
    filters on a plain column would compute it again."""
    return F.explode(F.array(value))


def tasks_for(spark: SparkSession) -> int:
    """Partitions for steps that are costly for their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
