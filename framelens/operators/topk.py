"""Skew-safe top-k per group.

A plain ``row_number() OVER (PARTITION BY g ...)`` sends a whole group to one
task; when one group holds a third of the rows that task holds a third of the
data. Here the ranking runs twice: first inside ``(g, salt)`` sub-groups
(salt = hash of a unique column), keeping at most ``k`` rows each, then inside
``g`` over at most ``k * salt_buckets`` survivors. The result is exact: any
row in the group's top k is also in its sub-group's top k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    unique: str, salt_buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per ``group`` by ``order`` (which must be total)."""
    salt = F.pmod(F.xxhash64(F.col(unique)), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_salt", salt)
              .withColumn("_r1", F.row_number().over(w1))
              .filter(F.col("_r1") <= k)
              .withColumn(rank_col, F.row_number().over(w2))
              .filter(F.col(rank_col) <= k)
              .drop("_salt", "_r1"))


def top_k_candidates(df: DataFrame, group: list[str], score: str, k: int, buckets: int = 64) -> DataFrame:
    """Rows of ``df`` that may rank among their group's ``k`` highest ``score``, ties included.

    The rows are dealt out to buckets; the k-th highest of the buckets' maxima
    is reached by k rows at least, so what lies below it is left out and the
    ranking afterwards sorts few rows. Reads ``df`` twice: its scores must come
    out the same each time.
    """
    dealt = df.select(*group, score, F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).alias("_b"))
    tops = dealt.groupBy(*group, "_b").agg(F.max(score).alias("_m"))
    least = tops.groupBy(*group).agg(F.get(F.sort_array(F.collect_list("_m"), False), F.lit(k - 1)).alias("_least"))
    return (df.join(F.broadcast(least), group, "left")
              .filter(F.col("_least").isNull() | (F.col(score) >= F.col("_least")))
              .select(*df.columns))
