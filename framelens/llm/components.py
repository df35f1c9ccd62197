"""Connected components of link tables, by alternating stars on tables in the shared folder."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _lowest(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``low``: the smallest b of a, or a where that is smaller."""
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    return pairs.join(low.select("a", F.least("a", "low").alias("low")), "a")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """``(node, label)`` of the linked nodes: the smallest node reachable over ``links(src, dst)``.

    Each round links every larger neighbour of a node, then the node itself, to
    the smallest neighbour; groups only ever meet as aggregates. A round's table
    is deleted once the next is written. Runs until nothing changes.
    """
    pairs = scratch.keep(f"{name}-0", links.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
                         .filter("a <> b").distinct())
    before = None
    for i in itertools.count(1):
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = state
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _lowest(both).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        small = _lowest(large)
        small = small.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")),
                                               F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("p"))
        after = scratch.keep(f"{name}-{i}", small.select("p.*").filter("a <> b").distinct())
        scratch.drop(f"{name}-{i - 1}")
        pairs = after
