"""Ranks over a whole table, or within keys, without a task that holds all rows.

Rows are range-partitioned and sorted by (keys, order) and written with their
place in the partition. One row of counts per (partition, key) gives each
partition's offset in its key, and the rank is the sum of both. A hot key
spans as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.common import attach_checked, materialize


def grouped_rank(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Add ``out`` (long, from 0): the place of each row in the ascending order
    of ``order`` within its ``keys``, nulls first. Equal rows get different
    ranks in any order, so a caller who needs repeatable ones gives a total
    order. ``__part`` and ``__at`` are reserved names."""
    keys, order = list(keys), [*keys, *order]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked-rows")
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    # as many rows as partitions that hold the key
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__part")
    offsets = counts.select(*keys, "__part", "__from", (F.sum("__n").over(before) - F.col("__n")).alias("__before"))
    ranked = attach_checked(placed, offsets, [*keys, "__part"], "rank-offsets")
    return ranked.withColumn(out, F.col("__at") - F.col("__from") + F.col("__before")).drop("__part", "__at", "__from", "__before")
