"""Exact, linearly interpolated quantiles per group without hot-group tasks.

``percentile`` keeps one value->count map per group and merges it in a
single task, which breaks when one group holds a large share of the rows.
Here the same numbers (position ``p*(n-1)``, linear interpolation between the
two neighbouring order statistics, as ``percentile``/``quantile_cont`` and
pandas) come from ranks in one global order:

1. count each distinct (group, value) pair - a partial aggregate, so a hot
   group is spread over many tasks by value and pre-combined map-side;
2. range-partition the counts by (group, value) and write them once: a hot
   group or a heavy tail spans as many partitions as its values need, and no
   assumption is made about how values are spread (infinities included);
3. one row of totals per (partition, group) gives every partition's offset in
   its group, and so the partition that holds each wanted rank;
4. running counts inside those partitions alone find the values.

No step holds all rows of a group, and nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.common import attach, materialize


def exact_quantiles(df: DataFrame, value_col: str, probs: Mapping[str, float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``keys`` + one double column per entry of ``probs``.

    Nulls and NaN are ignored; infinities are values like others. Groups with
    no values are absent.
    """
    keys = list(keys)
    v = F.col(value_col).cast("double") + F.lit(0.0)
    base = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    order = [*keys, "_v"]
    counted = (base.groupBy(*order).agg(F.count(F.lit(1)).alias("_c"))
                   .repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    counted = materialize(counted, "value-counts")

    # one row per (partition, group): rows there and in the partitions before
    totals = counted.groupBy(*keys, "_part").agg(F.sum("_c").alias("_t"))
    by_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    totals = (totals.withColumn("_n", F.sum("_t").over(by_group))
                    .withColumn("_off", F.sum("_t").over(by_group.orderBy("_part")) - F.col("_t")))

    # the partition of each wanted rank (the two neighbours of a position)
    prob_arr = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    targets = totals.select(*keys, "_part", "_t", "_n", "_off", F.explode(prob_arr).alias("_q"))
    targets = targets.withColumn("_pos", F.col("_q.p") * (F.col("_n") - 1)).withColumn(
        "_r", F.explode(F.array(F.floor("_pos").cast("long"), F.ceil("_pos").cast("long"))))
    targets = targets.where((F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_t"))).select(
        *keys, "_part", F.col("_q.name").alias("_name"), "_pos", "_r", (F.col("_r") - F.col("_off")).alias("_rr"))

    cell = [*keys, "_part"]
    inside = attach(counted, targets.select(*cell).distinct(), cell, how="left_semi")
    ranked = inside.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*cell).orderBy("_v")))
    hit = attach(targets, ranked, cell).where(
        (F.col("_rr") >= F.col("_cum") - F.col("_c")) & (F.col("_rr") < F.col("_cum")))
    per_name = hit.groupBy(*keys, "_name").agg(
        F.first("_pos").alias("_pos"),
        F.min_by("_v", "_r").alias("_vlo"),
        F.max_by("_v", "_r").alias("_vhi"))
    frac = F.col("_pos") - F.floor("_pos")
    per_name = per_name.withColumn("_q", F.when((frac == 0) | (F.col("_vlo") == F.col("_vhi")) | (F.abs("_vlo") == float("inf")), F.col("_vlo"))
                                   .otherwise(F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac))
    return per_name.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probs])
