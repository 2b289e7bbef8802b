"""Period aggregation, series selection, splits and folds (per series key).

Windows here run over *aggregated* series (one row per key and period), so
a partition holds at most the number of periods of one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.common import reserved_keys
from furrow.operators.clean import filter_statistic, total_series_rows, winsorize


def mean_by_period(df: DataFrame, period_cols: Sequence[str], value_cols: Sequence[str],
                   keys: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """groupBy(keys + period).avg(values); partial + final hash aggregate."""
    names = list(names or value_cols)
    return df.groupBy(*keys, *period_cols).agg(
        *[F.avg(F.col(c).cast("double")).alias(n) for c, n in zip(value_cols, names)])


def total_series(df: DataFrame, period_cols: Sequence[str] = ("YEAR",),
                 value_cols: Sequence[str] = ("VALUE", "VALUE_clipped")) -> DataFrame:
    """National series: flag filter with description fallback, then means."""
    present = [c for c in value_cols if c in df.columns]
    return mean_by_period(total_series_rows(df), period_cols, present)


def series_points(obs: DataFrame, keys: Sequence[str], period: str = "period_idx") -> DataFrame:
    """Modelling input per series: YIELD rows winsorised at the global 1/99 %
    then averaged per period -> keys, x (period), y (clipped), y_raw."""
    y = winsorize(filter_statistic(obs), "VALUE")
    return (y.groupBy(*keys, period)
             .agg(F.avg("VALUE_clipped").alias("y"), F.avg("VALUE").alias("y_raw"))
             .withColumnRenamed(period, "x"))


@reserved_keys
def number_points(points: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """0-based position ``rn`` and size ``n`` of each point in its series."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(x)
    return (points.withColumn("rn", (F.row_number().over(w) - 1).cast("int"))
                  .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int")))


@reserved_keys
def temporal_split(points: DataFrame, keys: Sequence[str], x: str = "x", test_frac: float = 0.2) -> DataFrame:
    """Last max(1, ceil(test_frac * n)) periods of each series are test."""
    p = number_points(points, keys, x)
    test_n = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(test_frac)))).cast("int")
    return (p.withColumn("n_test", test_n)
             .withColumn("n_train", F.col("n") - F.col("n_test"))
             .withColumn("is_test", F.col("rn") >= F.col("n_train")))


@reserved_keys
def ts_cv_folds(split: DataFrame, keys: Sequence[str], n_splits: int = 5) -> DataFrame:
    """Expanding-window folds over each series' training rows.

    test block size = n_train // (n_splits + 1); fold i trains on every row
    before its block. Rows get one output row per fold they take part in,
    with ``role`` 'train' or 'test'. A series too short for a block keeps its
    rows once, without a fold and with the role 'too short'.
    """
    f = split.withColumn("_ts", (F.col("n_train") / F.lit(n_splits + 1)).cast("int")).where(~F.col("is_test") | (F.col("_ts") == 0))
    folds = F.when(F.col("_ts") > 0, F.sequence(F.lit(0), F.lit(n_splits - 1))).otherwise(F.array(F.lit(None).cast("int")))
    f = f.withColumn("fold", F.explode(folds))
    f = f.withColumn("_start", F.col("n_train") - (F.lit(n_splits) - F.col("fold")) * F.col("_ts"))
    f = f.where((F.col("_ts") == 0) | (F.col("rn") < F.col("_start") + F.col("_ts")))
    role = F.when(F.col("_ts") == 0, F.lit("too short")).when(F.col("rn") < F.col("_start"), F.lit("train")).otherwise(F.lit("test"))
    return f.withColumn("role", role).drop("_ts", "_start")


@reserved_keys
def recent(df: DataFrame, keys: Sequence[str], order_col: str, n: int = 20) -> DataFrame:
    """Last ``n`` periods of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col(order_col).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
