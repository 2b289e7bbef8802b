"""Profiling: describe, table info, value counts, null counts, histograms,
box statistics, group medians and top-k groups, scatter pairs.

Per-column statistics unpivot the columns into (column, value) rows and run
one grouped aggregate, instead of one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.common import attach, attach_checked, materialize
from furrow.operators.quantiles import exact_quantiles

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value"))
                                         for c in cols])).alias("_kv")).select("_kv.column", "_kv.value")


DESCRIBE_PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (exact), max per column."""
    cols = list(cols or numeric_columns(df))
    lg = _long(df, cols, "double")
    m = lg.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                 F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                 F.max("value").alias("max"))
    q = exact_quantiles(lg, "value", DESCRIBE_PROBS, ["column"])
    j = attach(m, q, ["column"], how="left")
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return j.select("column", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value"))
                                                  for s in stats])).alias("_s")) \
            .select("column", "_s.stat", "_s.value")


def describe_string(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count (non-null), unique, top (most frequent, ties by value), freq."""
    cols = list(cols or string_columns(df))
    vc = _long(df, cols, "string").where(F.col("value").isNotNull()).groupBy("column", "value").count()
    return vc.groupBy("column").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("top"),
        F.max("count").alias("freq"))


def table_profile(df: DataFrame) -> DataFrame:
    """Column type, non-null count and table row count (one pass)."""
    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f.name)).alias(f"_nn{i}") for i, f in enumerate(fields)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                        F.lit(f.dataType.simpleString()).alias("dtype"),
                                        F.col(f"_nn{i}").alias("non_null")) for i, f in enumerate(fields)]))
    return counts.select(F.col("_rows").alias("rows"), F.lit(len(fields)).alias("columns"), rows.alias("_c")) \
                 .select("_c.position", "_c.column", "_c.dtype", "_c.non_null", "rows", "columns")


def null_counts(df: DataFrame) -> DataFrame:
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls"))
                                          for i, c in enumerate(df.columns)])).alias("_c")).select("_c.*")


def value_counts_top(df: DataFrame, cols: Sequence[str] | None = None, k: int = 20) -> DataFrame:
    """Top-k values (nulls included) per string column by count, ties by
    value. ``row_number() <= k`` lets Spark cut each group to k rows per
    partition before the exchange (window group limit)."""
    cols = list(cols or string_columns(df))
    vc = _long(df, cols, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def histogram(df: DataFrame, value_col: str, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), empty bins
    filled; lo == hi puts everything in bin 1 of width 0. Nulls, NaN and
    infinite values have no bin and are left out."""
    keys = list(keys)
    v = F.col(value_col).cast("double")
    finite = F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf"))
    d = df.select(*keys, v.alias("_v")).where(finite)
    rng = d.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    width = F.col("hi") - F.col("lo")
    rng = materialize(rng, "histogram-ranges") if keys else rng
    b = (attach_checked(d, rng, keys, "histogram-ranges") if keys else attach(d, rng)).withColumn(
        "bin", F.when(width > 0, F.least((F.floor((F.col("_v") - F.col("lo")) / width * bins) + 1).cast("int"),
                                         F.lit(bins))).otherwise(F.lit(1)))
    cnt = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    allbins = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    out = attach(allbins, cnt, keys + ["bin"], how="left")
    return out.select(*keys, "bin",
                      (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") - 1) / F.lit(float(bins))).alias("bin_lo"),
                      (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / F.lit(float(bins))).alias("bin_hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def histogram_all(df: DataFrame, bins: int = 30, cols: Sequence[str] | None = None) -> DataFrame:
    """Histograms of every numeric column in one pass: (column, bin, ...)."""
    return histogram(_long(df, list(cols or numeric_columns(df)), "double"), "value", bins, ["column"])


BOX_PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_stats(df: DataFrame, value_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (most extreme data inside 1.5 IQR fences) and the
    number of points outside them."""
    keys = list(keys)
    v = F.col(value_col).cast("double")
    d = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    q = exact_quantiles(d, "_v", BOX_PROBS, keys)
    j = attach(d, q, keys)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(F.col("_v") >= lo_f, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(F.col("_v") <= hi_f, F.col("_v"))).alias("whisker_hi"),
        F.count_if((F.col("_v") < lo_f) | (F.col("_v") > hi_f)).alias("n_outliers"))


def box_stats_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Box statistics of every numeric column in one pass, by ``column``."""
    return box_stats(_long(df, list(cols or numeric_columns(df)), "double"), "value", ["column"])


def median_by_group(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    return exact_quantiles(df, value_col, {"median": 0.5}, [group_col])


def top_groups_by_median(df: DataFrame, value_col: str, group_col: str, k: int = 12) -> DataFrame:
    """k groups with the largest median (groups without values dropped;
    ties by name). The ordered limit is a distributed top-k."""
    med = median_by_group(df, value_col, group_col).where(F.col("median").isNotNull())
    top = med.orderBy(F.col("median").desc(), F.col(group_col).asc()).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("median").desc(), F.col(group_col).asc())))


def rows_of_top_groups(df: DataFrame, value_col: str, group_col: str, k: int = 12) -> DataFrame:
    top = top_groups_by_median(df, value_col, group_col, k).select(group_col)
    return df.join(F.broadcast(top), group_col, "left_semi")  # at most k rows


def find_col(columns: Sequence[str], keywords: Sequence[str]) -> str | None:
    """First column whose lower-case name contains a keyword; keyword order
    wins over column order (plan-shaping helper)."""
    return next((c for kw in keywords for c in columns if kw in c.lower()), None)


# Keyword lists of the column roles (fixed values).
ROLE_KEYWORDS = {
    "year": ["year"],
    "acre": ["acre", "acres", "area"],
    "prod": ["production", "prod"],
    "yield": ["yield"],
}


def scatter_pairs(df: DataFrame) -> DataFrame:
    """(x, y) pairs for year/acre/production vs yield and acre vs production,
    for the roles whose columns exist; long format (pair, x_col, y_col, x, y)."""
    role = {r: find_col(df.columns, kws) for r, kws in ROLE_KEYWORDS.items()}
    pairs = [(a, b) for a, b in (("year", "yield"), ("acre", "yield"), ("prod", "yield"), ("acre", "prod"))
             if role[a] and role[b]]
    if not pairs:
        return df.select(F.lit(None).cast("string").alias("pair"), F.lit(None).cast("double").alias("x"),
                         F.lit(None).cast("double").alias("y")).limit(0)
    arr = F.array(*[F.struct(F.lit(f"{role[b]} vs {role[a]}").alias("pair"),
                             F.col(role[a]).cast("double").alias("x"),
                             F.col(role[b]).cast("double").alias("y")) for a, b in pairs])
    return df.select(F.explode(arr).alias("_p")).select("_p.pair", "_p.x", "_p.y")
