"""Before/after comparison of a cleaning run: dropped rows, duplicates,
missing values, step counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.columns import contains_upper, nan_to_null, norm_eq, to_double, to_int
from furrow.operators.common import attach


def dropped_rows(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw rows with no equal row in the cleaned table on all common columns
    (null-safe; raw values are coerced to the cleaned column types)."""
    common = [c for c in raw.columns if c in clean.columns]
    values = _coerced(raw, clean, common)
    mine, theirs = [f"__l_{i}" for i in range(len(common))], [f"__c_{i}" for i in range(len(common))]
    # rows are dealt and sorted by one number; the columns are compared only
    # where it agrees, and least() keeps them from becoming join keys as well
    left = raw.withColumns({"__h": F.xxhash64(F.lit(0), *values)} | {m: v for m, c, v in zip(mine, common, values) if dict(raw.dtypes)[c] != dict(clean.dtypes)[c]})
    # existence is all an anti join needs: identical cleaned rows collapse
    # map-side, so copies of one row never pile up in a single join task
    right = clean.select(F.xxhash64(F.lit(0), *common).alias("__k"), *[F.col(c).alias(t) for c, t in zip(common, theirs)]).distinct()
    same = [F.col(m if m in left.columns else c).eqNullSafe(F.col(t)) for m, c, t in zip(mine, common, theirs)]
    cond = (F.col("__h") == F.col("__k")) & F.least(F.lit(True), F.lit(True), *same)
    return left.join(right, cond, "left_anti").select(*raw.columns)


def sample_rows(df: DataFrame, n: int = 50, order: Sequence[str] | None = None) -> DataFrame:
    """Deterministic first ``n`` rows under a total order (distributed top-k)."""
    order = list(order or df.columns)
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier identical row (nulls compare equal)."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
                 F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def _digest(columns: Sequence[Column]) -> list[Column]:
    """128 bits that name a row: two hashes of all values and of which of them
    are null (hashes skip nulls)."""
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    return [F.xxhash64(nulls, *columns), F.xxhash64(F.lit(1), nulls, *columns)]


def _coerced(raw: DataFrame, clean: DataFrame, common: Sequence[str]) -> list[Column]:
    """Common columns of the raw rows as the cleaning chain reads them: a
    fraction or an overflow is no integer there."""
    have, want, out = dict(raw.dtypes), dict(clean.dtypes), []
    for c in common:
        if have[c] == want[c]:
            out.append(F.col(c))
        elif want[c] in ("int", "bigint"):
            out.append(to_int(c).cast(want[c]))
        else:
            out.append(nan_to_null(to_double(c)) if want[c] == "double" else F.col(c).cast(want[c]))
    return out


def processing_compare(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """rows/cols/missing/duplicates before and after, rows removed and rows
    dropped by the merge, as (metric, value).

    Both tables are read once, as one union of row digests of 128 bits: one
    for the whole row, one for its values in the common columns. Identical rows
    are counted together before anything is shuffled, and no row's columns are.
    """
    common = [c for c in raw.columns if c in clean.columns]

    def side(df: DataFrame, is_raw: bool, values: list[Column]) -> DataFrame:
        missing = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
        whole, part = _digest([F.col(c) for c in df.columns]), _digest(values)
        return df.select(F.lit(is_raw).alias("is_raw"), *[c.alias(n) for n, c in zip(("r1", "r2", "c1", "c2"), whole + part)], missing.alias("missing"))

    rows = side(raw, True, _coerced(raw, clean, common)).unionByName(side(clean, False, [F.col(c) for c in common]))
    distinct = rows.groupBy("c1", "c2", "is_raw", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"))
    sides = {"orig": F.col("is_raw"), "clean": ~F.col("is_raw")}
    per_common = distinct.groupBy("c1", "c2").agg(*[x for s, mine in sides.items() for x in (
        F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias(f"{s}_rows"), F.count_if(mine).alias(f"{s}_distinct"),
        F.coalesce(F.sum(F.when(mine, F.col("missing"))), F.lit(0)).alias(f"{s}_missing"))])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = per_common.agg(*[total(f"{s}_{x}").alias(f"{s}_{x}") for s in sides for x in ("rows", "distinct", "missing")],
                         total(F.when(F.col("clean_rows") == 0, F.col("orig_rows"))).alias("dropped"))
    metrics = {}
    for s, df in (("orig", raw), ("clean", clean)):
        metrics |= {f"{s}_rows": F.col(f"{s}_rows"), f"{s}_cols": F.lit(len(df.columns)), f"{s}_missing_total": F.col(f"{s}_missing"),
                    f"{s}_duplicates": F.col(f"{s}_rows") - F.col(f"{s}_distinct")}
    metrics |= {"rows_removed": F.col("orig_rows") - F.col("clean_rows"), "dropped_rows_by_merge": F.col("dropped")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("long").alias("value"))
                                          for m, v in metrics.items()])).alias("_m")).select("_m.*")


def cleaning_audit(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Row counts after each cleaning step (one conditional-count pass over
    the raw rows) and the outlier counts of the cleaned rows."""
    s1 = norm_eq("STATISTIC_DESCRIPTION", "YIELD")
    s2 = s1 & contains_upper("UNIT_DESCRIPTION", "POUND")
    s3 = s2 & F.col("YEAR").isNotNull() & F.col("VALUE").isNotNull()
    s4 = s3 & to_int("YEAR").isNotNull() & nan_to_null(to_double("VALUE")).isNotNull()
    steps = raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(s1).alias("after_statistic_filter"),
                    F.count_if(s2).alias("after_unit_filter"), F.count_if(s3).alias("after_null_drop"),
                    F.count_if(s4).alias("after_coercion_drop"))
    outl = clean.agg(F.count_if("is_outlier_iqr").alias("iqr_outliers"),
                     F.count_if(F.abs("value_zscore") > 3).alias("zscore_outliers"))
    j = attach(steps, outl)
    names = ["raw_rows", "after_statistic_filter", "after_unit_filter", "after_null_drop",
             "after_coercion_drop", "iqr_outliers", "zscore_outliers"]
    return j.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(m).alias("step"),
                                                 F.col(m).cast("long").alias("value"))
                                        for i, m in enumerate(names)])).alias("_m")).select("_m.*")
