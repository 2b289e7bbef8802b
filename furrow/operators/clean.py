"""Cleaning and feature operators over the long statistics table.

Stats-driven steps (scaling, IQR, z-score, winsorising) compute all their
statistics in one grouped pass (moments) plus one exact-quantile pass, and
attach them to the rows with a broadcast (global) or keyed join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.columns import (
    clip, contains_upper, first_present, nan_to_null, norm_eq, norm_upper,
    regex_contains, to_double, to_int,
)
from furrow.operators.common import attach, attach_checked, materialize
from furrow.operators.quantiles import exact_quantiles
from furrow.operators.ranking import grouped_rank

# Fixed labels and patterns of the reference's cleaning rules.
STATISTIC_WANTED = "YIELD"
UNIT_TOKEN = "POUND"
US_TOTAL = "U.S. TOTAL"
ALL_CLASSES = "ALL CLASSES"
US_REGEX = "U.S"          # a regex: '.' matches any character (kept on purpose in regex mode)
ALL_REGEX = "ALL"
RENAMES = {"Year": "YEAR", "LOCATION": "LOCATION_DESCRIPTION", "CLASS": "CLASS_DESCRIPTION"}
VALUE_CANDIDATES = ["VALUE", "YIELD", "Value"]
LOCATION_CANDIDATES = ["STATE", "STATE_NAME", "State", "LOCATION", "Location", "LOCATION_DESCRIPTION", "LOCATION_NAME"]
# Unit standardisation: unit -> (factor, standard unit).
UNIT_FACTORS = {
    "THOUSAND ACRES": (1000.0, "ACRES"),
    "THOUSAND CWT": (100000.0, "POUNDS"),
}


# ---- projections and filters -------------------------------------------------

def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename alternate spellings only when the canonical name is absent, and
    take VALUE from the first present of VALUE/YIELD/Value."""
    for src, dst in RENAMES.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    vc = first_present(df.columns, VALUE_CANDIDATES)
    if vc is not None and vc != "VALUE":
        df = df.withColumn("VALUE", F.col(vc))
    return df


def location_and_value(df: DataFrame) -> DataFrame:
    """LOCATION_DESCRIPTION and numeric VALUE of a table with other column
    names, each from the first of its candidates that the table has; a table
    without one of them is an error."""
    found = {"LOCATION_DESCRIPTION": first_present(df.columns, LOCATION_CANDIDATES), "VALUE": first_present(df.columns, VALUE_CANDIDATES)}
    if None in found.values():
        raise ValueError(f"no location or no value column among {', '.join(df.columns)}")
    return df.select(F.col(found["LOCATION_DESCRIPTION"]).alias("LOCATION_DESCRIPTION"),
                     nan_to_null(to_double(found["VALUE"])).alias("VALUE"))


def preferred_value(df: DataFrame, out: str = "VALUE_used") -> DataFrame:
    """Add the modelling value: VALUE_clipped where the table and the row have
    one, else VALUE."""
    have = [c for c in ("VALUE_clipped", "VALUE") if c in df.columns]
    return df.withColumn(out, F.coalesce(*have))


def filter_statistic(df: DataFrame, wanted: str = STATISTIC_WANTED,
                     col: str = "STATISTIC_DESCRIPTION") -> DataFrame:
    return df.where(norm_eq(col, wanted))


def filter_unit(df: DataFrame, token: str = UNIT_TOKEN, col: str = "UNIT_DESCRIPTION") -> DataFrame:
    return df.where(contains_upper(col, token))


def filter_statistic_regex(df: DataFrame, pattern: str = STATISTIC_WANTED,
                           col: str = "STATISTIC_DESCRIPTION") -> DataFrame:
    if col not in df.columns:
        return df
    return df.where(regex_contains(col, pattern))


def drop_null_keys(df: DataFrame, subset: Sequence[str] = ("YEAR", "VALUE")) -> DataFrame:
    return df.na.drop(subset=list(subset))


def _numeric_col(df: DataFrame, col: str, whole: bool):
    """Coercion expression for one column, chosen from its type: text is
    parsed (guarded, never raises), numbers are only cast or NaN-cleaned."""
    dtype = dict(df.dtypes)[col]
    if dtype in ("string", "varchar") or dtype.startswith("varchar") or dtype.startswith("char"):
        return to_int(col) if whole else to_double(col)     # the text guard never yields NaN
    if dtype in ("int", "bigint", "smallint", "tinyint"):
        return F.col(col).cast("int") if whole else F.col(col).cast("double")
    d = nan_to_null(F.col(col).cast("double"))
    return F.when(d == F.floor(d), d.try_cast("int")) if whole else d


def coerce_numeric(df: DataFrame, year_col: str = "YEAR", value_col: str = "VALUE") -> DataFrame:
    """Text -> numbers; unparsable cells and NaN become null (ANSI-safe)."""
    return df.withColumns({year_col: _numeric_col(df, year_col, True),
                           value_col: _numeric_col(df, value_col, False)})


def finite_pairs(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_points: int = 2) -> DataFrame:
    """Rows with finite x and y, in groups that keep at least ``min_points``.

    Group sizes come from a partial aggregate and are applied with a semi
    join (a hot group is never gathered into one window task; AQE splits a
    skewed join partition)."""
    from furrow.functions.columns import is_finite
    keys = list(keys)
    ok = df.where(is_finite(F.col(x).cast("double")) & is_finite(F.col(y).cast("double")))
    cnt = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    if not keys:
        return attach(ok, cnt.select(F.lit(True).alias("_keep"))).drop("_keep")
    return attach(ok, cnt.select(*keys), keys, how="left_semi")


# ---- flags ----------------------------------------------------------------------

def add_series_flags(df: DataFrame, mode: str = "exact") -> DataFrame:
    """is_us_total / is_all_classes.

    exact: trim+upper equality (the main cleaning path).
    regex: upper-case regex search 'U.S' / 'U.S. TOTAL' and 'ALL' as in the
    minimal path - the '.' wildcard flags more than the total (kept as is).
    Missing description columns give false flags.
    """
    loc, cls = "LOCATION_DESCRIPTION", "CLASS_DESCRIPTION"
    if mode == "exact":
        us = norm_eq(loc, US_TOTAL) if loc in df.columns else F.lit(False)
        al = norm_eq(cls, ALL_CLASSES) if cls in df.columns else F.lit(False)
    elif mode == "regex":
        # null descriptions become the text 'nan' upstream; never a match
        us = (regex_contains(F.upper(loc), US_REGEX) | regex_contains(F.upper(loc), "U.S. TOTAL")) \
            if loc in df.columns else F.lit(False)
        al = regex_contains(F.upper(cls), ALL_REGEX) if cls in df.columns else F.lit(False)
    else:
        raise ValueError(f"unknown flag mode {mode!r}")
    return df.withColumns({"is_us_total": us, "is_all_classes": al})


def total_series_rows(df: DataFrame) -> DataFrame:
    """Rows of the aggregate series: both flags true; if no row has both
    flags, fall back to description equality. The fallback decision is a
    one-row aggregate attached by broadcast, so no driver round trip."""
    if "is_us_total" in df.columns and "is_all_classes" in df.columns:
        flagged = F.coalesce(F.col("is_us_total") & F.col("is_all_classes"), F.lit(False))
    else:
        flagged = F.lit(False)
    by_desc = (F.coalesce(F.upper("LOCATION_DESCRIPTION") == US_TOTAL, F.lit(False))
               & F.coalesce(F.upper("CLASS_DESCRIPTION") == ALL_CLASSES, F.lit(False)))
    tagged = df.withColumn("_flagged", flagged)
    any_flag = tagged.agg(F.coalesce(F.bool_or("_flagged"), F.lit(False)).alias("_any"))
    out = attach(tagged, any_flag).where(F.col("_flagged") | (~F.col("_any") & by_desc))
    return out.drop("_flagged", "_any")


# ---- encodings --------------------------------------------------------------------

def one_hot(df: DataFrame, col: str = "CLASS_DESCRIPTION", prefix: str = "CLASS",
            values: Sequence[str] | None = None, max_values: int = 1000) -> DataFrame:
    """Boolean indicator per category value, columns sorted by value.

    The value list is the plan's column list, so it is fixed up front: either
    given, or read as the distinct values of the table, of which more than
    ``max_values`` raise an error: so many columns are better kept as codes
    (:func:`class_codes`). Null -> all false.
    """
    if values is None:
        distinct = df.select(F.col(col).alias("v")).where(F.col("v").isNotNull()).distinct()
        values = [r.v for r in distinct.limit(max_values + 1).collect()]
        if len(values) > max_values:
            raise ValueError(f"{col} has more than {max_values} values; pass values=, or use class_codes")
    return df.withColumns({f"{prefix}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False))
                           for v in sorted(values)})


def class_codes(df: DataFrame, col: str = "CLASS_DESCRIPTION", out: str = "CLASS_CODE") -> tuple[DataFrame, DataFrame]:
    """Indicators of any number of categories in sparse form: the rows with
    ``out``, the place from 0 of the one indicator that is true (null for a null
    value), and the dictionary (``col``, ``out``) in the order of the values.
    Nothing is collected, and the dictionary is ranked in all tasks."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    codes = materialize(grouped_rank(values, [col], out=out).withColumn(out, F.col(out).cast("int")), "class-codes")
    return attach_checked(df, codes, [col], "class-codes", "left"), codes


def factorize(df: DataFrame, col: str = "LOCATION_DESCRIPTION", order_col: str = "YEAR",
              out: str = "LOCATION_CODE") -> DataFrame:
    """Integer codes in order of first appearance along ``order_col``.

    First appearance = smallest ``order_col`` of the value (ties by value).
    The distinct values are ranked in all tasks; null stays null (code -1 in
    pandas is not a category).
    """
    first = (df.where(F.col(col).isNotNull()).groupBy(col)
               .agg(F.min(order_col).alias("_first")))
    codes = grouped_rank(first, ["_first", col], out="_code").select(col, F.col("_code").cast("int").alias(out))
    return attach_checked(df, codes, [col], "location-codes", "left")


# ---- statistics-driven columns ----------------------------------------------------

def value_stats(df: DataFrame, value_col: str = "VALUE", keys: Sequence[str] = (),
                extra_cols: Sequence[str] = (), probs: dict | None = None) -> DataFrame:
    """Moments (+ optional exact quantiles) per key in one aggregate pass."""
    keys = list(keys)
    v = F.col(value_col)
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop")]
    for c in extra_cols:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_pop_{c}")]
    moments = df.groupBy(*keys).agg(*aggs)
    if probs:
        q = exact_quantiles(df, value_col, probs, keys)
        moments = attach(moments, q, keys, how="left")
    return moments


def _scaled(c: str, mean: str, sd: str):
    # StandardScaler: population sd; a zero sd leaves the centred value
    return (F.col(c) - F.col(mean)) / F.when(F.col(sd).isNull() | (F.col(sd) == 0), F.lit(1.0)).otherwise(F.col(sd))


def standard_scale(df: DataFrame, cols: Sequence[str] = ("YEAR", "VALUE"), keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    st = df.groupBy(*keys).agg(*[x for c in cols for x in
                                 (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = attach(df, st, keys)
    out = out.withColumns({f"{c}_scaled": _scaled(c, f"_m_{c}", f"_s_{c}") for c in cols})
    return out.drop(*[x for c in cols for x in (f"_m_{c}", f"_s_{c}")])


IQR_PROBS = {"q1": 0.25, "q3": 0.75}
WINSOR_PROBS = {"p01": 0.01, "p99": 0.99}


def iqr_flag(df: DataFrame, value_col: str = "VALUE", keys: Sequence[str] = (), k: float = 1.5,
             out: str = "is_outlier_iqr") -> DataFrame:
    q = exact_quantiles(df, value_col, IQR_PROBS, keys)
    j = attach(df, q, keys, how="left")
    iqr = F.col("q3") - F.col("q1")
    v = F.col(value_col)
    flag = F.coalesce((v < F.col("q1") - k * iqr) | (v > F.col("q3") + k * iqr), F.lit(False))
    return j.withColumn(out, flag).drop("q1", "q3")


def zscore(df: DataFrame, value_col: str = "VALUE", keys: Sequence[str] = (), threshold: float = 3.0,
           out: str = "value_zscore", flag: str | None = "is_outlier_z") -> DataFrame:
    keys = list(keys)
    st = df.groupBy(*keys).agg(F.avg(value_col).alias("_zm"), F.stddev_samp(value_col).alias("_zs"))
    j = attach(df, st, keys, how="left")
    z = (F.col(value_col) - F.col("_zm")) / F.col("_zs")
    z = F.when(F.col("_zs") != 0, z)
    j = j.withColumn(out, z)
    if flag:
        j = j.withColumn(flag, F.coalesce(F.abs(F.col(out)) > threshold, F.lit(False)))
    return j.drop("_zm", "_zs")


def winsorize(df: DataFrame, value_col: str = "VALUE", keys: Sequence[str] = (),
              lower: float = 0.01, upper: float = 0.99, out: str = "VALUE_clipped") -> DataFrame:
    q = exact_quantiles(df, value_col, {"_lo": lower, "_hi": upper}, keys)
    j = attach(df, q, keys, how="left")
    return j.withColumn(out, clip(value_col, "_lo", "_hi")).drop("_lo", "_hi")


def outlier_columns(df: DataFrame, value_col: str = "VALUE", keys: Sequence[str] = (),
                    lower: float = 0.01, upper: float = 0.99, k: float = 1.5, z: float = 3.0) -> DataFrame:
    """Winsorised value, IQR flag and z-score (+ flag) from one per-key
    statistics table (one moments pass, one quantile pass, one attach)."""
    keys = list(keys)
    st = value_stats(df, value_col, keys, probs={"_lo": lower, "_hi": upper, "_q1": 0.25, "_q3": 0.75})
    # groups without values have a row of moments too, so none is lost
    st = st.select(*keys, "mean", "std", "_lo", "_hi", "_q1", "_q3")
    j = attach_checked(df, st, keys, "outlier-stats") if keys else attach(df, st)
    v = F.col(value_col)
    iqr = F.col("_q3") - F.col("_q1")
    zs = F.when(F.col("std") != 0, (v - F.col("mean")) / F.col("std"))
    j = j.withColumns({
        "VALUE_clipped": clip(value_col, "_lo", "_hi"),
        "is_outlier_iqr": F.coalesce((v < F.col("_q1") - k * iqr) | (v > F.col("_q3") + k * iqr), F.lit(False)),
        "value_zscore": zs,
    })
    j = j.withColumn("is_outlier_z", F.coalesce(F.abs(F.col("value_zscore")) > z, F.lit(False)))
    return j.drop("mean", "std", "_lo", "_hi", "_q1", "_q3")


def normalize_units(df: DataFrame, value_col: str = "VALUE", unit_col: str = "UNIT_DESCRIPTION") -> DataFrame:
    """Scale values of 'thousand' units to base units; unknown units unchanged."""
    factor, unit = F.lit(1.0), F.col(unit_col)
    key = norm_upper(unit_col)
    for u, (f, std) in UNIT_FACTORS.items():
        factor = F.when(key == u, F.lit(f)).otherwise(factor)
        unit = F.when(key == u, F.lit(std)).otherwise(unit)
    return df.withColumns({value_col: F.col(value_col) * factor, unit_col: unit})


def pivot_statistics(df: DataFrame, keys: Sequence[str], statistics: Sequence[str],
                     stat_col: str = "STATISTIC_DESCRIPTION", value_col: str = "VALUE") -> DataFrame:
    """One row per key with one column per statistic (explicit value list, so
    no distinct pass); duplicates average."""
    norm = df.where(norm_upper(stat_col).isin(list(statistics))).withColumn("_stat", norm_upper(stat_col))
    return norm.groupBy(*keys).pivot("_stat", list(statistics)).agg(F.avg(value_col))


def impute_group_median(df: DataFrame, value_col: str, group_col: str, out: str | None = None) -> DataFrame:
    """null -> median of its group, else -> overall median."""
    out = out or value_col
    gm = exact_quantiles(df, value_col, {"_gmed": 0.5}, [group_col])
    om = exact_quantiles(df, value_col, {"_omed": 0.5})
    # groups without a value have no median of their own, but a row
    groups = attach(attach(df.select(group_col).distinct(), gm, [group_col], how="left"), om)
    j = attach_checked(df, groups, [group_col], "group-medians")
    return j.withColumn(out, F.coalesce(F.col(value_col), F.col("_gmed"), F.col("_omed"))).drop("_gmed", "_omed")


def replace_group_outliers(df: DataFrame, value_col: str, group_col: str, threshold: float = 3.0,
                           out: str | None = None) -> DataFrame:
    """Values with |z| > threshold within their group -> group median."""
    out = out or value_col
    st = df.groupBy(group_col).agg(F.avg(value_col).alias("_m"), F.stddev_samp(value_col).alias("_s"))
    med = exact_quantiles(df, value_col, {"_med": 0.5}, [group_col])
    j = attach_checked(df, attach(st, med, [group_col], how="left"), [group_col], "group-stats")
    z = F.when(F.col("_s") != 0, (F.col(value_col) - F.col("_m")) / F.col("_s"))
    return (j.withColumn(out, F.when(F.coalesce(F.abs(z) > threshold, F.lit(False)), F.col("_med"))
                         .otherwise(F.col(value_col)))
             .drop("_m", "_s", "_med"))


# ---- full chains ------------------------------------------------------------------

def clean_observations(df: DataFrame, keys: Sequence[str] = (), class_values: Sequence[str] | None = None,
                       order_col: str = "YEAR", write_rows: bool = True) -> DataFrame:
    """The full cleaning chain: statistic and unit filters, null drops around
    number coercion, exact flags, trimmed descriptions with class one-hot and
    location codes, population-sd scaling of YEAR and VALUE, IQR flag,
    sample-sd z-score and 1/99 % winsorising. Statistics are global by
    default or per ``keys``; moments and quantiles each take one pass. The rows
    are written once, after the filters; the result adds the written statistics
    and codes to them."""
    keys = list(keys)
    df = strip_column_names(df)
    df = filter_unit(filter_statistic(df))
    df = drop_null_keys(df)
    df = drop_null_keys(coerce_numeric(df))
    df = add_series_flags(df, "exact")
    df = df.withColumns({"CLASS_DESCRIPTION": F.trim("CLASS_DESCRIPTION"),
                         "LOCATION_DESCRIPTION": F.trim("LOCATION_DESCRIPTION")})
    if write_rows:
        # one pass over the raw rows; the indicators' values, codes, statistics
        # and output read it, and no indicator is written
        df = materialize(df, "clean-rows")
    df = one_hot(df, "CLASS_DESCRIPTION", "CLASS", class_values)
    df = factorize(df, "LOCATION_DESCRIPTION", order_col, "LOCATION_CODE")
    st = df.groupBy(*keys).agg(
        F.avg("YEAR").alias("_my"), F.stddev_pop("YEAR").alias("_sy"),
        F.avg("VALUE").alias("_mv"), F.stddev_pop("VALUE").alias("_sv"),
        F.stddev_samp("VALUE").alias("_zs"))
    q = exact_quantiles(df, "VALUE", {"_q1": 0.25, "_q3": 0.75, "_p01": 0.01, "_p99": 0.99}, keys)
    st = attach(st, q, keys, how="left")
    j = attach_checked(df, st, keys, "clean-stats") if keys else attach(df, materialize(st, "clean-stats"))
    iqr = F.col("_q3") - F.col("_q1")
    v = F.col("VALUE")
    j = j.withColumns({
        "YEAR_scaled": _scaled("YEAR", "_my", "_sy"),
        "VALUE_scaled": _scaled("VALUE", "_mv", "_sv"),
        "is_outlier_iqr": F.coalesce((v < F.col("_q1") - 1.5 * iqr) | (v > F.col("_q3") + 1.5 * iqr), F.lit(False)),
        "value_zscore": F.when(F.col("_zs") != 0, (v - F.col("_mv")) / F.col("_zs")),
        "VALUE_clipped": clip("VALUE", "_p01", "_p99"),
    })
    return j.drop("_my", "_sy", "_mv", "_sv", "_zs", "_q1", "_q3", "_p01", "_p99")


def clean_minimal(df: DataFrame) -> DataFrame:
    """The minimal in-app chain: regex statistic filter, renames, coercion of
    VALUE, regex flags and global 1/99 % winsorising (rows kept)."""
    df = filter_statistic_regex(df)
    df = canonical_columns(df)
    if "VALUE" in df.columns:
        df = df.withColumn("VALUE", _numeric_col(df, "VALUE", False))
    df = add_series_flags(df, "regex")
    if "VALUE" in df.columns:
        df = winsorize(df, "VALUE")
    return df
