"""Tail probabilities of Student's t and F, as Column expressions.

Spark SQL has no t or F distribution function. For whole degrees of freedom
the tail is a regularised incomplete beta function whose factor is a short
product and whose continued fraction is a recurrence, so both are an
``aggregate`` over a sequence inside the row. Quantiles are solved once per
distinct degrees of freedom and joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.common import attach, reserved_keys

#: Most steps of the continued fraction, and those of Newton's method. The
#: fraction is as good as doubles are after some 3 sqrt(a + b) + 12 steps.
STEPS, NEWTON = 200, 5
#: Degrees of freedom above which the factor comes from its expansion.
EXACT_DF = 400
Z975 = 1.959963984540054  # standard normal 97.5 % point


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    d0 = 1 / tiny(1 - (a + b) * x / (a + 1))

    def half(s: Column, term: Column) -> Column:
        c, d = tiny(1 + term / s["c"]), 1 / tiny(1 + term * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def even(s: Column, i: Column) -> Column:
        m = i.cast("double")
        return half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))

    def odd(s: Column, i: Column) -> Column:
        m = i.cast("double")
        return half(s, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    # terms 1, 2, ... 2 * STEPS: even and odd ones take turns
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    step = lambda s, i: F.when(i % 2 == 0, even(s, (i / 2).cast("int"))).otherwise(odd(s, ((i - 1) / 2).cast("int")))
    steps = F.least(F.lit(STEPS), F.ceil(4 * F.sqrt(a + b)).cast("int") + 16)
    return F.aggregate(F.sequence(F.lit(2), 2 * steps + 1), start, step, lambda s: s["h"])


def _product(terms: Column, factor) -> Column:
    """Product of factor(j) for j = 1 .. terms (1 for none)."""
    js = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(js, F.lit(1.0), lambda p, j: p * factor(j.cast("double")))


def _factor(d1: int, d2: Column) -> Column:
    """Gamma(a + b) / (Gamma(a + 1) Gamma(b)) with a = d2 / 2 and b = d1 / 2."""
    a = d2.cast("double") / 2
    if d1 % 2 == 0:
        first, b = F.lit(1.0), 1.0
    else:
        half = F.floor(d2 / 2).cast("int")
        even = _product(half, lambda j: (2 * j - 1) / (2 * j))
        odd = 2 / math.pi * _product(half, lambda j: 2 * j / (2 * j + 1))
        far = (1 - 1 / (8 * a) + 1 / (128 * a * a) + 5 / (1024 * a * a * a) - 21 / (32768 * a * a * a * a)) / F.sqrt(a * math.pi)
        first, b = F.when(d2 > EXACT_DF, far).when(d2 % 2 == 0, even).otherwise(odd), 0.5
    while b < d1 / 2:
        first, b = first * (a + b) / b, b + 1
    return first


def f_tail(f: Column, d1: int, d2: Column) -> Column:
    """P(F > f) for d1 and d2 whole degrees of freedom; null where f is null or
    d2 is below 1, 1 for f = 0."""
    d2 = F.when(d2 >= 1, d2.cast("int"))
    a, b, r = d2.cast("double") / 2, F.lit(d1 / 2), f * d1 / d2.cast("double")
    x, y = 1 / (1 + r), r / (1 + r)
    front = _factor(d1, d2) * F.exp(-a * F.log1p(r)) * F.pow(y, b)
    near = x < (a + 1) / (a + b + 2)
    return (F.when(f.isNull() | d2.isNull(), F.lit(None).cast("double")).when(f <= 0, F.lit(1.0))
            .when(near, front * _fraction(a, b, x)).otherwise(1 - front * a / b * _fraction(b, a, y)))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided P(|T| > |t|) for whole degrees of freedom."""
    return f_tail(t * t, 1, df)


def t_critical(dfs: DataFrame, df: str = "df", out: str = "t_crit") -> DataFrame:
    """The 97.5 % points of Student's t for the distinct values of ``df``
    (whole numbers from 1 on): Newton's method from an expansion around the
    normal point, exact for 1 and 2."""
    v = F.col(df).cast("double")
    z = Z975
    start = (z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v * v * v))
    scale = _factor(1, F.col(df)) * F.sqrt(v) / 2  # the density at 0
    slope = lambda t: 2 * scale * F.exp(-(v + 1) / 2 * F.log1p(t * t / v))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.col("start"), lambda t, _: t + (t_tail(t, F.col(df)) - 0.05) / slope(t))
    known = F.when(F.col(df) == 1, F.lit(math.tan(0.475 * math.pi))).when(F.col(df) == 2, F.lit(0.95 * math.sqrt(2 / (1 - 0.95**2))))
    distinct = dfs.select(F.col(df).cast("int").alias(df)).where(F.col(df) >= 1).distinct().withColumn("start", start)
    return distinct.select(df, F.coalesce(known, solved).alias(out))


def _with_critical(table: DataFrame, df: Column) -> DataFrame:
    """``_df`` (null below 1) and ``_tc``, its 97.5 % point."""
    d = table.withColumn("_df", F.when(df >= 1, df.cast("int")))
    return attach(d, t_critical(d, "_df", "_tc"), ["_df"], how="left")


def _bounds(name: str, se: str) -> list[Column]:
    return [(F.col(name) - F.col("_tc") * F.col(se)).alias(f"{name}_ci_lo"), (F.col(name) + F.col("_tc") * F.col(se)).alias(f"{name}_ci_hi")]


@reserved_keys
def ols_pvalues(inference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p-values of t and F and 95 % confidence intervals per series; null for
    a series without residual degrees of freedom."""
    d = _with_critical(inference, F.col("df_resid"))
    return d.select(*keys, "slope", "se_slope", t_tail(F.col("t_slope"), F.col("_df")).alias("p_slope"), *_bounds("slope", "se_slope"),
                    "intercept", "se_intercept", t_tail(F.col("t_intercept"), F.col("_df")).alias("p_intercept"), *_bounds("intercept", "se_intercept"),
                    "f_stat", f_tail(F.col("f_stat"), 1, F.col("_df")).alias("p_f"))


@reserved_keys
def hac_pvalues(hac: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p-values, 95 % confidence intervals (t with n - 2 degrees of freedom)
    and p(F) of a robust trend table; null where n - 2 is not positive."""
    d = _with_critical(hac, F.col("n") - 2)
    return d.select(*keys, "n", "slope", "hac_se_slope", t_tail(F.col("hac_t_slope"), F.col("_df")).alias("p_slope"),
                    "intercept", "hac_se_intercept", t_tail(F.col("hac_t_intercept"), F.col("_df")).alias("p_intercept"),
                    *_bounds("slope", "hac_se_slope"), *_bounds("intercept", "hac_se_intercept"),
                    "hac_f", f_tail(F.col("hac_f"), 1, F.col("_df")).alias("p_f"))
