"""Residual diagnostics per series: HAC errors, Durbin-Watson, ACF with
Bartlett band, QQ coordinates, moment-based normality tests, Gaussian KDE.

Lags come from blocks of a series with a halo (``operators.lags``): products
are summed per block and the sums are merged, so that no task holds a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from furrow.functions.columns import probit
from furrow.operators.common import attach, attach_checked, materialize, reserved_keys
from furrow.operators.lags import with_lags
from furrow.operators.quantiles import exact_quantiles
from furrow.operators.ranking import grouped_rank
from furrow.operators.trend import fitted_values, ols_fit

Z975 = 1.959963984540054   # standard normal 97.5 % point
HAC_LAGS = 4
ACF_LAGS = 20
KDE_POINTS = 200


def ols_residuals(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    keys = list(keys)
    fit = ols_fit(points, keys, x, y)
    return fitted_values(points, fit, keys, x, y), fit


@reserved_keys
def newey_west(points: DataFrame, keys: Sequence[str], maxlags: int = HAC_LAGS,
               x: str = "x", y: str = "y") -> DataFrame:
    """HAC (Bartlett kernel) standard errors of the OLS trend, no small-sample
    correction; robust F of the slope. Computed with centred x, then mapped
    back to the intercept of the uncentred model."""
    keys = list(keys)
    fv, fit = ols_residuals(points, keys, x, y)
    r = fv.select(*keys, F.col(x).alias("_x"), (F.col(x).cast("double") - F.col("x_mean")).alias("_xc"), F.col("resid").alias("_e"))
    r = with_lags(r, keys, ["_x"], ["_xc", "_e"], maxlags)
    e, xc = F.col("_e"), F.col("_xc")
    s00, s01, s11 = F.sum(e * e), F.sum(xc * e * e), F.sum(xc * xc * e * e)
    for l in range(1, maxlags + 1):
        wl = 1.0 - l / (maxlags + 1.0)
        el, xl = F.col(f"_e_{l}"), F.col(f"_xc_{l}")
        s00 = s00 + F.lit(2 * wl) * F.coalesce(F.sum(e * el), F.lit(0.0))
        s01 = s01 + F.lit(wl) * F.coalesce(F.sum(e * el * (xc + xl)), F.lit(0.0))
        s11 = s11 + F.lit(2 * wl) * F.coalesce(F.sum(xc * xl * e * el), F.lit(0.0))
    g = r.groupBy(*keys).agg(s00.alias("_s00"), s01.alias("_s01"), s11.alias("_s11"))
    g = attach(g, fit.select(*keys, "n", "sxx", "x_mean", "slope", "intercept"), keys)
    n, sxx, xm = F.col("n").cast("double"), F.col("sxx"), F.col("x_mean")
    dv = F.try_divide
    v00 = dv(F.col("_s00"), n * n)
    v01 = dv(F.col("_s01"), n * sxx)
    v11 = dv(F.col("_s11"), sxx * sxx)
    g = g.withColumns({
        "hac_se_slope": F.sqrt(v11),
        "hac_se_intercept": F.sqrt(v00 - 2 * xm * v01 + xm * xm * v11),
    })
    g = g.withColumns({
        "hac_t_slope": F.try_divide(F.col("slope"), F.col("hac_se_slope")),
        "hac_t_intercept": F.try_divide(F.col("intercept"), F.col("hac_se_intercept")),
    })
    g = g.withColumn("hac_f", F.col("hac_t_slope") * F.col("hac_t_slope"))
    return g.select(*keys, "n", "slope", "intercept", "hac_se_slope", "hac_se_intercept",
                    "hac_t_slope", "hac_t_intercept", "hac_f")


@reserved_keys
def durbin_watson(resid: DataFrame, keys: Sequence[str], x: str = "x", e: str = "resid") -> DataFrame:
    keys = list(keys)
    r = with_lags(resid.select(*keys, F.col(x).alias("_x"), F.col(e).alias("_e")), keys, ["_x"], ["_e"], 1)
    d = F.col("_e") - F.col("_e_1")
    return r.groupBy(*keys).agg(F.try_divide(F.sum(d * d), F.sum(F.col("_e") * F.col("_e"))).alias("dw"))


@reserved_keys
def residual_acf(resid: DataFrame, keys: Sequence[str], nlags: int = ACF_LAGS,
                 x: str = "x", e: str = "resid") -> DataFrame:
    """Biased ACF (divide by the lag-0 sum) for lags 0..nlags, Bartlett band."""
    keys = list(keys)
    r = resid.select(*keys, F.col(x).alias("_x"), F.col(e).alias("_e"))
    r = attach_checked(r, r.groupBy(*keys).agg(F.avg("_e").alias("_m")), keys, "acf-stats")
    r = with_lags(r.select(*keys, "_x", (F.col("_e") - F.col("_m")).alias("_c")), keys, ["_x"], ["_c"], nlags)
    sums = [F.sum(F.col("_c") * F.col("_c")).alias("s0")] + \
           [F.sum(F.col("_c") * F.col(f"_c_{k}")).alias(f"s{k}") for k in range(1, nlags + 1)]
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    lags = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in range(nlags + 1)]))
    long = g.select(*keys, "n", "s0", lags.alias("_l")).select(
        *keys, "n", F.col("_l.lag").alias("lag"), F.coalesce(F.col("_l.s"), F.lit(0.0)).alias("_s"), "s0")
    long = long.withColumn("acf", F.try_divide(F.col("_s"), F.col("s0")))
    wl = Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.sum(F.when(F.col("lag") >= 1, F.col("acf") * F.col("acf"))).over(wl), F.lit(0.0))
    band = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(
        F.lit(Z975) * F.sqrt((F.lit(1.0) + 2 * prior) / F.col("n").cast("double")))
    return long.select(*keys, "lag", "acf", band.alias("band"))


@reserved_keys
def residual_qq(resid: DataFrame, keys: Sequence[str], e: str = "resid") -> DataFrame:
    """Sorted residuals against normal quantiles of i/(n+1); reference line
    through mean and population sd of the residuals. Ranks come from range
    partitions, so a long series is spread over all tasks."""
    keys = list(keys)
    r = resid.select(*keys, F.col(e).alias("sample")).where(F.col(e).isNotNull())
    st = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("sample").alias("_m"), F.stddev_pop("sample").alias("_s"))
    r = grouped_rank(r, ["sample"], keys, "i").withColumn("i", (F.col("i") + 1).cast("int"))
    r = attach_checked(r, st, keys, "qq-stats")
    th = probit(F.col("i") / (F.col("n") + F.lit(1.0)))
    return r.select(*keys, "i", "sample", th.alias("theoretical"),
                    (F.col("_s") * th + F.col("_m")).alias("line"))


@reserved_keys
def normality_tests(resid: DataFrame, keys: Sequence[str], e: str = "resid") -> DataFrame:
    """Skew, kurtosis (population moments), Jarque-Bera and D'Agostino-
    Pearson omnibus K^2, with chi-square(2) tail probabilities. Every series
    has a row; the omnibus is null below 8 points, where its kurtosis part is
    not defined, and all are null for constant residuals."""
    keys = list(keys)
    # both are one mergeable aggregate over population moments
    g = resid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.skewness(e).alias("skew"),
                                 (F.kurtosis(e) + 3.0).alias("kurtosis"))
    n = F.col("n").cast("double")
    s, k = F.col("skew"), F.col("kurtosis")
    jb = n / 6 * (s * s + (k - 3) * (k - 3) / 4)
    # the expressions below see no series too short for them
    n = F.when(F.col("n") >= 8, n)
    # skewness test (D'Agostino 1970)
    yv = s * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.lit(-1.0) + F.sqrt(2 * (beta2 - 1))
    delta = F.lit(1.0) / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    yv = F.when(yv == 0, F.lit(1.0)).otherwise(yv)
    zs = delta * F.log(yv / alpha + F.sqrt((yv / alpha) * (yv / alpha) + 1))
    # kurtosis test (Anscombe & Glynn 1983)
    ek = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    xk = (k - ek) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + xk * F.sqrt(2 / (a - 4.0))
    term2 = F.signum(denom) * F.cbrt((1 - 2.0 / a) / F.abs(denom))
    zk = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    k2 = zs * zs + zk * zk
    return g.select(*keys, "n", "skew", "kurtosis", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jb_pvalue"),
                    k2.alias("omnibus"), F.exp(-k2 / 2).alias("omnibus_pvalue"))


#: Series whose sums a task holds at once.
KDE_HELD = 10_000


@reserved_keys
def residual_kde(resid: DataFrame, keys: Sequence[str], e: str = "resid", points: int = KDE_POINTS) -> DataFrame:
    """Gaussian KDE on an even grid from min to max, Scott bandwidth
    n^(-1/5) * sample sd. Tasks add the kernels of their residuals into one
    array of ``points`` numbers per series, and the arrays are summed place by
    place. A series with fewer than two residuals or none of spread keeps one
    row with nulls; null residuals don't count."""
    keys = list(keys)
    st = resid.groupBy(*keys).agg(F.count(e).alias("n"), F.min(e).alias("lo"), F.max(e).alias("hi"), F.stddev_samp(e).alias("sd"))
    st = materialize(st.withColumn("h", F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.pow(F.col("n").cast("double"), -0.2) * F.col("sd"))), "kde-stats")
    rows = attach_checked(resid.where(F.col(e).isNotNull()).select(*keys, F.col(e).cast("double").alias("e")),
                          st.where("h is not null").select(*keys, "lo", "hi", "h"), keys, "kde-stats")
    kept = [rows.schema[k] for k in keys]

    def kernels(batches):
        sums: dict = {}

        def out():
            cells = list(zip(*sums)) if keys else []
            columns = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(cells, kept)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.list_(pa.float64()))], names=[*keys, "sums"])

        for b in batches:
            ids: dict = {}
            code = np.fromiter((ids.setdefault(k, len(ids)) for k in zip(*(b.column(k).to_pylist() for k in keys))) if keys
                               else (ids.setdefault((), 0) for _ in range(b.num_rows)), np.int64, b.num_rows)
            value, lo, hi, h = (b.column(c).to_numpy() for c in ("e", "lo", "hi", "h"))
            for key, i in ids.items():
                at = np.flatnonzero(code == i) if len(ids) > 1 else np.arange(b.num_rows)
                grid = lo[at[0]] + (hi[at[0]] - lo[at[0]]) * np.arange(points) / (points - 1.0)
                total = sums.setdefault(key, np.zeros(points))
                for part in np.array_split(value[at], len(at) // 1000 + 1):
                    total += np.exp(-0.5 * ((grid[:, None] - part) / h[at[0]]) ** 2).sum(1)
            if len(sums) > KDE_HELD:
                yield out()
                sums.clear()
        if sums:
            yield out()

    parts = rows.mapInArrow(kernels, T.StructType([*kept, T.StructField("sums", T.ArrayType(T.DoubleType()))]))
    summed = parts.select(*keys, F.posexplode("sums").alias("g", "s")).groupBy(*keys, "g").agg(F.sum("s").alias("s"))
    out = attach(summed, st, keys)
    dens = F.col("s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    out = out.select(*keys, "g", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / F.lit(points - 1.0)).alias("gx"), dens.alias("density"))
    none = F.lit(None)
    return out.unionByName(st.where("h is null").select(*keys, none.cast("int").alias("g"), none.cast("double").alias("gx"), none.cast("double").alias("density")))


@reserved_keys
def residual_histogram(resid: DataFrame, keys: Sequence[str], e: str = "resid") -> DataFrame:
    """Histogram per series with an automatic number of even bins from min to
    max: the smaller of the Sturges width, range / (log2(n) + 1), and the
    Freedman-Diaconis width, 2 * IQR / n^(1/3) (left out if the IQR is 0), from
    exact quartiles. The last bin is closed; empty bins have a row. Residuals
    without spread make one bin of width 1 around them; a series without
    residuals keeps a row of nulls."""
    keys = list(keys)
    rows = resid.select(*keys, F.col(e).cast("double").alias("e"))
    st = attach(rows.groupBy(*keys).agg(F.count("e").alias("n"), F.min("e").alias("lo"), F.max("e").alias("hi")),
                exact_quantiles(rows.where(F.col("e").isNotNull()), "e", {"q1": 0.25, "q3": 0.75}, keys), keys, "left")
    span, n = F.col("hi") - F.col("lo"), F.col("n").cast("double")
    sturges = span / (F.log2(n) + 1)
    fd = 2 * (F.col("q3") - F.col("q1")) / F.pow(n, 1 / 3)
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    st = st.withColumn("bins", F.when(span > 0, F.ceil(span / width).cast("int")).when(span == 0, F.lit(1)))
    st = st.withColumn("from", F.when(span > 0, F.col("lo")).otherwise(F.col("lo") - 0.5)).withColumn("wide", F.when(span > 0, span / F.col("bins")).otherwise(F.lit(1.0)))
    st = materialize(st.select(*keys, "bins", "from", "wide"), "bin-stats")
    rows = attach_checked(rows.where(F.col("e").isNotNull()), st, keys, "bin-stats")
    place = F.least(F.floor((F.col("e") - F.col("from")) / F.col("wide")).cast("int") + 1, F.col("bins"))
    counts = rows.groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = st.select(*keys, "from", "wide", F.explode_outer(F.when(F.col("bins") > 0, F.sequence(F.lit(1), F.col("bins")))).alias("bin"))
    out = attach(every, counts, [*keys, "bin"], "left")
    low = F.col("from") + F.col("wide") * (F.col("bin") - 1)
    return out.select(*keys, "bin", F.when(F.col("bin").isNotNull(), low).alias("bin_lo"), F.when(F.col("bin").isNotNull(), low + F.col("wide")).alias("bin_hi"),
                      F.when(F.col("bin").isNotNull(), F.coalesce("count", F.lit(0))).alias("count"))


@reserved_keys
def pred_vs_actual(pred: DataFrame, keys: Sequence[str], y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Pairs plus identity-line limits (min and max over both) per series."""
    keys = list(keys)
    pairs = pred.select(*keys, "x", F.col(y).alias("actual"), F.col(y_hat).alias("predicted"), (F.col(y) - F.col(y_hat)).alias("resid"))
    limits = pairs.groupBy(*keys).agg(F.least(F.min("actual"), F.min("predicted")).alias("lim_lo"),
                                      F.greatest(F.max("actual"), F.max("predicted")).alias("lim_hi"))
    return attach_checked(pairs, limits, keys, "pair-limits")
