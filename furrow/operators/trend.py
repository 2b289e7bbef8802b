"""Per-series OLS trend, its inference table, metrics and baselines.

Every series is fitted in one grouped pass over centred moments, which
Spark merges pairwise (no cancellation from raw x^2 sums): partial sums leave
the tasks, never the points, so one long series or no key at all is no
hot task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.common import attach, reserved_keys


@reserved_keys
def ols_fit(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    keys = list(keys)
    p = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
              .where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    n = F.count(F.lit(1))
    g = p.groupBy(*keys).agg(
        n.alias("n"), F.avg("_x").alias("x_mean"), F.avg("_y").alias("y_mean"),
        (F.var_pop("_x") * n).alias("sxx"), (F.covar_pop("_x", "_y") * n).alias("sxy"), (F.var_pop("_y") * n).alias("syy"))
    slope = F.col("sxy") / F.when(F.col("sxx") != 0, F.col("sxx"))
    g = g.withColumn("slope", slope).withColumn("intercept", F.col("y_mean") - F.col("slope") * F.col("x_mean"))
    g = g.withColumn("ssr", F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)))
    return g.withColumn("r2", F.when(F.col("syy") != 0, F.lit(1.0) - F.try_divide(F.col("ssr"), F.col("syy"))))


@reserved_keys
def fitted_values(points: DataFrame, fit: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    j = attach(points, fit.select(*keys, "slope", "intercept", "x_mean"), keys)
    j = j.withColumn("y_hat", F.col("intercept") + F.col("slope") * F.col(x).cast("double"))
    return j.withColumn("resid", F.col(y) - F.col("y_hat"))


def ols_inference(fit: DataFrame) -> DataFrame:
    """statsmodels-style summary numbers from the per-series sums. Undefined
    quantities (too few points, zero spread) are null, never an error."""
    dv = F.try_divide
    n, sxx, xm = F.col("n").cast("double"), F.col("sxx"), F.col("x_mean")
    dfr = n - 2
    s2 = F.when(dfr > 0, dv(F.col("ssr"), dfr))
    out = fit.withColumns({"df_resid": (F.col("n") - 2).cast("int"), "s2": s2})
    out = out.withColumns({
        "se_slope": F.sqrt(dv(F.col("s2"), sxx)),
        "se_intercept": F.sqrt(F.col("s2") * (dv(F.lit(1.0), n) + dv(xm * xm, sxx))),
    })
    out = out.withColumns({
        "t_slope": dv(F.col("slope"), F.col("se_slope")),
        "t_intercept": dv(F.col("intercept"), F.col("se_intercept")),
        "adj_r2": F.lit(1.0) - dv((F.lit(1.0) - F.col("r2")) * (n - 1), dfr),
        "llf": -n / 2 * (F.lit(math.log(2 * math.pi)) + F.log(dv(F.col("ssr"), n)) + F.lit(1.0)),
    })
    # condition number of [1, x]: sqrt(lmax/lmin) of X'X, lmin = det/lmax
    sxx_raw = sxx + n * xm * xm
    tr = n + sxx_raw
    det = n * sxx
    lmax = (tr + F.sqrt(F.greatest(tr * tr - 4 * det, F.lit(0.0)))) / 2
    return out.withColumns({
        "f_stat": F.col("t_slope") * F.col("t_slope"),
        "aic": F.lit(-2.0) * F.col("llf") + F.lit(4.0),
        "bic": F.lit(-2.0) * F.col("llf") + F.lit(2.0) * F.log(n),
        "cond_no": F.sqrt(dv(lmax, dv(det, lmax))),
    })


@reserved_keys
def regression_metrics(pred: DataFrame, keys: Sequence[str], y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """n, RMSE, MAE and R^2 = 1 - SSE/SST (null when SST is 0; can be < 0)."""
    keys = list(keys)
    e = F.col(y) - F.col(y_hat)
    g = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"), (F.var_pop(y) * F.count(y)).alias("_sst"))
    return g.withColumn("r2", F.when(F.col("_sst") != 0, F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst")))) \
            .drop("_sse", "_sst")


@reserved_keys
def baseline_comparison(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Linear trend vs mean predictor on each whole series, long format."""
    keys = list(keys)
    fit = ols_fit(points, keys, x, y)
    fv = fitted_values(points, fit, keys, x, y)
    lr = regression_metrics(fv, keys, y, "y_hat").withColumn("model", F.lit("LinearRegression"))
    mb = attach(points, points.groupBy(*keys).agg(F.avg(y).alias("_mean")), keys)
    base = regression_metrics(mb, keys, y, "_mean").withColumn("model", F.lit("MeanBaseline"))
    cols = [*keys, "model", "n", "rmse", "mae", "r2"]
    return lr.select(*cols).unionByName(base.select(*cols))


# Display names of the comparison view (fixed values).
MODEL_NAMES = {
    "LinearRegression": "Linear Regression",
    "GradientBoosting": "Gradient Boosting",
    "RandomForest": "Random Forest",
    "MeanBaseline": "Mean baseline",
}


def model_comparison_view(comp: DataFrame, keys: Sequence[str] = (), wanted: Sequence[str] | None = None) -> DataFrame:
    """Filter models, map display names (unknown names kept), round to 3 with
    ties to the even digit."""
    if wanted is not None:
        comp = comp.where(F.col("model").isin(list(wanted)))
    rounded = lambda c, d: F.bround(F.col(c), d)
    m = F.create_map(*[F.lit(x) for kv in MODEL_NAMES.items() for x in kv])
    return comp.select(*keys, F.coalesce(m[F.col("model")], F.col("model")).alias("Model"),
                       rounded("rmse", 3).alias("RMSE"), rounded("mae", 3).alias("MAE"),
                       rounded("r2", 3).alias("R2"))
