"""Ridge trend models per series: grid search over time-ordered folds,
hold-out scoring and learning curves.

A pipeline "standardise x (population sd) -> polynomial degree d (no bias)
-> ridge(alpha) with unpenalised intercept" has a closed form from a few
centred moments of z = (x - mean)/sd and y, and so has its squared error over
any run of points. The points are read once, into the moments of a few blocks
per series; every fold, grid point, refit and learning-curve size is read from
their running sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.common import attach, reserved_keys
from furrow.operators.series import temporal_split, ts_cv_folds

# Fixed search grid of the reference (alpha outer, degree inner = tie order).
GRID_ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]
GRID_DEGREES = [1, 2]
N_SPLITS = 5
# Learning-curve fractions: numpy linspace(0.1, 1.0, 10) element by element.
LC_START, LC_STOP, LC_NUM = 0.1, 1.0, 10


def with_grid(df: DataFrame) -> DataFrame:
    """Each row once per grid point (alpha outer, degree inner): an explode
    of the literal 10-point grid, no join."""
    pts = [(a, d) for a in GRID_ALPHAS for d in GRID_DEGREES]
    grid = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(d).alias("degree"), F.lit(i).alias("grid_idx"))
                     for i, (a, d) in enumerate(pts)])
    return df.withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g")


#: Central moments of a run of points: count, means, sums of powers of
#: dx = x - mx (2 to 4), of dx dy and dx^2 dy, and of dy^2.
STATE = ("n", "mx", "my", "s2", "s3", "s4", "c1", "c2", "syy")
_STATE_TYPE = "struct<" + ",".join(f"{c}:double" for c in STATE) + ">"
#: Why a series has no folds.
TOO_SHORT = f"fewer than {N_SPLITS + 1} training points"


def _learning_sizes(first: Column) -> Column:
    """Sizes int(frac * first), at least 1, of the learning-curve fractions."""
    step = (LC_STOP - LC_START) / (LC_NUM - 1)
    fracs = [i * step + LC_START for i in range(LC_NUM - 1)] + [LC_STOP]
    return F.array(*[F.least(F.greatest((F.lit(f) * first).cast("int"), F.lit(1)), first) for f in fracs])


def _merge(a: Column, b: Column) -> Column:
    """Moments of two runs together, from those of each about its own means.
    All even sums add up without cancellation."""
    n = a["n"] + b["n"]
    mx = a["mx"] + (b["mx"] - a["mx"]) * b["n"] / n
    my = a["my"] + (b["my"] - a["my"]) * b["n"] / n

    def about(s):
        """The sums of a run about the common means."""
        d, e, m = s["mx"] - mx, s["my"] - my, s["n"]
        return (s["s2"] + m * d * d, s["s3"] + 3 * d * s["s2"] + m * d * d * d,
                s["s4"] + 4 * d * s["s3"] + 6 * d * d * s["s2"] + m * d * d * d * d,
                s["c1"] + m * d * e, s["c2"] + 2 * d * s["c1"] + e * s["s2"] + m * d * d * e, s["syy"] + m * e * e)

    sums = [p + q for p, q in zip(about(a), about(b))]
    both = F.struct(*[c.alias(k) for c, k in zip((n, mx, my, *sums), STATE)])
    return F.when(a["n"] == 0, b).otherwise(both)


@reserved_keys
def prefix_moments(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Running moments of every series at the positions that folds, learning
    curve, refit and hold-out need (at most 17 a series).

    A series is cut at these positions into blocks, whose moments are
    mergeable aggregates of the points; per series the blocks' moments are
    merged one after the other. One row per block: ``cut`` (its end), ``fold``
    (the fold whose test block it is), ``block`` (its moments), ``before`` and
    ``upto`` (those of all points before it, and through it), ``tests`` (the
    moments of all folds' test blocks), n, n_train, ``first`` (points before
    the first test block, 0 if the series is too short for folds).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    split = temporal_split(points.select(*keys, F.col(x).alias("x"), F.col(y).cast("double").alias("y")), keys)
    size = (F.col("n_train") / F.lit(N_SPLITS + 1)).cast("int")
    first = F.when(size > 0, F.col("n_train") - N_SPLITS * size).otherwise(F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.lit(N_SPLITS)), lambda i: F.col("first") + i * F.col("size"))
    cuts = F.when(F.col("size") > 0, F.concat(_learning_sizes(F.col("first")), starts, F.array("n"))).otherwise(F.array("n_train", "n"))
    # x counts from the series' start: sums of its powers stay small
    rows = split.withColumn("size", size).withColumn("first", first).withColumn("x0", F.min(F.col("x").cast("double")).over(w))
    rows = rows.withColumn("cut", F.array_min(F.filter(cuts, lambda c: c > F.col("rn"))))
    u, v = F.col("x").cast("double") - F.col("x0"), F.col("y")
    n = F.count(F.lit(1)).cast("double")
    blocks = rows.groupBy(*keys, "n", "n_train", "size", "first", "x0", "cut").agg(
        n.alias("m"), F.avg(u).alias("mu"), F.avg(v).alias("my"), (F.var_pop(u) * n).alias("s2"), F.skewness(u).alias("skew"),
        F.kurtosis(u).alias("kurt"), (F.covar_pop(u, v) * n).alias("c1"), (F.covar_pop(u * u, v) * n).alias("q"), (F.var_pop(v) * n).alias("syy"))
    s2, m = F.col("s2"), F.col("m")
    state = F.struct(m.alias("n"), (F.col("x0") + F.col("mu")).alias("mx"), "my", "s2",
                     F.coalesce(F.col("skew") * F.pow(s2, 1.5) / F.sqrt(m), F.lit(0.0)).alias("s3"),
                     F.coalesce((F.col("kurt") + 3) * s2 * s2 / m, F.lit(0.0)).alias("s4"), "c1",
                     (F.col("q") - 2 * F.col("mu") * F.col("c1")).alias("c2"), "syy")
    series = blocks.groupBy(*keys, "n", "n_train", "size", "first").agg(F.array_sort(F.collect_list(F.struct("cut", state.alias("block")))).alias("blocks"))
    none = F.struct(*[F.lit(0.0).alias(c) for c in STATE]).cast(_STATE_TYPE)
    running = F.aggregate("blocks", F.array(none), lambda acc, b: F.concat(acc, F.array(_merge(F.element_at(acc, -1), b["block"]))))
    is_test = lambda b: (F.col("size") > 0) & (b["cut"] > F.col("first")) & (b["cut"] <= F.col("n_train"))
    tests = F.transform(F.filter("blocks", is_test), lambda b: b["block"])
    out = series.withColumn("running", running).withColumn("tests", tests)
    out = out.select(*keys, "n", "n_train", "size", "first", "tests", "running", F.posexplode("blocks").alias("pos", "b"))
    fold = F.when(is_test(F.col("b")), ((F.col("b.cut") - F.col("first")) / F.col("size")).cast("int") - 1)
    return out.select(*keys, "n", "n_train", "first", F.col("b.cut").alias("cut"), fold.alias("fold"), F.col("b.block").alias("block"),
                      F.get("running", F.col("pos")).alias("before"), F.get("running", F.col("pos") + 1).alias("upto"), "tests")


def ridge_moments(state: Column) -> dict[str, Column]:
    """Scaler (mean, population sd; sd 0 -> 1) and moments of z = (x - mx) / sx
    and y, from the moments of a run of points. Null without points."""
    n = F.when(state["n"] > 0, state["n"])
    sd = F.sqrt(state["s2"] / n)
    sx = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    s2 = state["s2"] / (sx * sx)
    return {"n_fit": F.coalesce(n, F.lit(0.0)).cast("long"), "mx": F.when(n > 0, state["mx"]), "sx": sx, "my": F.when(n > 0, state["my"]), "mz": F.lit(0.0),
            "mz2": s2 / n, "saa": s2, "sab": state["s3"] / (sx * sx * sx), "sbb": state["s4"] / (sx * sx * sx * sx) - s2 * s2 / n,
            "szy": state["c1"] / sx, "sz2y": state["c2"] / (sx * sx)}


def squared_error(state: Column) -> Column:
    """Sum of squared errors of a fitted row (mx, sx, b0, w1, w2) over a run
    of points, from the run's moments alone."""
    sx, a = F.col("sx"), state["mx"] - F.col("mx")
    p1, p2 = F.col("w1") / sx + 2 * F.col("w2") * a / (sx * sx), F.col("w2") / (sx * sx)
    e = state["my"] - (F.col("b0") + F.col("w1") * a / sx + F.col("w2") * a * a / (sx * sx))
    sse = (state["n"] * e * e + state["syy"] + p1 * p1 * state["s2"] + p2 * p2 * state["s4"] - 2 * p1 * state["c1"] - 2 * p2 * state["c2"]
           + 2 * p1 * p2 * state["s3"] - 2 * e * p2 * state["s2"])
    # greatest skips nulls: without a model there is no error
    return F.when(sse.isNotNull(), F.greatest(sse, F.lit(0.0)))


def _r2(state: Column) -> Column:
    """R^2 over a run of points: undefined (null) below 2; of a constant y it
    is 1 for a perfect fit, else 0."""
    sse, sst = squared_error(state), state["syy"]
    flat = 1e-24 * state["n"] * (state["my"] * state["my"] + 1e-300)  # rounding of equal values
    return (F.when((state["n"] < 2) | sse.isNull(), F.lit(None).cast("double"))
            .when(sst <= flat, F.when(sse <= flat, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.lit(1.0) - sse / F.when(sst > flat, sst)))


def ridge_coefficients(moments: DataFrame) -> DataFrame:
    """Closed-form solve; expects ``alpha`` and ``degree`` columns."""
    a = F.col("alpha")
    saa, sbb, sab, say, sby = F.col("saa") + a, F.col("sbb") + a, F.col("sab"), F.col("szy"), F.col("sz2y")
    det = saa * sbb - sab * sab
    w1 = F.when(F.col("degree") == 1, say / saa).otherwise((sbb * say - sab * sby) / det)
    w2 = F.when(F.col("degree") == 1, F.lit(0.0)).otherwise((saa * sby - sab * say) / det)
    out = moments.withColumns({"w1": w1, "w2": w2})
    return out.withColumn("b0", F.col("my") - F.col("w1") * F.col("mz") - F.col("w2") * F.col("mz2"))


def ridge_predict(rows: DataFrame, coefs: DataFrame, on: Sequence[str], x: str = "x") -> DataFrame:
    cols = [*on, "alpha", "degree", "mx", "sx", "b0", "w1", "w2"]
    extra = [c for c in ("grid_idx",) if c in coefs.columns]
    j = attach(rows, coefs.select(*cols, *extra), on)
    z = (F.col(x).cast("double") - F.col("mx")) / F.col("sx")
    return j.withColumn("y_hat", F.col("b0") + F.col("w1") * z + F.col("w2") * z * z)


def cv_folds(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ts_cv_folds(temporal_split(points, keys), keys, N_SPLITS)


@reserved_keys
def ridge_grid_cv(points: DataFrame, keys: Sequence[str], moments: DataFrame | None = None) -> DataFrame:
    """Mean validation MSE over the folds for every grid point and series,
    read from the moments (:func:`prefix_moments`, computed if not given). A
    series too short for folds has null MSEs, no folds and a reason."""
    keys = list(keys)
    m = moments if moments is not None else prefix_moments(points, keys)
    m = m.where(F.col("fold").isNotNull() | ((F.col("first") == 0) & (F.col("cut") == F.col("n"))))
    fits = ridge_coefficients(with_grid(m.withColumns(ridge_moments(F.col("before")))))
    mse = F.when(F.col("fold").isNotNull(), squared_error(F.col("block")) / F.col("block.n"))
    out = fits.withColumn("mse", mse).groupBy(*keys, "first", "alpha", "degree", "grid_idx").agg(
        F.avg("mse").alias("cv_mse"), F.count("fold").alias("n_folds"))
    return out.select(*keys, "alpha", "degree", "grid_idx", "cv_mse", "n_folds", F.when(F.col("first") == 0, F.lit(TOO_SHORT)).alias("reason"))


@reserved_keys
def ridge_grid_best(cv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest mean MSE; ties go to the earliest grid point. All null for a
    series without folds, but for the reason."""
    best = cv.groupBy(*keys).agg(F.min_by(F.struct("alpha", "degree", "cv_mse", "reason"), F.struct("cv_mse", "grid_idx")).alias("best"))
    chosen = F.col("best.cv_mse").isNotNull()
    return best.select(*keys, F.when(chosen, F.col("best.alpha")).alias("alpha"), F.when(chosen, F.col("best.degree")).alias("degree"),
                       "best.cv_mse", "best.reason")


@reserved_keys
def ridge_fit(points: DataFrame, keys: Sequence[str], params: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Refit chosen (alpha, degree) per series on its training points. Without
    chosen parameters the coefficients are null."""
    keys = list(keys)
    m = moments if moments is not None else prefix_moments(points, keys)
    # the last block of a series is its test part
    m = m.where(F.col("cut") == F.col("n")).select(*keys, *[c.alias(k) for k, c in ridge_moments(F.col("before")).items()])
    return ridge_coefficients(attach(m, params.select(*keys, "alpha", "degree"), keys))


@reserved_keys
def ridge_holdout_predictions(points: DataFrame, keys: Sequence[str], params: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Every point with its part (train or test) and prediction, null in a
    series too short to choose parameters."""
    keys = list(keys)
    coefs = ridge_fit(points, keys, params, moments)
    pred = ridge_predict(temporal_split(points, keys), coefs, keys)
    return pred.withColumn("part", F.when(F.col("is_test"), F.lit("test")).otherwise(F.lit("train")))


@reserved_keys
def learning_curve(points: DataFrame, keys: Sequence[str], params: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Train / validation R^2 for growing prefixes of the first fold's size.

    Sizes are int(frac * n_first) (clipped to [1, n_first], distinct) for the
    10 fractions of linspace(0.1, 1, 10). The prefix is the first ``size``
    points for every fold, so each (series, size) model is fitted once and
    scored on every fold's test block; mean and population sd over folds.
    R^2 of a single point is undefined (null). All of it is read from the
    moments. A series too short for folds has one row of nulls with the reason.
    """
    keys = list(keys)
    m = moments if moments is not None else prefix_moments(points, keys)
    short = F.col("first") == 0
    m = m.where((F.col("cut") <= F.col("first")) | (short & (F.col("cut") == F.col("n"))))
    m = attach(m.withColumns(ridge_moments(F.col("upto"))), params.select(*keys, "alpha", "degree"), keys)
    fits = ridge_coefficients(m)
    scores = F.filter(F.transform("tests", _r2), lambda s: s.isNotNull())
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda t, s: t + f(s))
    fits = fits.withColumn("train_mean", F.when(~short, _r2(F.col("upto")))).withColumn("scores", scores)
    fits = fits.withColumn("valid_mean", F.when(F.size("scores") > 0, total("scores", lambda s: s) / F.size("scores")))
    spread = F.sqrt(total("scores", lambda s: (s - F.col("valid_mean")) * (s - F.col("valid_mean"))) / F.nullif(F.size("scores"), F.lit(0)))
    return fits.select(*keys, F.when(~short, F.col("cut").cast("long")).alias("size"), "train_mean",
                       F.when(F.col("train_mean").isNotNull(), F.lit(0.0)).alias("train_std"), "valid_mean", spread.alias("valid_std"),
                       F.when(short, F.lit(TOO_SHORT)).alias("reason"))
