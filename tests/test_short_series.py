"""Series of 1 to 9 points, keys named as inner columns, and the moments and
histograms behind them against plain versions."""

import math
import random

import numpy as np
import pytest

from furrow.operators import diagnostics as D
from furrow.operators import ridge as RG
from furrow.operators import trend as TR
from furrow.operators.common import BROADCAST_BYTES, attach_checked
from furrow.operators import common

LENGTHS = (1, 2, 3, 6, 7, 8, 9, 30, 75)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = [(f"s{n}", 1900 + 2 * i, 3.0 * i + rng.gauss(0, 5)) for n in LENGTHS for i in range(n)] + [("flat", i, 4.0) for i in range(20)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, x int, y double")


def _series(points):
    out = {}
    for r in sorted(points.collect(), key=lambda r: r.x):
        out.setdefault(r[0], []).append((r.x, r.y))
    return {k: np.array(v) for k, v in out.items()}


def test_every_series_keeps_a_row(points):
    series = {"flat", *(f"s{n}" for n in LENGTHS)}
    keys = ["k"]
    best = RG.ridge_grid_best(RG.ridge_grid_cv(points, keys), keys)
    rows = {r[0]: r for r in best.collect()}
    assert set(rows) == series
    for n in LENGTHS:
        r = rows[f"s{n}"]
        assert (r.alpha is None) == (r.cv_mse is None) == (r.reason is not None) == (n - max(1, math.ceil(0.2 * n)) < 6)
    hold = RG.ridge_holdout_predictions(points, keys, best)
    got = TR.regression_metrics(hold, [*keys, "part"]).collect()
    assert {r[0] for r in got} == series and sum(r.n for r in got) == sum(LENGTHS) + 20
    curve = RG.learning_curve(points, keys, best).collect()
    assert {r[0] for r in curve} == series and [r["size"] for r in curve if r[0] == "s3"] == [None]
    assert {r[0] for r in RG.cv_folds(points, keys).collect()} == series
    test = hold.where("part = 'test'").selectExpr("k", "y - y_hat as resid")
    kde = D.residual_kde(test, keys).collect()
    assert {r[0] for r in kde} == series and all(r.density is None for r in kde if r[0] in ("s1", "s3", "s7"))


def test_keys_may_have_any_name(points):
    keys = ["b", "n", "lag", "fold", "g", "h", "lo", "cut", "first", "size", "e", "resid_"]
    long = points.where("k = 's30'").selectExpr(*[f"k as {c}" for c in keys], "x", "y")
    best = RG.ridge_grid_best(RG.ridge_grid_cv(long, keys), keys)
    resid = TR.fitted_values(long, TR.ols_fit(long, keys), keys)
    for made in (best, RG.learning_curve(long, keys, best), D.residual_acf(resid, keys), D.residual_qq(resid, keys), D.residual_kde(resid, keys),
                 D.residual_histogram(resid, keys), D.newey_west(long, keys), D.normality_tests(resid, keys)):
        assert made.columns[:len(keys)] == keys and list(made.first()[:len(keys)]) == ["s30"] * len(keys)
        assert len({c.lower() for c in made.columns}) == len(made.columns)


def test_running_moments_equal_plain_sums(points):
    series = _series(points)
    plan = RG.prefix_moments(points, ["k"])
    for r in plan.collect():
        for state, part in ((r.before, slice(0, int(r.before.n))), (r.upto, slice(0, r.cut)), (r.block, slice(r.cut - int(r.block.n), r.cut))):
            x, y = series[r.k][part].T
            if not len(x):
                assert state.n == 0
                continue
            u, v = x - x.mean(), y - y.mean()
            want = [len(x), x.mean(), y.mean(), (u**2).sum(), (u**3).sum(), (u**4).sum(), (u * v).sum(), (u * u * v).sum(), (v**2).sum()]
            assert list(state) == pytest.approx(want, rel=1e-8, abs=1e-5)


def test_squared_errors_from_moments(points):
    best = RG.ridge_grid_best(RG.ridge_grid_cv(points, ["k"]), ["k"])
    curve = {(r.k, r["size"]): r for r in RG.learning_curve(points, ["k"], best).collect()}
    for k, params in {r.k: r for r in best.collect() if r.alpha is not None}.items():
        pts = _series(points)[k]
        train = pts[:len(pts) - max(1, math.ceil(0.2 * len(pts)))]
        ts = len(train) // 6
        first = len(train) - 5 * ts
        for m in {min(max(int(f * first), 1), first) for f in np.linspace(0.1, 1, 10)}:
            x, y = train[:m].T
            mx, sx = x.mean(), x.std() or 1.0

            def row(x):
                z = (x - mx) / sx
                return np.stack([z, z * z][:params.degree], 1)

            a = row(x) - row(x).mean(0)
            w = np.linalg.solve(a.T @ a + params.alpha * np.eye(params.degree), a.T @ (y - y.mean()))

            def r2(part):
                e = part[:, 1] - (y.mean() + (row(part[:, 0]) - row(x).mean(0)) @ w)
                sst = ((part[:, 1] - part[:, 1].mean()) ** 2).sum()
                return None if len(part) < 2 else 1 - (e**2).sum() / sst if sst else float((e**2).sum() < 1e-20)

            got = curve[k, m]
            score = r2(train[:m])
            assert got.train_mean == (None if score is None else pytest.approx(score, rel=1e-6, abs=1e-6))
            scores = [s for f in range(5) if (s := r2(train[first + f * ts:first + (f + 1) * ts])) is not None]
            assert got.valid_mean == (pytest.approx(np.mean(scores), rel=1e-6) if scores else None)


def test_moments_take_no_window_over_the_rows_mean(points):
    plan = RG.prefix_moments(points, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "avg(" in plan and "windowspecdefinition" in plan and not [x for x in plan.split("\n") if "Window [" in x and "avg(" in x]


def test_kde_and_histogram_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=400), "b": rng.exponential(size=57), "c": np.r_[np.zeros(40), 1.0], "d": np.array([2.0]), "e": np.full(5, 3.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("z", None)], "k string, resid double")
    hist = {}
    for r in D.residual_histogram(df, ["k"]).collect():
        hist.setdefault(r.k, []).append((r.bin, r["count"], r.bin_lo, r.bin_hi))
    assert hist.pop("z") == [(None, None, None, None)]
    for k, vs in data.items():
        bins = np.histogram_bin_edges(vs, "sturges" if k == "c" else "auto")  # without an IQR numpy's versions differ
        want, edges = np.histogram(vs, bins=bins)
        got = sorted(hist[k])
        assert [c for _, c, _, _ in got] == want.tolist(), k
        assert [g[2] for g in got] + [got[-1][3]] == pytest.approx(edges.tolist())
    kde = {}
    for r in D.residual_kde(df, ["k"]).collect():
        kde.setdefault(r.k, []).append((r.g, r.gx, r.density))
    assert kde["d"] == kde["e"] == kde["z"] == [(None, None, None)]
    for k in "abc":
        vs = data[k]
        h = len(vs) ** -0.2 * vs.std(ddof=1)
        for g, gx, d in kde[k]:
            assert gx == pytest.approx(vs.min() + (vs.max() - vs.min()) * g / 199)
            assert d == pytest.approx(np.exp(-0.5 * ((gx - vs) / h) ** 2).sum() / (len(vs) * h * math.sqrt(2 * math.pi)))
        assert len(kde[k]) == 200


def test_statistics_are_broadcast_or_salted(spark, monkeypatch):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)] * 900, "k string, v int")
    stats = df.groupBy("k").agg({"v": "max"}).withColumnRenamed("max(v)", "top")
    small = attach_checked(df, stats, ["k"])
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    large = attach_checked(df, stats, ["k"])
    assert "__salt" in large._jdf.queryExecution().analyzed().toString()
    a, b = (sorted(map(tuple, d.select("v", "k", "top").collect()), key=str) for d in (small, large))
    assert a == b and len(a) == 3900 and large.columns == ["k", "v", "top"] and BROADCAST_BYTES > 0
