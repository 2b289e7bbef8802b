"""Lags over blocks with a halo, against plain lags in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import furrow.operators.lags as L
from furrow.operators.diagnostics import durbin_watson, newey_west, residual_acf
from furrow.operators.lags import with_lags


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    long = np.cumsum(rng.normal(size=5000)) + 0.01 * np.arange(5000)
    return {"long": long, "short": rng.normal(size=3), "one": np.array([2.0]), None: rng.normal(size=41)}


@pytest.fixture(scope="module")
def points(spark, series):
    rows = [(k, i, float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "block string, x int, y double").repartition(5)


def _resid(y):
    x = np.arange(len(y)) - (len(y) - 1) / 2
    return y - y.mean() - (x @ y) / (x @ x) * x, x


@pytest.mark.parametrize("block", [20, 37, 4096])
def test_lags_of_blocks_equal_those_of_the_series(points, series, block):
    got = {(r.block, r.x): r for r in with_lags(points, ["block"], ["x"], ["y"], 20, block).collect()}
    assert len(got) == sum(map(len, series.values()))
    for (k, i), r in got.items():
        assert [r[f"y_{l}"] for l in range(1, 21)] == [series[k][i - l] if i >= l else None for l in range(1, 21)]


def test_diagnostics_over_small_blocks(points, series, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 64)
    resid = points.withColumnRenamed("y", "resid")
    dw = {r.block: r.dw for r in durbin_watson(resid, ["block"]).collect()}
    acf = {(r.block, r.lag): r.acf for r in residual_acf(resid, ["block"]).collect()}
    hac = {r.block: r for r in newey_west(points, ["block"]).collect()}
    for k, y in series.items():
        if len(y) == 1:
            assert dw[k] is None and acf[k, 0] is None and hac[k].hac_se_slope is None
            continue
        assert dw[k] == pytest.approx(np.sum(np.diff(y) ** 2) / np.sum(y * y), rel=1e-9)
        c = y - y.mean()
        for l in range(21):
            assert acf[k, l] == pytest.approx((c[l:] @ c[:len(c) - l]) / (c @ c) if l < len(c) else 0.0, rel=1e-9, abs=1e-12)
        e, x = _resid(y)
        z = x * e
        s = z @ z + sum(2 * (1 - l / 5) * (z[l:] @ z[:-l]) for l in range(1, min(5, len(z))))
        assert hac[k].hac_se_slope == pytest.approx(np.sqrt(s) / (x @ x) if s > 0 else np.nan, rel=1e-6, nan_ok=True)


def test_one_long_series_is_spread_over_the_tasks(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = spark.range(400_000).select(F.lit("s").alias("k"), F.col("id").alias("x"), F.sin("id").alias("y"))
        rows = with_lags(one, ["k"], ["x"], ["y"], 20).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sum(r["count"] for r in rows) == 400_000
    assert len(rows) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in rows) < 100_000
