"""Pooled models against least squares on the full matrix in numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators.gram import normal_equations, solve, spread
from furrow.operators.pooled import CATEGORICAL, NUMERIC, pooled_model_comparison, split_counts
from furrow.plans.queries import _pooled

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pivoted(spark):
    p = _pooled(spark, SF)
    hole = F.when((F.col("MONTH") == 3) & (F.col("YEAR") == 1996), None)
    return p.withColumn("PRODUCTION", F.when((F.col("MONTH") != 3) | (F.col("YEAR") != 1996), F.col("PRODUCTION")).otherwise(hole)).cache()


def _is_train(r):
    text = "|".join(str(r[c]) for c in [*CATEGORICAL, "YEAR", "MONTH"])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 100 < 80


def test_linear_models_equal_those_of_the_full_matrix(pivoted):
    rows = [r.asDict() for r in pivoted.collect()]
    full = [r for r in rows if all(v is not None for v in r.values())]
    train, test = [r for r in full if _is_train(r)], [r for r in full if not _is_train(r)]
    x = lambda rs: np.array([[float(r[c]) for c in NUMERIC] for r in rs])
    y = lambda rs: np.array([r["YIELD"] for r in rs])
    values = [(c, v) for c in CATEGORICAL for v in sorted({r[c] for r in train})]
    shown = lambda rs: np.array([[float(r[c] == v) for c, v in values] for r in rs])
    m, s = x(train).mean(0), x(train).std(0)
    a, b = (np.column_stack([(x(rs) - m) / s, shown(rs)]) for rs in (train, test))
    sd = y(train).std()  # the label is scaled too, which changes no prediction
    centred, t = a - a.mean(0), (y(train) - y(train).mean()) / sd
    want = {}
    for name, w in (("LinearRegression", np.linalg.lstsq(centred, t, rcond=1e-10)[0]),
                    ("Ridge_alpha1", np.linalg.solve(centred.T @ centred + np.eye(a.shape[1]), centred.T @ t))):
        e = y(test) - ((b - a.mean(0)) @ w * sd + y(train).mean())
        want[name] = np.sqrt(np.mean(e * e)), np.mean(np.abs(e)), 1 - (e @ e) / np.sum((y(test) - y(test).mean()) ** 2)
    got = {r.model: r for r in pooled_model_comparison(pivoted).collect()}
    assert set(got) == {*want, "GradientBoosting", "RandomForest"}
    for r in got.values():
        assert (r.n_train, r.n_test, r.n_incomplete) == (len(train), len(test), len(rows) - len(full)) and r.n_incomplete > 0
    for name, (rmse, mae, r2) in want.items():
        assert (got[name].rmse, got[name].mae, got[name].r2) == pytest.approx((rmse, mae, r2), rel=1e-7)
    counts = split_counts(pivoted).agg(F.sum("n_train"), F.sum("n_test"), F.sum("n_incomplete")).first()
    assert tuple(counts) == (len(train), len(test), len(rows) - len(full))


def test_trees_do_not_depend_on_the_order_of_rows(pivoted):
    one, two = ({r.model: r for r in pooled_model_comparison(d).collect()} for d in (pivoted.orderBy(F.rand(1)), pivoted.repartition(3)))
    assert one.keys() == two.keys()
    for model, r in one.items():
        assert tuple(r)[1:] == pytest.approx(tuple(two[model])[1:], rel=1e-9)


def test_equations_of_odd_tables(spark):
    rows = spark.createDataFrame([("u", 1.0, 5.0, 2.0), ("u", 2.0, 5.0, 4.0), ("v=1", 3.0, 5.0, 7.0)], "c string, x double, k double, y double")
    by = spread(rows, ["x", "k", "y"])
    assert by["k"] == (5.0, 1.0)  # no spread: left as it is
    cells = {(r.a, r.b): r.value for r in normal_equations(rows, ["x", "k", "y"], ["c"], by).collect()}
    assert cells["1", "1"] == 3 and cells["1", "c=u"] == 2 and cells["c=u", "c=u"] == 2 and cells["k", "c=u"] == 0 and ("c=u", "c=v=1") not in cells
    assert cells["x", "x"] == pytest.approx(3) and cells["1", "x"] == pytest.approx(0, abs=1e-12)
    none = rows.limit(0)
    assert solve(normal_equations(none, ["x", "k", "y"], ["c"], spread(none, ["x", "k", "y"])), "y", {"m": 0.0}) == {"m": {}}
