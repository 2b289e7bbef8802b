"""Hand-made frames: nulls, NaN, bad numbers, traps, ties, tiny series."""

import math

import pytest
from pyspark.sql import functions as F

from furrow.functions.columns import extract_number, to_double
from furrow.operators import clean as C
from furrow.operators import profile as PR
from furrow.operators import series as S
from furrow.operators import trend as TR
from furrow.operators.quantiles import exact_quantiles


def test_number_coercion_and_extraction(spark):
    vals = ["abc", " 12.5 ", "1,065", "['1970']", "", None, "12.5d", "-3e2", "NaN", "7"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [(r.s, r.d, r.x) for r in df.select("s", to_double("s").alias("d"), extract_number("s").alias("x")).collect()]
    d = {s: (a, b) for s, a, b in got}
    assert d["abc"] == (None, None)
    assert d[" 12.5 "] == (12.5, 12.5)
    assert d["1,065"] == (None, 1.0)          # thousands separators are not parsed
    assert d["['1970']"] == (None, 1970.0)    # list-like text: first number
    assert d[""] == (None, None)
    assert d[None] == (None, None)
    assert d["12.5d"] == (None, 12.5)         # JVM-only spelling is not a plain number
    assert d["-3e2"] == (-300.0, -300.0)
    assert d["NaN"][0] is None
    assert d["7"] == (7.0, 7.0)


def test_coerce_numeric_drops_nan_and_bad(spark):
    df = spark.createDataFrame([("2015", "1.5"), ("x", "2"), ("2016", "n/a"), ("2017.0", "3")], "YEAR string, VALUE string")
    out = C.drop_null_keys(C.coerce_numeric(df)).orderBy("YEAR").collect()
    assert [(r.YEAR, r.VALUE) for r in out] == [(2015, 1.5), (2017, 3.0)]
    nan = spark.createDataFrame([(1, float("nan")), (2, 4.0)], "YEAR int, VALUE double")
    out = C.drop_null_keys(C.coerce_numeric(nan)).collect()
    assert [(r.YEAR, r.VALUE) for r in out] == [(2, 4.0)]


def test_flags_exact_vs_regex_trap(spark):
    df = spark.createDataFrame([(" u.s. total ", "All Classes"), ("LOUISIANA", "LONG GRAIN"), (None, None),
                                ("ARKANSAS", "SMALL")], "LOCATION_DESCRIPTION string, CLASS_DESCRIPTION string")
    ex = C.add_series_flags(df, "exact").collect()
    rx = C.add_series_flags(df, "regex").collect()
    assert [(r.is_us_total, r.is_all_classes) for r in ex] == [(True, True), (False, False), (False, False), (False, False)]
    # regex mode: '.' is a wildcard (LOUISIANA matches U.S) and 'ALL' matches SMALL
    assert [(r.is_us_total, r.is_all_classes) for r in rx] == [(True, True), (True, False), (False, False), (False, True)]


def test_total_series_fallback(spark):
    rows = [("U.S. TOTAL", "ALL CLASSES", 2000, 1.0, False, False), ("X", "Y", 2000, 5.0, False, False)]
    df = spark.createDataFrame(rows, "LOCATION_DESCRIPTION string, CLASS_DESCRIPTION string, YEAR int, VALUE double, "
                                     "is_us_total boolean, is_all_classes boolean")
    out = S.total_series(df, ["YEAR"], ["VALUE"]).collect()
    assert [(r.YEAR, r.VALUE) for r in out] == [(2000, 1.0)]
    empty = spark.createDataFrame([("X", "Y", 2000, 5.0, False, False)], df.schema)
    assert S.total_series(empty, ["YEAR"], ["VALUE"]).count() == 0


def test_one_hot_null_and_factorize(spark):
    df = spark.createDataFrame([("B", "LA", 2001), (None, "AR", 2000), ("A", "LA", 1999), ("A", "TX", 2000)],
                               "CLASS_DESCRIPTION string, LOCATION_DESCRIPTION string, YEAR int")
    oh = C.one_hot(df).collect()
    assert [c for c in oh[0].asDict() if c.startswith("CLASS_")] == ["CLASS_DESCRIPTION", "CLASS_A", "CLASS_B"]
    assert [(r.CLASS_A, r.CLASS_B) for r in oh] == [(False, True), (False, False), (True, False), (True, False)]
    codes = {r.LOCATION_DESCRIPTION: r.LOCATION_CODE for r in C.factorize(df).collect()}
    assert codes == {"LA": 0, "AR": 1, "TX": 2}


def test_winsorize_keeps_null_and_constant_values(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)] + [(None,)], "VALUE double")
    out = C.winsorize(df, "VALUE").collect()
    clipped = sorted(r.VALUE_clipped for r in out if r.VALUE_clipped is not None)
    assert sum(1 for r in out if r.VALUE is None and r.VALUE_clipped is None) == 1
    assert clipped[0] == pytest.approx(1.99) and clipped[-1] == pytest.approx(99.01)
    const = spark.createDataFrame([(5.0,)] * 4, "VALUE double")
    z = C.zscore(const, "VALUE").collect()
    assert all(r.value_zscore is None and r.is_outlier_z is False for r in z)
    sc = C.standard_scale(const, ["VALUE"]).collect()
    assert all(r.VALUE_scaled == 0.0 for r in sc)


def test_exact_quantiles_hot_group_matches_percentile(spark):
    # one key holds most rows, with many distinct values and heavy ties
    rows = [("hot", float(i % 997) + (0.5 if i % 3 else 0.0)) for i in range(20000)] + \
           [("cold", float(i)) for i in range(7)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = {"p01": 0.01, "q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99}
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"]).collect()}
    ref = df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()
    for r in ref:
        for n in probs:
            assert getattr(got[r.k], n) == pytest.approx(getattr(r, n), abs=1e-9)


def test_top_groups_ties_and_value_counts(spark):
    rows = [(f"L{i:02d}", float(10 if i < 14 else i)) for i in range(20)]
    df = spark.createDataFrame(rows, "LOCATION_DESCRIPTION string, VALUE double")
    top = PR.top_groups_by_median(df, "VALUE", "LOCATION_DESCRIPTION", 12).orderBy("rank").collect()
    assert [r.LOCATION_DESCRIPTION for r in top][:6] == ["L19", "L18", "L17", "L16", "L15", "L14"]
    assert [r.LOCATION_DESCRIPTION for r in top][6:] == ["L00", "L01", "L02", "L03", "L04", "L05"]
    vc = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (None,)], "s string")
    out = [(r.value, r["count"], r.rank) for r in PR.value_counts_top(vc, ["s"], 2).orderBy("rank").collect()]
    assert out == [(None, 2, 1), ("b", 2, 2)]


def test_tiny_series_are_safe(spark):
    rows = [("A", "X", 1, 5.0), ("B", "X", 1, 1.0), ("B", "X", 2, 3.0), ("C", "X", 1, 2.0), ("C", "X", 2, 2.0),
            ("C", "X", 3, 2.0)]
    pts = spark.createDataFrame(rows, "LOCATION_DESCRIPTION string, CLASS_DESCRIPTION string, x int, y double")
    K = ["LOCATION_DESCRIPTION", "CLASS_DESCRIPTION"]
    fit = {r.LOCATION_DESCRIPTION: r for r in TR.ols_inference(TR.ols_fit(pts, K)).collect()}
    assert fit["A"].slope is None                       # one point: no slope
    assert fit["B"].slope == pytest.approx(2.0) and fit["B"].se_slope is None   # two points: no residual df
    assert fit["C"].slope == 0.0 and fit["C"].r2 is None   # constant series
    split = {(r.LOCATION_DESCRIPTION, r.x): r.is_test for r in S.temporal_split(pts, K).collect()}
    assert split[("A", 1)] is True and split[("C", 3)] is True and split[("C", 2)] is False


def test_duplicates_and_dropped_rows(spark):
    from furrow.operators import compare as CMP
    raw = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None), ("c", "x")], "k string, VALUE string")
    clean = C.drop_null_keys(C.coerce_numeric(raw, "k", "VALUE").withColumn("k", F.col("k")), ["VALUE"]) \
        if False else spark.createDataFrame([("a", 1.0)], "k string, VALUE double")
    assert CMP.duplicate_count(raw).first().duplicates == 1
    dropped = sorted((r.k, r.VALUE) for r in CMP.dropped_rows(raw, clean).collect())
    assert dropped == [("b", None), ("c", "x")]


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]] + [(None,), (math.nan,)], "v double")
    h = PR.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 1, 0, 1]      # max lands in the last (closed) bin
    one = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    h1 = PR.histogram(one, "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in h1] == [2, 0, 0, 0]


def test_exact_quantiles_with_far_outlier(spark):
    # one extreme value stretches the range: the second level re-splits the
    # first bucket, and results still equal percentile
    rows = [("g", float(i % 500) / 7.0) for i in range(5000)] + [("g", 1e12), ("h", -1e9), ("h", 1.0), ("h", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.001, "b": 0.3, "c": 0.5, "d": 0.999}
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"]).collect()}
    ref = df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()
    for r in ref:
        for n in probs:
            assert getattr(got[r.k], n) == pytest.approx(getattr(r, n), rel=1e-12, abs=1e-9)
    single = exact_quantiles(df.where("k = 'h'"), "v", {"m": 0.5}).first()
    assert single.m == 1.0


def test_clean_observations_per_key_matches_pandas(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    rows = []
    for loc, scale in [("AR", 1.0), ("LA", 3.0), ("TX", 0.5)]:
        for i in range(60):
            v = float(np.round(5000 + scale * 400 * rng.standard_normal(), 1))
            rows.append(("T", 1, "C", "LONG GRAIN" if i % 2 else "ALL CLASSES", str(1990 + i % 30), "Y", loc,
                         "YIELD", str(v), "POUNDS PER ACRE"))
    rows.append(("T", 1, "C", "LONG GRAIN", "2001", "Y", "TX", "YIELD", "99999", "POUNDS PER ACRE"))
    from furrow.sources.tables import RAW_SCHEMA
    df = spark.createDataFrame(rows, RAW_SCHEMA)
    out = C.clean_observations(df, keys=["LOCATION_DESCRIPTION"], class_values=["ALL CLASSES", "LONG GRAIN"],
                               write_rows=False).toPandas()
    pdf = pd.DataFrame(rows, columns=[f.name for f in RAW_SCHEMA.fields])
    pdf["YEAR"] = pdf["YEAR"].astype(int)
    pdf["VALUE"] = pdf["VALUE"].astype(float)
    for loc, g in pdf.groupby("LOCATION_DESCRIPTION"):
        o = out[out.LOCATION_DESCRIPTION == loc].sort_values(["YEAR", "VALUE"])
        g = g.sort_values(["YEAR", "VALUE"])
        v = g["VALUE"].to_numpy()
        q1, q3, p01, p99 = np.quantile(v, [0.25, 0.75, 0.01, 0.99])
        np.testing.assert_allclose(o["VALUE_scaled"], (v - v.mean()) / v.std(ddof=0), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(o["value_zscore"], (v - v.mean()) / v.std(ddof=1), rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(o["VALUE_clipped"], np.clip(v, p01, p99), rtol=1e-12)
        iqr = q3 - q1
        assert list(o["is_outlier_iqr"]) == list((v < q1 - 1.5 * iqr) | (v > q3 + 1.5 * iqr))
    assert bool(out[out.VALUE == 99999.0]["is_outlier_iqr"].iloc[0])


def test_location_and_value_candidates(spark):
    df = spark.createDataFrame([("A", "x", "1.5"), ("B", "y", "n/a"), (None, "z", "nan")], "State string, LOCATION_NAME string, Value string")
    assert [tuple(r) for r in C.location_and_value(df).collect()] == [("A", 1.5), ("B", None), (None, None)]
    with pytest.raises(ValueError):
        C.location_and_value(df.drop("Value"))


def test_preferred_value_by_row(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (None, None)], "VALUE double, VALUE_clipped double")
    assert [r.VALUE_used for r in C.preferred_value(df).collect()] == [2.0, 3.0, None]
    assert [r.VALUE_used for r in C.preferred_value(df.drop("VALUE_clipped")).collect()] == [1.0, 3.0, None]
