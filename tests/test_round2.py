"""Exact quantiles on heavy tails, coercions in comparisons, short series,
non-finite values, and category lists taken from the table."""

import math

import pytest
from pyspark.sql import functions as F

from furrow.operators import clean as C
from furrow.operators import compare as CMP
from furrow.operators import profile as PR
from furrow.operators.diagnostics import normality_tests
from furrow.operators.quantiles import exact_quantiles
from furrow.plans import QUERIES

PROBS = {"p01": 0.01, "q1": 0.25, "median": 0.5, "p99": 0.99, "top": 1.0}


@pytest.fixture(scope="module")
def tails(spark):
    inf = math.inf
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 0.5).alias("v"))
    odd = [("hot", x) for x in (inf, -inf, 1e300, 1e150, -1e18)] + [("two", 1.0), ("two", -inf), ("one", inf), (None, 3.0), (None, 4.0), ("none", None), ("nan", math.nan)]
    return hot.unionAll(spark.createDataFrame(odd, "k string, v double"))


def test_quantiles_equal_percentile_on_heavy_tails(tails):
    got = {r.k: [r[n] for n in PROBS] for r in exact_quantiles(tails, "v", PROBS, ["k"]).collect()}
    want = tails.where(~F.isnan("v")).groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS.values()])).alias("q")).where("q is not null")
    assert got == {r.k: r.q for r in want.collect()}
    assert exact_quantiles(tails.limit(0), "v", PROBS, ["k"]).count() == 0


def test_quantile_partitions_share_a_hot_group(spark, tails, monkeypatch):
    import furrow.operators.quantiles as Q
    seen = []
    monkeypatch.setattr(Q, "materialize", lambda df, name: seen.append(df) or df.cache())
    monkeypatch.setitem(Q.__dict__, "F", F)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        exact_quantiles(tails, "v", PROBS, ["k"]).collect()
        sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 2.5 * sum(sizes) / len(sizes)


def test_quantiles_read_their_table_a_few_times(spark, tails):
    plan = exact_quantiles(tails, "v", PROBS, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4


def test_dropped_rows_coerce_as_cleaning_does(spark):
    raw = spark.createDataFrame([("1995", "1"), ("1995.5", "2"), ("99999999999", "3"), ("1996", "x"), (None, "5")], "YEAR string, VALUE string")
    clean = C.drop_null_keys(C.coerce_numeric(raw))
    dropped = CMP.dropped_rows(raw, clean)
    assert sorted(r.VALUE for r in dropped.collect()) == ["2", "3", "5", "x"]
    assert raw.count() == clean.count() + dropped.count()


def test_normality_tests_keep_every_series(spark):
    rows = [(n, math.sin(7.0 * n + 3 * i)) for n in range(1, 13) for i in range(n)] + [(99, 1.0)] * 9
    got = {r.s: r for r in normality_tests(spark.createDataFrame(rows, "s int, resid double"), ["s"]).collect()}
    assert sorted(got) == [*range(1, 13), 99]
    assert all(got[n].omnibus is None for n in range(1, 8)) and all(got[n].omnibus is not None for n in range(8, 13))
    assert all(got[n].jarque_bera is not None for n in range(2, 13)) and got[99].skew is None


def test_histogram_leaves_non_finite_values_out(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, math.inf, -math.inf, math.nan, None)], "v double")
    rows = PR.histogram(df, "v", bins=4).collect()
    assert [r["count"] for r in sorted(rows, key=lambda r: r.bin)] == [1, 0, 1, 1] and max(r.bin_hi for r in rows) == 3.0


def test_one_hot_takes_its_values_from_the_table(spark):
    df = spark.range(300).selectExpr("concat('v', id) as CLASS_DESCRIPTION").unionAll(spark.createDataFrame([(None,)], "CLASS_DESCRIPTION string"))
    out = C.one_hot(df)
    assert len(out.columns) == 301
    with pytest.raises(ValueError):
        C.one_hot(df, max_values=256)


def test_p_values_keep_their_digits(spark):
    rows = QUERIES["ols_pvalues"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.p_slope is None or r.p_slope > 0 for r in rows)


def test_find_col_prefers_earlier_keywords():
    assert PR.find_col(["Total Area", "Acres"], ["acre", "area"]) == "Acres" and PR.find_col(["x"], ["y"]) is None


def test_dropped_rows_are_dealt_and_sorted_by_one_number(spark):
    raw = spark.createDataFrame([("a", None, "1"), (None, "a", "1"), ("a", "b", "1.0"), ("a", "b", "1.0"), ("a", "b", "-0.0"), ("a", "b", "x"), (None, None, None)], "k string, c string, VALUE string")
    clean = spark.createDataFrame([("a", None, 1.0), ("a", "b", 1.0), ("a", "b", 0.0), (None, None, None)], "k string, c string, VALUE double")
    dropped = CMP.dropped_rows(raw, clean)
    assert dropped.columns == raw.columns
    assert sorted(map(str, dropped.collect())) == sorted(map(str, [raw.collect()[1], raw.collect()[5]]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = CMP.dropped_rows(raw, clean)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(x for x in plan.splitlines() if "SortMergeJoin" in x)
    assert join.count("coalesce") == 0 and join.split("], [")[0].count("#") == 1


def test_cleaning_writes_its_rows_without_indicators(spark, monkeypatch):
    written = {}
    keep = C.materialize

    def note(df, name):
        written[name] = df.columns
        return keep(df, name)

    monkeypatch.setattr(C, "materialize", note)
    raw = spark.createDataFrame([(f"c{i}", "l", 1995 + i, str(i), "YIELD", "POUNDS") for i in range(4)],
                                "CLASS_DESCRIPTION string, LOCATION_DESCRIPTION string, YEAR int, VALUE string, STATISTIC_DESCRIPTION string, UNIT_DESCRIPTION string")
    out = C.clean_observations(raw)
    assert not [c for c in written["clean-rows"] if c.startswith("CLASS_c")]
    assert sorted((r.VALUE, r.CLASS_c0, r.CLASS_c3) for r in out.collect()) == [(0.0, True, False), (1.0, False, False), (2.0, False, False), (3.0, False, True)]
