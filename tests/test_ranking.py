"""Ranks over all tasks, sparse class codes, and the comparison's plan."""

import random

from pyspark.sql import functions as F

from furrow.operators import clean as C
from furrow.operators import compare as CMP
from furrow.operators.ranking import grouped_rank


def test_ranks_within_keys_and_over_a_table(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}", rng.choice([None, *range(500)]), i) for i in range(4000)] + [(None, 1, -1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = grouped_rank(df, ["v", "i"], ["k"]).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=key)
        assert {(r.v, r.i): r["rank"] for r in got if r.k == k} == {(r[1], r[2]): n for n, r in enumerate(mine)}
    assert {r.i: r["rank"] for r in grouped_rank(df, ["i"]).collect()} == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: r[2]))}
    assert grouped_rank(df.limit(0), ["i"]).count() == 0


def test_codes_of_very_many_classes(spark):
    df = spark.range(100_000).select(F.format_string("c%06d", "id").alias("CLASS_DESCRIPTION")).unionAll(spark.createDataFrame([(None,)], "CLASS_DESCRIPTION string"))
    rows, codes = C.class_codes(df)
    assert codes.count() == 100_000 and rows.count() == 100_001
    assert rows.where("CLASS_CODE <> cast(substring(CLASS_DESCRIPTION, 2) as int)").count() == 0
    assert rows.where("CLASS_DESCRIPTION is null and CLASS_CODE is null").count() == 1
    million = spark.range(1_000_000).selectExpr("concat('l', id) as LOCATION_DESCRIPTION", "cast(id as int) as YEAR")
    plan = C.factorize(million)
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString().replace("WindowGroup", "")
    assert plan.where("LOCATION_CODE <> YEAR").count() == 0


def test_comparison_counts_and_plan(spark):
    raw = spark.createDataFrame([("1990", "5", "A"), ("1990", "5.0", "A"), ("1990", "5", "A"), (None, "1", "B"), ("x", None, "B"), ("a", "b", None), ("a", None, "b")],
                                "YEAR string, VALUE string, K string")
    clean = spark.createDataFrame([(1990, 5.0, "A", True)] * 3, "YEAR int, VALUE double, K string, flag boolean")
    made = CMP.processing_compare(raw, clean)
    got = {r.metric: r.value for r in made.collect()}
    assert got == {"orig_rows": 7, "orig_cols": 3, "orig_missing_total": 4, "orig_duplicates": 1, "clean_rows": 3, "clean_cols": 4,
                   "clean_missing_total": 0, "clean_duplicates": 2, "rows_removed": 4, "dropped_rows_by_merge": 4}
    # digests alone are shuffled: no join, no column of the rows in an exchange
    plan = CMP.processing_compare(raw, clean)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert all(v == 0 for v in (r.value for r in CMP.processing_compare(raw.limit(0), clean.limit(0)).collect() if not r.metric.endswith("cols")))
