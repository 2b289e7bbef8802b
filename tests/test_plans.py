"""Physical-plan properties that matter at scale."""

from furrow.operators.quantiles import exact_quantiles
from furrow.plans import QUERIES
from furrow.sources.adapters import obs_long

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scan_schemas(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines()
            if "FileScan parquet" in line]


def test_scans_are_pruned(spark):
    scans = _scan_schemas(QUERIES["histogram_30"](spark, SF))
    assert scans and all("l_orderkey" not in s and "l_tax" not in s for s in scans)
    long_scans = _scan_schemas(obs_long(spark, SF))
    assert all("l_returnflag" not in s and "l_orderkey" not in s for s in long_scans)


def test_grouping_sets_expand_after_first_aggregation(spark):
    lines = _plan(obs_long(spark, SF)).splitlines()
    # tree text lists parents first: the grouping-sets Expand sits above the
    # exchange of the first (line-item) aggregation
    gs = [i for i, line in enumerate(lines) if "Expand" in line and "spark_grouping_id" in line]
    ex = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(gs) == 1 and gs[0] < ex[-1]


def test_topk_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in _plan(QUERIES["value_counts_top20"](spark, SF))


def test_exact_quantiles_do_not_use_single_task_percentile(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    plan = _plan(exact_quantiles(li, "l_extendedprice", {"m": 0.5}, ["l_returnflag"]))
    assert "percentile" not in plan.lower()


def test_lag_windows_hold_one_block(spark):
    plan = _plan(QUERIES["residual_acf"](spark, SF))
    lags = [line for line in plan.splitlines() if "Window [" in line and "lag(" in line]
    # every lag window lists the block beside the keys, under their reserved names
    assert lags and all("], [__key_0#" in line and "__block#" in line.split("], [")[1] for line in lags), lags
