"""Spark queries vs. the independent DuckDB SQL at sf0.01 (subset; set
FURROW_FULL_ORACLE=1 for every query)."""

import os

import pytest

from oracle_check import compare, duck
from furrow.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
FAST = ["scan_obs_long", "filter_unit", "coerce_numeric", "series_flags_regex", "extract_number", "mean_by_period",
        "value_quantiles", "value_counts_top20", "duplicate_rows", "histogram_30", "box_stats", "iqr_outliers",
        "clean_observations", "cleaning_audit", "trend_fit", "ols_inference", "ridge_grid_best", "newey_west",
        "residual_acf", "normality_tests", "recent_20"]
NAMES = sorted(ORACLE_SQL) if os.environ.get("FURROW_FULL_ORACLE") else FAST


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE_SQL[name], SF)
    assert r["status"] == "OK", r
    assert "types" not in r, r


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE_SQL)
    assert rows_only == {"pooled_model_comparison"}
