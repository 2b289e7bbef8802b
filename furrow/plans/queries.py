"""Named queries over the driver tables: one per operator of the inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads whole tables;
outputs have doubles rounded to 6 places, or significant digits, so that
results can be compared value by value with an independent SQL formulation,
but for those that have none (``exact``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.columns import extract_number, nan_to_null, rounded, to_double
from furrow.operators import clean as C
from furrow.operators import compare as CMP
from furrow.operators import diagnostics as D
from furrow.operators import pooled as PO
from furrow.operators import profile as PR
from furrow.operators import ridge as RG
from furrow.operators import series as S
from furrow.operators import trend as TR
from furrow.operators.common import materialize
from furrow.session import ensure_checkpoint_dir
from furrow.sources.adapters import SERIES_KEYS, obs_long, obs_raw
from furrow.sources.sinks import load_coefficients, save_coefficients, write_table
from furrow.sources.csv_files import rejected_counts, scan_csv_checked
from furrow.sources.tables import fingerprint, read_table, scan_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K = SERIES_KEYS
PIVOT_STATS = ["YIELD", "AREA PLANTED", "AREA HARVESTED", "PRODUCTION"]


def significant(c) -> Column:
    """Six significant digits, for numbers of any magnitude."""
    return F.when(c.isNotNull(), F.format_string("%.5e", c).cast("double"))


def finalize(df: DataFrame, digits: int = 6, overrides: dict | None = None) -> DataFrame:
    """Round every double column (stable value comparison across engines);
    ``overrides`` gives coarser digits for large sums of squares, or
    ``significant`` for columns whose values may be tiny."""
    overrides = overrides or {}

    def value(name):
        d = overrides.get(name, digits)
        # "+ 0.0" turns a rounded -0.0 into 0.0 (noise of either sign around zero)
        return significant(F.col(name)) if d is significant else rounded(F.col(name), d) + F.lit(0.0)

    return df.select(*[value(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def query(name: str, digits: dict | None = None, exact: bool = False):
    """Register a query; ``exact`` leaves its numbers as they are."""
    def deco(fn):
        QUERIES[name] = fn if exact else lambda spark, sf_dir: finalize(fn(spark, sf_dir), overrides=digits)
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


P_DIGITS = {"p_slope": significant, "p_intercept": significant, "p_f": significant}


# ---- shared inputs ------------------------------------------------------------

_PREPARED: dict = {}
#: The tables that every derived input is built from.
_SOURCES = ("lineitem", "supplier", "nation", "part")


def _prepared_once(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The kept result of ``make``, made anew if a file of a source table was
    added, removed or rewritten since."""
    sf = sf.rstrip("/")
    key = (spark.sparkContext.applicationId, sf, name)
    files = tuple(fingerprint(spark, f"{sf}/{t}.parquet") for t in _SOURCES)
    df, of = _PREPARED.get(key, (None, None))
    if df is None or df.sparkSession is not spark or of != files:
        df = make()
        _PREPARED[key] = df, files
    return df


def prepared(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Derived input written once per Spark application, table folder and state
    of its files.

    The long table, the series points, the raw line table and the chosen
    ridge parameters are deterministic functions of the driver tables; like
    the cleaned file that later analysis stages read, they are prepared once
    and every query that needs them reads the written copy.
    """
    return _prepared_once(spark, sf, name, lambda: materialize(build(), name))


def clear_prepared() -> None:
    _PREPARED.clear()


def _raw(spark, sf):
    """Line-grain raw table for queries that pass over it several times
    (instead of repeating the four-table join per pass)."""
    return prepared(spark, sf, "obs-raw", lambda: obs_raw(spark, sf))


def _once(spark, sf):
    """The same rows straight from the tables, for queries that pass over
    them once: their filters and columns reach the scans."""
    return obs_raw(spark, sf)


def _clean(spark, sf):
    """The cleaned table (read by several report queries): its rows are written
    by the chain itself, with the filters before, and not a second time."""
    return _prepared_once(spark, sf, "clean", lambda: C.clean_observations(_once(spark, sf)))


def _long(spark, sf):
    """The long table for queries that read it several times."""
    return prepared(spark, sf, "obs-long", lambda: obs_long(spark, sf))


def _yield_rows(spark, sf):
    return C.winsorize(C.add_series_flags(C.filter_statistic(_long(spark, sf))), "VALUE")


def _points(spark, sf):
    return prepared(spark, sf, "series-points", lambda: S.series_points(_long(spark, sf), K))


def _best(spark, sf, pts=None):
    """Chosen (alpha, degree) per series (one row per series), so later fits
    read it instead of re-planning the grid search."""
    pts = pts if pts is not None else _points(spark, sf)
    return prepared(spark, sf, "ridge-best", lambda: RG.ridge_grid_best(RG.ridge_grid_cv(pts, K, _moments(spark, sf)), K))


def _moments(spark, sf):
    """Running moments of every series (at most 17 rows each)."""
    return prepared(spark, sf, "ridge-moments", lambda: RG.prefix_moments(_points(spark, sf), K))


def _holdout(spark, sf):
    pts = _points(spark, sf)
    return RG.ridge_holdout_predictions(pts, K, _best(spark, sf, pts), _moments(spark, sf))


def _events(spark, sf):
    return read_table(spark, sf, "events").select("event_id", "event_type", "value", "props")


# ---- scans, sinks, previews ------------------------------------------------------

@query("scan_obs_long")
def q_scan(spark, sf):
    """The monthly long statistics table built from the driver tables."""
    return _long(spark, sf)


@query("preview_rows")
def q_preview(spark, sf):
    return CMP.sample_rows(_once(spark, sf), 50)


@query("canonical_columns")
def q_canonical(spark, sf):
    o = read_table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("int").alias("Year"), F.col("o_orderpriority").alias("LOCATION"),
        F.col("o_orderstatus").alias("CLASS"), F.col("o_totalprice").alias("YIELD"))
    return C.canonical_columns(o)


# ---- filters and coercion --------------------------------------------------------

@query("filter_statistic")
def q_filter_statistic(spark, sf):
    return C.filter_statistic(_once(spark, sf))


@query("filter_unit")
def q_filter_unit(spark, sf):
    return C.filter_unit(C.filter_statistic(_once(spark, sf)))


@query("filter_statistic_regex")
def q_filter_regex(spark, sf):
    return C.filter_statistic_regex(_once(spark, sf))


@query("drop_null_keys")
def q_drop_null(spark, sf):
    return C.drop_null_keys(_once(spark, sf))


@query("coerce_numeric")
def q_coerce(spark, sf):
    return C.coerce_numeric(C.filter_statistic(_once(spark, sf)))


@query("series_flags")
def q_flags(spark, sf):
    d = C.add_series_flags(_long(spark, sf), "exact")
    return d.select("STATISTIC_DESCRIPTION", "YEAR", "MONTH", *K, "is_us_total", "is_all_classes")


@query("series_flags_regex")
def q_flags_regex(spark, sf):
    d = C.add_series_flags(_long(spark, sf), "regex")
    return d.select("STATISTIC_DESCRIPTION", "YEAR", "MONTH", *K, "is_us_total", "is_all_classes")


@query("finite_pairs")
def q_finite(spark, sf):
    e = read_table(spark, sf, "events").select(
        "user_id", "event_id",
        F.col("event_id").cast("double").alias("x"),
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
         .when((F.col("event_type") == "view") & (F.col("value") > 90), F.lit(float("inf")))
         .otherwise(F.col("value")).alias("y"))
    return C.finite_pairs(e, "x", "y", ["user_id"], 2)


@query("extract_number")
def q_extract(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", "props", extract_number("props").alias("number"))


# ---- aggregations ------------------------------------------------------------------

@query("mean_by_period")
def q_mean_by_period(spark, sf):
    o = read_table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("int").alias("YEAR"), F.month("o_orderdate").cast("int").alias("MONTH"),
        "o_totalprice")
    return S.mean_by_period(o, ["YEAR", "MONTH"], ["o_totalprice"], names=["mean_totalprice"])


@query("mean_raw_clipped_by_period")
def q_mean_raw_clipped(spark, sf):
    return S.mean_by_period(_yield_rows(spark, sf), ["YEAR", "MONTH"], ["VALUE", "VALUE_clipped"])


@query("all_rows_by_period")
def q_all_rows(spark, sf):
    return S.mean_by_period(_yield_rows(spark, sf), ["YEAR"], ["VALUE", "VALUE_clipped"])


@query("total_series")
def q_total_series(spark, sf):
    return S.total_series(_yield_rows(spark, sf), ["YEAR", "MONTH"])


@query("preferred_value_by_period")
def q_preferred(spark, sf):
    """Means of the preferred value; winsorised values are missing in January,
    as in files that lack them."""
    rows = _yield_rows(spark, sf).withColumn("VALUE_clipped", F.when(F.col("MONTH") != 1, F.col("VALUE_clipped")))
    return S.mean_by_period(C.preferred_value(rows), ["YEAR", "MONTH"], ["VALUE_used"])


@query("top_states_by_median")
def q_top_states(spark, sf):
    """The top locations of a table with other column names."""
    o = read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("STATE_NAME"), F.col("o_totalprice").cast("string").alias("Value"))
    return PR.top_groups_by_median(C.location_and_value(o), "VALUE", "LOCATION_DESCRIPTION", 3)


@query("median_by_location")
def q_median_loc(spark, sf):
    return PR.median_by_group(_long(spark, sf), "VALUE", "LOCATION_DESCRIPTION")


@query("top_locations_by_median")
def q_top_loc(spark, sf):
    return PR.top_groups_by_median(_long(spark, sf), "VALUE", "LOCATION_DESCRIPTION", 12)


@query("value_quantiles")
def q_quantiles(spark, sf):
    from furrow.operators.quantiles import exact_quantiles
    li = read_table(spark, sf, "lineitem")
    return exact_quantiles(li, "l_extendedprice", {"p01": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99})


@query("describe_numeric")
def q_describe_num(spark, sf):
    return PR.describe_numeric(_raw(spark, sf))


@query("describe_string")
def q_describe_str(spark, sf):
    return PR.describe_string(_once(spark, sf))


@query("table_profile")
def q_table_profile(spark, sf):
    return PR.table_profile(_once(spark, sf))


@query("value_counts_top20")
def q_value_counts(spark, sf):
    return PR.value_counts_top(_once(spark, sf), k=20)


@query("null_counts")
def q_null_counts(spark, sf):
    return PR.null_counts(C.filter_unit(C.filter_statistic(_once(spark, sf))))


@query("duplicate_rows")
def q_duplicates(spark, sf):
    return CMP.duplicate_count(_once(spark, sf))


@query("processing_compare")
def q_processing_compare(spark, sf):
    raw = _once(spark, sf)
    return CMP.processing_compare(raw, _clean(spark, sf))


@query("cleaning_audit")
def q_cleaning_audit(spark, sf):
    raw = _once(spark, sf)
    return CMP.cleaning_audit(raw, _clean(spark, sf))


@query("dropped_rows")
def q_dropped(spark, sf):
    raw = _once(spark, sf)
    return CMP.dropped_rows(raw, _clean(spark, sf))


@query("dropped_rows_sample")
def q_dropped_sample(spark, sf):
    raw = _once(spark, sf)
    return CMP.sample_rows(CMP.dropped_rows(raw, _clean(spark, sf)), 50)


@query("histogram_30")
def q_hist30(spark, sf):
    return PR.histogram(read_table(spark, sf, "lineitem"), "l_extendedprice", 30)


@query("histogram_all_columns")
def q_hist_all(spark, sf):
    d = read_table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return PR.histogram_all(d, 30).withColumnRenamed("column", "feature")


@query("histogram_before_after")
def q_hist_ba(spark, sf):
    raw = _raw(spark, sf)
    before = C.filter_statistic_regex(raw).select(
        F.lit("before").alias("stage"), nan_to_null(to_double("VALUE")).alias("v"))
    after = _clean(spark, sf).select(F.lit("after").alias("stage"), F.col("VALUE_clipped").alias("v"))
    return PR.histogram(before.unionByName(after), "v", 40, ["stage"])


@query("box_stats")
def q_box(spark, sf):
    return PR.box_stats(read_table(spark, sf, "lineitem"), "l_extendedprice")


@query("box_stats_all_columns")
def q_box_all(spark, sf):
    d = read_table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return PR.box_stats_all(d).withColumnRenamed("column", "feature")


@query("box_stats_top12")
def q_box_top12(spark, sf):
    ol = _long(spark, sf)
    rows = PR.rows_of_top_groups(ol, "VALUE", "LOCATION_DESCRIPTION", 12)
    return PR.box_stats(rows, "VALUE", ["LOCATION_DESCRIPTION"])


# ---- features and cleaning -----------------------------------------------------------

@query("one_hot_class")
def q_one_hot(spark, sf):
    d = C.one_hot(_raw(spark, sf), "CLASS_DESCRIPTION", "CLASS")
    return d.select("TABLE_NUMBER", "YEAR", "MONTH", "LOCATION_DESCRIPTION", "CLASS_DESCRIPTION",
                    *[c for c in d.columns if c.startswith("CLASS_") and c != "CLASS_DESCRIPTION"])


@query("class_codes")
def q_class_codes(spark, sf):
    """Sparse class indicators: rows per code of the dictionary."""
    rows, codes = C.class_codes(_once(spark, sf).select("CLASS_DESCRIPTION", "LOCATION_DESCRIPTION"))
    return rows.groupBy("CLASS_DESCRIPTION", "CLASS_CODE").agg(F.count(F.lit(1)).alias("rows"))


@query("factorize_location")
def q_factorize(spark, sf):
    d = C.factorize(_raw(spark, sf), "LOCATION_DESCRIPTION", "YEAR", "LOCATION_CODE")
    return d.groupBy("LOCATION_DESCRIPTION", "LOCATION_CODE").agg(F.count(F.lit(1)).alias("rows"))


@query("standard_scale")
def q_scale(spark, sf):
    d = C.standard_scale(C.filter_statistic(_long(spark, sf)), ["YEAR", "VALUE"])
    return d.select("YEAR", "MONTH", *K, "VALUE", "YEAR_scaled", "VALUE_scaled")


@query("iqr_outliers")
def q_iqr(spark, sf):
    return C.iqr_flag(_events(spark, sf).select("event_id", "value"), "value")


@query("zscore_outliers")
def q_z(spark, sf):
    return C.zscore(_events(spark, sf).select("event_id", "value"), "value")


@query("winsorize")
def q_winsor(spark, sf):
    return C.winsorize(_events(spark, sf).select("event_id", "value"), "value", out="value_clipped")


@query("winsorize_by_location")
def q_winsor_loc(spark, sf):
    d = C.filter_statistic(_long(spark, sf)).select("YEAR", "MONTH", *K, "VALUE")
    return C.outlier_columns(d, "VALUE", ["LOCATION_DESCRIPTION"])


@query("normalize_units")
def q_units(spark, sf):
    return C.normalize_units(_long(spark, sf)).select(
        "STATISTIC_DESCRIPTION", "YEAR", "MONTH", *K, "VALUE", "UNIT_DESCRIPTION")


@query("pivot_statistics")
def q_pivot(spark, sf):
    return C.pivot_statistics(_long(spark, sf), ["YEAR", "MONTH", *K], PIVOT_STATS)


@query("impute_group_median")
def q_impute(spark, sf):
    d = C.coerce_numeric(C.filter_statistic(_raw(spark, sf)))
    d = d.select("TABLE_NUMBER", "YEAR", "MONTH", "LOCATION_DESCRIPTION", "CLASS_DESCRIPTION", "VALUE")
    return C.impute_group_median(d, "VALUE", "LOCATION_DESCRIPTION", out="VALUE_imputed")


@query("replace_group_outliers")
def q_replace_outliers(spark, sf):
    d = C.filter_statistic(_long(spark, sf)).select("YEAR", "MONTH", *K, "VALUE")
    return C.replace_group_outliers(d, "VALUE", "LOCATION_DESCRIPTION", 3.0, out="VALUE_replaced")


@query("clean_observations")
def q_clean(spark, sf):
    return _clean(spark, sf)


@query("clean_minimal_by_period")
def q_clean_minimal(spark, sf):
    d = C.clean_minimal(_raw(spark, sf))
    return S.mean_by_period(d, ["YEAR"], ["VALUE", "VALUE_clipped"])


# ---- trend, inference, metrics -------------------------------------------------------------

@query("trend_fit")
def q_trend_fit(spark, sf):
    return TR.ols_fit(_points(spark, sf), K).select(*K, "n", "slope", "intercept", "r2")


@query("trend_fitted_values")
def q_trend_fitted(spark, sf):
    pts = _points(spark, sf)
    fv = TR.fitted_values(pts, TR.ols_fit(pts, K), K)
    return fv.select(*K, "x", "y", "y_hat", "resid")


@query("ols_inference")
def q_ols_inf(spark, sf):
    inf = TR.ols_inference(TR.ols_fit(_points(spark, sf), K))
    return inf.select(*K, "n", "df_resid", "slope", "intercept", "se_slope", "se_intercept", "t_slope",
                      "t_intercept", "r2", "adj_r2", "f_stat", "llf", "aic", "bic", "cond_no")


@query("coefficients_round_trip")
def q_coefficients(spark, sf):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/furrow-models/{uuid.uuid4().hex}"
    save_coefficients(TR.ols_fit(_points(spark, sf), K), path)
    return load_coefficients(spark, path).select(*K, "n", "slope", "intercept", "r2")


@query("csv_round_trip")
def q_csv(spark, sf):
    d = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/furrow-csv/{uuid.uuid4().hex}"
    write_table(d, path, "csv")
    return scan_csv(spark, path, d.schema)


def _csv_files(spark, sf):
    """Orders as CSV folders whose files order their columns differently; some
    lack a column, have another, or hold lines that don't fit."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", (F.col("o_orderkey") % 4).alias("p"),
                                               (F.col("o_orderkey") % 100).alias("r"))
    text = F.when(F.col("r") == 1, F.lit("unknown")).otherwise(F.col("o_totalprice").cast("string"))
    loose = F.when(F.col("r") == 3, F.concat("o_orderpriority", F.lit(",more"))).otherwise(F.col("o_orderpriority"))
    parts = {"p0": ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
             "p1": [text.alias(" o_totalprice"), "o_orderpriority", "o_orderkey", "o_orderstatus"],
             "p2": ["o_orderpriority", "o_orderkey", "o_totalprice"],
             "p3": [F.lit("x").alias("o_comment"), "o_totalprice", loose.alias("o_orderpriority"), "o_orderstatus", "o_orderkey"]}
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/furrow-csv/{uuid.uuid4().hex}"
    for i, (name, columns) in enumerate(parts.items()):
        # without quotes in the last one, so that a comma in a value is one field more
        out = o.where(F.col("p") == i).select(*columns).write.option("header", True)
        (out.option("quote", "\u0000") if i == 3 else out).csv(f"{base}/{name}")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
                           T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderpriority", T.StringType())])
    return scan_csv_checked(spark, [f"{base}/{n}" for n in parts], schema, with_source=True)


def _folder(file):
    return F.element_at(F.split(file, "/"), -2)


@query("csv_by_header")
def q_csv_by_header(spark, sf):
    """CSV files of different column orders as one table, with provenance."""
    return _csv_files(spark, sf).rows.withColumn("source_file", _folder("source_file")).withColumnRenamed("source_file", "folder")


@query("csv_rejected")
def q_csv_rejected(spark, sf):
    """Unreadable CSV lines per folder."""
    per_file = rejected_counts(_csv_files(spark, sf))
    return per_file.groupBy(_folder("source_file").alias("folder")).agg(F.sum("bad_rows").alias("bad_rows"))


@query("hac_pvalues", P_DIGITS)
def q_hac_p(spark, sf):
    from furrow.functions.distributions import hac_pvalues
    return hac_pvalues(D.newey_west(_points(spark, sf), K), K)


@query("ols_pvalues", P_DIGITS)
def q_ols_p(spark, sf):
    from furrow.functions.distributions import ols_pvalues
    return ols_pvalues(TR.ols_inference(TR.ols_fit(_points(spark, sf), K)), K)


@query("regression_metrics")
def q_metrics(spark, sf):
    pts = _points(spark, sf)
    return TR.regression_metrics(TR.fitted_values(pts, TR.ols_fit(pts, K), K), K)


@query("baseline_comparison")
def q_baseline(spark, sf):
    return TR.baseline_comparison(_points(spark, sf), K)


@query("model_comparison_view")
def q_model_view(spark, sf):
    comp = TR.baseline_comparison(_points(spark, sf), K)
    return TR.model_comparison_view(comp, K, ["LinearRegression", "MeanBaseline"])


@query("temporal_split")
def q_split(spark, sf):
    return S.temporal_split(_points(spark, sf), K).select(*K, "x", "rn", "n", "n_test", "is_test")


@query("ts_cv_folds")
def q_folds(spark, sf):
    return RG.cv_folds(_points(spark, sf), K).select(*K, "x", "rn", "fold", "role")


@query("ridge_grid_cv", {"cv_mse": 2})
def q_grid(spark, sf):
    return RG.ridge_grid_cv(_points(spark, sf), K, _moments(spark, sf)).drop("grid_idx")


@query("ridge_grid_best", {"cv_mse": 2})
def q_best(spark, sf):
    return RG.ridge_grid_best(RG.ridge_grid_cv(_points(spark, sf), K, _moments(spark, sf)), K)


@query("ridge_fit")
def q_ridge_fit(spark, sf):
    pts = _points(spark, sf)
    c = RG.ridge_fit(pts, K, _best(spark, sf, pts), _moments(spark, sf))
    return c.select(*K, "alpha", "degree", "n_fit", "mx", "sx", "b0", "w1", "w2")


@query("ridge_holdout_metrics")
def q_holdout(spark, sf):
    return TR.regression_metrics(_holdout(spark, sf), K + ["part"])


@query("learning_curve")
def q_learning(spark, sf):
    pts = _points(spark, sf)
    return RG.learning_curve(pts, K, _best(spark, sf, pts), _moments(spark, sf))


# ---- diagnostics ---------------------------------------------------------------------------

def _ols_resid(spark, sf):
    pts = _points(spark, sf)
    return TR.fitted_values(pts, TR.ols_fit(pts, K), K)


def _test_resid(spark, sf):
    h = _holdout(spark, sf).where(F.col("part") == "test")
    return h.withColumn("resid", F.col("y") - F.col("y_hat"))


@query("residuals")
def q_resid(spark, sf):
    a = _ols_resid(spark, sf).select(*K, F.lit("ols_full").alias("kind"), "x", "y", "y_hat", "resid")
    b = _test_resid(spark, sf).select(*K, F.lit("ridge_test").alias("kind"), "x", "y", "y_hat", "resid")
    return a.unionByName(b)


@query("newey_west")
def q_nw(spark, sf):
    return D.newey_west(_points(spark, sf), K)


@query("durbin_watson")
def q_dw(spark, sf):
    return D.durbin_watson(_ols_resid(spark, sf), K)


@query("residual_acf")
def q_acf(spark, sf):
    return D.residual_acf(_ols_resid(spark, sf), K)


@query("residual_qq")
def q_qq(spark, sf):
    return D.residual_qq(_ols_resid(spark, sf), K)


@query("normality_tests")
def q_normality(spark, sf):
    return D.normality_tests(_ols_resid(spark, sf), K)


@query("residual_kde", {"density": significant})
def q_kde(spark, sf):
    return D.residual_kde(_test_resid(spark, sf), K)


@query("residual_histogram")
def q_residual_histogram(spark, sf):
    return D.residual_histogram(_test_resid(spark, sf), K)


@query("pred_vs_actual")
def q_pva(spark, sf):
    return D.pred_vs_actual(_test_resid(spark, sf), K)


# ---- plot-backing tables ------------------------------------------------------------------------

@query("scatter_pairs")
def q_scatter(spark, sf):
    p = C.pivot_statistics(_long(spark, sf), ["YEAR", "MONTH", *K], PIVOT_STATS)
    return PR.scatter_pairs(p)


def _overlay(spark, sf):
    pts = _points(spark, sf)
    fit = TR.ols_fit(pts, K)
    fv = TR.fitted_values(pts, fit, K)
    n = S.number_points(fv, K)
    return n.select(*K, "x", "y_raw", F.col("y").alias("y_clipped"), F.col("y_hat").alias("fit"),
                    F.col("slope"), (F.col("rn") == (F.col("n") * 0.7).cast("int")).alias("is_annotation"))


@query("trend_overlay")
def q_overlay(spark, sf):
    return _overlay(spark, sf)


@query("recent_20")
def q_recent(spark, sf):
    return S.recent(_overlay(spark, sf), K, "x", 20)


def _pooled(spark, sf):
    return C.pivot_statistics(_long(spark, sf), ["YEAR", "MONTH", "period_idx", *K], PIVOT_STATS)


@query("pooled_model_comparison")
def q_pooled(spark, sf):
    return PO.pooled_model_comparison(_pooled(spark, sf))


@query("pooled_split")
def q_pooled_split(spark, sf):
    return PO.split_counts(_pooled(spark, sf))


@query("pooled_normal_equations")
def q_pooled_equations(spark, sf):
    return PO.training_equations(_pooled(spark, sf))
