"""Independent DuckDB SQL for each query (the correctness oracle).

Written against the raw driver tables (views ``lineitem``, ``orders``,
``events`` ...), not derived from the DataFrame code. Shared pieces are
common table expressions; every query is one WITH statement.
"""

from __future__ import annotations

# fixed values: number patterns, and the rational approximation of the normal
# quantile with the limit of its tails
NUMBER_TEXT = r"^\s*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
NUMBER_TOKEN = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
_PA = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_PB = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01]
_PC = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_PD = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
P_LOW = 0.02425

KEYS = "LOCATION_DESCRIPTION, CLASS_DESCRIPTION"
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RAW_COLS = ["TABLE_NAME", "TABLE_NUMBER", "COMMODITY_DESCRIPTION", "CLASS_DESCRIPTION", "YEAR", "MONTH",
            "REFERENCE_PERIOD_DESCRIPTION", "LOCATION_DESCRIPTION", "STATISTIC_DESCRIPTION", "VALUE",
            "UNIT_DESCRIPTION"]


def dbl(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def to_double(e: str) -> str:
    s = f"CAST({e} AS VARCHAR)"
    return f"(CASE WHEN regexp_matches({s}, '{NUMBER_TEXT}') THEN TRY_CAST(trim({s}) AS DOUBLE) END)"


def to_int(e: str) -> str:
    d = to_double(e)
    return f"(CASE WHEN {d} = floor({d}) THEN TRY_CAST({d} AS INTEGER) END)"


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def horner(coeffs, x: str) -> str:
    acc = dbl(coeffs[0])
    for k in coeffs[1:]:
        acc = f"({acc} * {x} + {dbl(k)})"
    return acc


def probit_sql(p: str) -> str:
    ql = f"sqrt(-2.0e0 * ln({p}))"
    qh = f"sqrt(-2.0e0 * ln(1.0e0 - {p}))"
    q = f"({p} - 0.5e0)"
    r = f"({q} * {q})"
    lower = f"({horner(_PC, ql)} / ({horner(_PD, ql)} * {ql} + 1.0e0))"
    upper = f"(-{horner(_PC, qh)} / ({horner(_PD, qh)} * {qh} + 1.0e0))"
    central = f"({horner(_PA, r)} * {q} / ({horner(_PB, r)} * {r} + 1.0e0))"
    return f"(CASE WHEN {p} < {dbl(P_LOW)} THEN {lower} WHEN {p} > {dbl(1.0 - P_LOW)} THEN {upper} ELSE {central} END)"


# ---- common table expressions ------------------------------------------------------

CTE = {}
CTE["obs_j"] = """
  SELECT CAST(year(l_shipdate) AS INTEGER) AS YEAR, CAST(month(l_shipdate) AS INTEGER) AS MONTH,
         n_name AS loc, p_type AS cls,
         CAST(l_quantity AS DECIMAL(18,2)) AS q,
         CAST(l_quantity AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS qh,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS p
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey"""
CTE["obs_g"] = """
  SELECT YEAR, MONTH,
         CASE WHEN GROUPING(loc) = 1 THEN 'U.S. TOTAL' ELSE loc END AS LOCATION_DESCRIPTION,
         CASE WHEN GROUPING(cls) = 1 THEN 'ALL CLASSES' ELSE cls END AS CLASS_DESCRIPTION,
         CAST(SUM(q) AS DOUBLE) AS planted, CAST(SUM(qh) AS DOUBLE) AS harvested, CAST(SUM(p) AS DOUBLE) AS production
  FROM obs_j GROUP BY GROUPING SETS ((YEAR, MONTH, loc, cls), (YEAR, MONTH, loc), (YEAR, MONTH, cls), (YEAR, MONTH))"""
CTE["obs_u"] = " UNION ALL ".join(
    f"SELECT YEAR, MONTH, LOCATION_DESCRIPTION, CLASS_DESCRIPTION, '{s}' AS STATISTIC_DESCRIPTION, {v} AS VALUE, "
    f"'{u}' AS UNIT_DESCRIPTION FROM obs_g"
    for s, v, u in [("AREA PLANTED", "planted", "THOUSAND ACRES"), ("AREA HARVESTED", "harvested", "THOUSAND ACRES"),
                    ("PRODUCTION", "production", "THOUSAND CWT"), ("YIELD", "production / planted", "POUNDS PER ACRE")])
CTE["obs_long"] = """
  SELECT 'Shipments, ' || lower(STATISTIC_DESCRIPTION) || ', by nation and part type' AS TABLE_NAME,
         'LINEITEM' AS COMMODITY_DESCRIPTION, CLASS_DESCRIPTION, YEAR, MONTH,
         CAST((YEAR - 1995) * 12 + MONTH AS INTEGER) AS period_idx, 'SHIP MONTH' AS REFERENCE_PERIOD_DESCRIPTION,
         LOCATION_DESCRIPTION, STATISTIC_DESCRIPTION, VALUE, UNIT_DESCRIPTION FROM obs_u"""
CTE["obs_raw"] = """
  SELECT 'Line items, by nation and part type, 1995 to present' AS TABLE_NAME,
         CAST(l_linenumber AS INTEGER) AS TABLE_NUMBER,
         p_brand AS COMMODITY_DESCRIPTION,
         CASE WHEN l_linenumber = 6 THEN NULL ELSE p_type END AS CLASS_DESCRIPTION,
         CASE WHEN l_linenumber = 4 AND l_quantity > 45 THEN NULL ELSE CAST(year(l_shipdate) AS INTEGER) END AS YEAR,
         CAST(month(l_shipdate) AS INTEGER) AS MONTH,
         'SHIP MONTH' AS REFERENCE_PERIOD_DESCRIPTION,
         n_name AS LOCATION_DESCRIPTION,
         CASE WHEN l_returnflag = 'R' THEN 'YIELD' WHEN l_returnflag = 'A' THEN ' yield ' ELSE 'AREA PLANTED' END
           AS STATISTIC_DESCRIPTION,
         CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 3 AND l_discount = 0 THEN NULL
              ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS VALUE,
         CASE WHEN l_returnflag = 'N' THEN 'THOUSAND ACRES' WHEN l_linestatus = 'O' THEN 'POUNDS PER ACRE'
              WHEN l_tax > 0.06 THEN 'CWT PER ACRE' ELSE 'pounds / acre' END AS UNIT_DESCRIPTION
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey"""
STAT_OK = "coalesce(upper(trim(STATISTIC_DESCRIPTION)) = 'YIELD', false)"
UNIT_OK = "coalesce(contains(upper(UNIT_DESCRIPTION), 'POUND'), false)"
CTE["raw_stat"] = f"SELECT * FROM obs_raw WHERE {STAT_OK}"
CTE["c0"] = f"SELECT * FROM obs_raw WHERE {STAT_OK} AND {UNIT_OK} AND YEAR IS NOT NULL AND VALUE IS NOT NULL"
CTE["c1"] = f"SELECT * REPLACE ({to_int('YEAR')} AS YEAR, {to_double('VALUE')} AS VALUE) FROM c0"
CTE["c2"] = """SELECT * REPLACE (trim(CLASS_DESCRIPTION) AS CLASS_DESCRIPTION, trim(LOCATION_DESCRIPTION) AS LOCATION_DESCRIPTION),
         coalesce(upper(trim(LOCATION_DESCRIPTION)) = 'U.S. TOTAL', false) AS is_us_total,
         coalesce(upper(trim(CLASS_DESCRIPTION)) = 'ALL CLASSES', false) AS is_all_classes
  FROM c1 WHERE YEAR IS NOT NULL AND VALUE IS NOT NULL AND NOT isnan(VALUE)"""
CTE["c3"] = "SELECT *, " + ", ".join(f"coalesce(CLASS_DESCRIPTION = '{v}', false) AS \"CLASS_{v}\"" for v in PART_TYPES) + " FROM c2"
CTE["lfirst"] = "SELECT LOCATION_DESCRIPTION AS lc_loc, min(YEAR) AS f FROM c3 WHERE LOCATION_DESCRIPTION IS NOT NULL GROUP BY 1"
CTE["lcode"] = "SELECT lc_loc, CAST(row_number() OVER (ORDER BY f, lc_loc) - 1 AS INTEGER) AS LOCATION_CODE FROM lfirst"
CTE["c4"] = "SELECT c3.*, lcode.LOCATION_CODE FROM c3 LEFT JOIN lcode ON c3.LOCATION_DESCRIPTION IS NOT DISTINCT FROM lcode.lc_loc"
CTE["cst"] = """SELECT avg(YEAR) AS my, stddev_pop(YEAR) AS sy, avg(VALUE) AS mv, stddev_pop(VALUE) AS sv,
         stddev_samp(VALUE) AS zs, quantile_cont(VALUE, 0.25) AS q1, quantile_cont(VALUE, 0.75) AS q3,
         quantile_cont(VALUE, 0.01) AS p01, quantile_cont(VALUE, 0.99) AS p99 FROM c4"""
CTE["obs_clean"] = """SELECT c4.*,
         (YEAR - my) / CASE WHEN sy IS NULL OR sy = 0 THEN 1.0e0 ELSE sy END AS YEAR_scaled,
         (VALUE - mv) / CASE WHEN sv IS NULL OR sv = 0 THEN 1.0e0 ELSE sv END AS VALUE_scaled,
         coalesce(VALUE < q1 - 1.5e0 * (q3 - q1) OR VALUE > q3 + 1.5e0 * (q3 - q1), false) AS is_outlier_iqr,
         CASE WHEN zs <> 0 THEN (VALUE - mv) / zs END AS value_zscore,
         CASE WHEN VALUE IS NOT NULL THEN least(greatest(VALUE, p01), p99) END AS VALUE_clipped
  FROM c4, cst"""
CLEAN = ["obs_raw", "c0", "c1", "c2", "c3", "lfirst", "lcode", "c4", "cst", "obs_clean"]
LONG = ["obs_j", "obs_g", "obs_u", "obs_long"]

CTE["yl"] = f"SELECT * FROM obs_long WHERE {STAT_OK}"
CTE["yq"] = "SELECT quantile_cont(VALUE, 0.01) AS lo, quantile_cont(VALUE, 0.99) AS hi FROM yl"
CTE["yc"] = """SELECT yl.*, coalesce(upper(trim(LOCATION_DESCRIPTION)) = 'U.S. TOTAL', false) AS is_us_total,
         coalesce(upper(trim(CLASS_DESCRIPTION)) = 'ALL CLASSES', false) AS is_all_classes,
         CASE WHEN VALUE IS NOT NULL THEN least(greatest(VALUE, lo), hi) END AS VALUE_clipped FROM yl, yq"""
CTE["pts"] = f"""SELECT {KEYS}, period_idx AS x, avg(VALUE_clipped) AS y, avg(VALUE) AS y_raw
  FROM yc GROUP BY {KEYS}, period_idx"""
YIELD = LONG + ["yl", "yq", "yc"]
PTS = YIELD + ["pts"]

CTE["pm"] = f"""SELECT {KEYS}, x, y, CAST(x AS DOUBLE) AS xd, avg(CAST(x AS DOUBLE)) OVER w AS mx, avg(y) OVER w AS my
  FROM pts WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY {KEYS})"""
CTE["fit0"] = f"""SELECT {KEYS}, count(*) AS n, any_value(mx) AS x_mean, any_value(my) AS y_mean,
         sum((xd - mx) * (xd - mx)) AS sxx, sum((xd - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy
  FROM pm GROUP BY {KEYS}"""
CTE["fit1"] = "SELECT *, sxy / CASE WHEN sxx <> 0 THEN sxx END AS slope FROM fit0"
CTE["fit2"] = "SELECT *, y_mean - slope * x_mean AS intercept, greatest(syy - slope * sxy, 0.0e0) AS ssr FROM fit1"
CTE["fit"] = "SELECT *, CASE WHEN syy <> 0 THEN 1.0e0 - ssr / syy END AS r2 FROM fit2"
CTE["fv"] = f"""SELECT pts.*, fit.slope, fit.intercept, fit.x_mean, fit.intercept + fit.slope * CAST(pts.x AS DOUBLE) AS y_hat,
         pts.y - (fit.intercept + fit.slope * CAST(pts.x AS DOUBLE)) AS resid
  FROM pts JOIN fit USING ({KEYS})"""
FIT = PTS + ["pm", "fit0", "fit1", "fit2", "fit"]
FV = FIT + ["fv"]

# temporal split and folds
CTE["sp0"] = f"""SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY x) - 1 AS INTEGER) AS rn,
         CAST(count(*) OVER (PARTITION BY {KEYS}) AS INTEGER) AS n FROM pts"""
CTE["split"] = """SELECT *, n - n_test AS n_train, rn >= n - n_test AS is_test
  FROM (SELECT *, CAST(greatest(1, ceil(n * 0.2e0)) AS INTEGER) AS n_test FROM sp0)"""
CTE["folds"] = """SELECT s.*, CAST(f.fold AS INTEGER) AS fold,
         CASE WHEN rn < n_train - (5 - f.fold) * (n_train // 6) THEN 'train' ELSE 'test' END AS role
  FROM split s, range(0, 5) f(fold)
  WHERE NOT is_test AND n_train // 6 > 0 AND rn < n_train - (5 - f.fold) * (n_train // 6) + n_train // 6
  UNION ALL SELECT s.*, CAST(NULL AS INTEGER) AS fold, 'too short' AS role FROM split s WHERE n_train < 6"""
SHORT = "'fewer than 6 training points'"
SPLIT = PTS + ["sp0", "split"]
FOLDS = SPLIT + ["folds"]

GRID_ROWS = [(a, d) for a in [0.01, 0.1, 1.0, 10.0, 100.0] for d in [1, 2]]
CTE["grid"] = "SELECT * FROM (VALUES " + ", ".join(f"({dbl(a)}, {d}, {i})" for i, (a, d) in enumerate(GRID_ROWS)) + \
    ") g(alpha, degree, grid_idx)"


def moments_cte(src: str, grp: str) -> str:
    """Ridge moments of rows (grp..., xd, y) in CTE ``src`` grouped by grp."""
    return f"""SELECT {grp}, count(*) AS n_fit, any_value(mx) AS mx, any_value(sx) AS sx, any_value(my) AS my,
         avg(z) AS mz, avg(z * z) AS mz2, sum(z * z) AS s2, sum(z * z * z) AS s3, sum(z * z * z * z) AS s4,
         sum(z * yc) AS szy, sum(z * z * yc) AS sz2y
  FROM (SELECT *, (xd - mx) / sx AS z, y - my AS yc FROM (
          SELECT *, avg(xd) OVER w AS mx,
                 CASE WHEN stddev_pop(xd) OVER w IS NULL OR stddev_pop(xd) OVER w = 0 THEN 1.0e0
                      ELSE stddev_pop(xd) OVER w END AS sx,
                 avg(y) OVER w AS my
          FROM {src} WINDOW w AS (PARTITION BY {grp})))
  GROUP BY {grp}"""


def coef_select(src: str) -> str:
    return f"""SELECT *, CASE WHEN degree = 1 THEN 0.0e0 ELSE ((saa + alpha) * sz2y - sab * szy) / det END AS w2,
                CASE WHEN degree = 1 THEN szy / (saa + alpha) ELSE ((sbb + alpha) * szy - sab * sz2y) / det END AS w1
  FROM (SELECT *, (saa + alpha) * (sbb + alpha) - sab * sab AS det FROM (
        SELECT *, s2 - n_fit * mz * mz AS saa, s4 - n_fit * mz2 * mz2 AS sbb, s3 - n_fit * mz * mz2 AS sab FROM {src}))"""


CTE["cv_tr"] = f"SELECT {KEYS}, fold, CAST(x AS DOUBLE) AS xd, y FROM folds WHERE role = 'train'"
CTE["cv_mom"] = moments_cte("cv_tr", f"{KEYS}, fold")
CTE["cv_coef0"] = coef_select("(SELECT * FROM cv_mom, grid)")
CTE["cv_coef"] = "SELECT *, my - w1 * mz - w2 * mz2 AS b0 FROM cv_coef0"
CTE["cv_pred"] = f"""SELECT f.{KEYS.replace(', ', ', f.')}, f.fold, f.y, c.alpha, c.degree, c.grid_idx,
         c.b0 + c.w1 * ((CAST(f.x AS DOUBLE) - c.mx) / c.sx) + c.w2 * ((CAST(f.x AS DOUBLE) - c.mx) / c.sx)
           * ((CAST(f.x AS DOUBLE) - c.mx) / c.sx) AS y_hat
  FROM folds f JOIN cv_coef c USING ({KEYS}, fold) WHERE f.role = 'test'"""
CTE["cv_fold_mse"] = f"""SELECT {KEYS}, fold, alpha, degree, grid_idx, avg((y - y_hat) * (y - y_hat)) AS mse
  FROM cv_pred GROUP BY {KEYS}, fold, alpha, degree, grid_idx"""
CTE["cv"] = f"""SELECT {KEYS}, alpha, degree, grid_idx, avg(mse) AS cv_mse, count(*) AS n_folds, CAST(NULL AS VARCHAR) AS reason
  FROM cv_fold_mse GROUP BY {KEYS}, alpha, degree, grid_idx
  UNION ALL SELECT DISTINCT {KEYS}, alpha, degree, grid_idx, CAST(NULL AS DOUBLE), 0, {SHORT} FROM split, grid WHERE n_train < 6"""
CTE["best"] = f"""SELECT {KEYS}, CASE WHEN cv_mse IS NOT NULL THEN alpha END AS alpha,
  CASE WHEN cv_mse IS NOT NULL THEN degree END AS degree, cv_mse, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY cv_mse, grid_idx) AS _r FROM cv) WHERE _r = 1"""
CV = FOLDS + ["grid", "cv_tr", "cv_mom", "cv_coef0", "cv_coef", "cv_pred", "cv_fold_mse", "cv"]
BEST = CV + ["best"]
CTE["ho_tr"] = f"SELECT {KEYS}, CAST(x AS DOUBLE) AS xd, y FROM split WHERE NOT is_test"
CTE["ho_mom"] = moments_cte("ho_tr", KEYS)
CTE["ho_coef0"] = coef_select(f"(SELECT * REPLACE (coalesce(n_fit, 0) AS n_fit) FROM best LEFT JOIN ho_mom USING ({KEYS}))")
CTE["ho_coef"] = "SELECT *, my - w1 * mz - w2 * mz2 AS b0 FROM ho_coef0"
CTE["ho_pred"] = f"""SELECT s.*, CASE WHEN s.is_test THEN 'test' ELSE 'train' END AS part,
         c.b0 + c.w1 * ((CAST(s.x AS DOUBLE) - c.mx) / c.sx) + c.w2 * ((CAST(s.x AS DOUBLE) - c.mx) / c.sx)
           * ((CAST(s.x AS DOUBLE) - c.mx) / c.sx) AS y_hat
  FROM split s JOIN ho_coef c USING ({KEYS})"""
HOLD = BEST + ["ho_tr", "ho_mom", "ho_coef0", "ho_coef", "ho_pred"]
CTE["tres"] = "SELECT *, y - y_hat AS resid FROM ho_pred WHERE part = 'test'"
TRES = HOLD + ["tres"]


def metrics_sql(src: str, grp: str) -> str:
    return f"""SELECT {grp}, count(*) AS n, sqrt(avg((y - y_hat) * (y - y_hat))) AS rmse, avg(abs(y - y_hat)) AS mae,
         CASE WHEN sum((y - ym) * (y - ym)) <> 0
              THEN 1.0e0 - sum((y - y_hat) * (y - y_hat)) / sum((y - ym) * (y - ym)) END AS r2
  FROM (SELECT *, avg(y) OVER (PARTITION BY {grp}) AS ym FROM {src}) GROUP BY {grp}"""


def with_(names: list[str], body: str) -> str:
    """WITH clause of the named shared CTEs followed by ``body``; a body may
    continue the list with its own ``, name AS (...)`` entries."""
    seen, ordered = set(), []
    for n in names:
        if n not in seen:
            seen.add(n)
            ordered.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered) + "\n" + body


ORACLE_SQL: dict[str, str] = {}
Q = ORACLE_SQL

# ---- scans, filters ------------------------------------------------------------------------
Q["scan_obs_long"] = with_(LONG, f"SELECT * REPLACE ({r6('VALUE')}) FROM obs_long")
ORDER_RAW = ", ".join(f"{c} ASC NULLS FIRST" for c in RAW_COLS)
Q["preview_rows"] = with_(["obs_raw"], f"SELECT * FROM obs_raw ORDER BY {ORDER_RAW} LIMIT 50")
Q["canonical_columns"] = """SELECT CAST(year(o_orderdate) AS INTEGER) AS YEAR, o_orderpriority AS LOCATION_DESCRIPTION,
       o_orderstatus AS CLASS_DESCRIPTION, round(o_totalprice, 6) AS YIELD, round(o_totalprice, 6) AS VALUE FROM orders"""
Q["filter_statistic"] = with_(["obs_raw"], f"SELECT * FROM obs_raw WHERE {STAT_OK}")
Q["filter_unit"] = with_(["obs_raw"], f"SELECT * FROM obs_raw WHERE {STAT_OK} AND {UNIT_OK}")
Q["filter_statistic_regex"] = with_(["obs_raw"],
                                    "SELECT * FROM obs_raw WHERE coalesce(regexp_matches(STATISTIC_DESCRIPTION, 'YIELD'), false)")
Q["drop_null_keys"] = with_(["obs_raw"], "SELECT * FROM obs_raw WHERE YEAR IS NOT NULL AND VALUE IS NOT NULL")
Q["coerce_numeric"] = with_(["obs_raw", "raw_stat"],
                            f"SELECT * REPLACE ({to_int('YEAR')} AS YEAR, round({to_double('VALUE')}, 6) AS VALUE) FROM raw_stat")
FLAG_COLS = f"STATISTIC_DESCRIPTION, YEAR, MONTH, {KEYS}"
Q["series_flags"] = with_(LONG, f"""SELECT {FLAG_COLS},
  coalesce(upper(trim(LOCATION_DESCRIPTION)) = 'U.S. TOTAL', false) AS is_us_total,
  coalesce(upper(trim(CLASS_DESCRIPTION)) = 'ALL CLASSES', false) AS is_all_classes FROM obs_long""")
Q["series_flags_regex"] = with_(LONG, f"""SELECT {FLAG_COLS},
  coalesce(regexp_matches(upper(LOCATION_DESCRIPTION), 'U.S'), false)
    OR coalesce(regexp_matches(upper(LOCATION_DESCRIPTION), 'U.S. TOTAL'), false) AS is_us_total,
  coalesce(regexp_matches(upper(CLASS_DESCRIPTION), 'ALL'), false) AS is_all_classes FROM obs_long""")
Q["finite_pairs"] = """WITH e AS (
  SELECT user_id, event_id, CAST(event_id AS DOUBLE) AS x,
         CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE)
              WHEN event_type = 'view' AND value > 90 THEN CAST('Infinity' AS DOUBLE) ELSE value END AS y FROM events),
ok AS (SELECT * FROM e WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE)
                        AND y IS NOT NULL AND NOT isnan(y) AND abs(y) < CAST('Infinity' AS DOUBLE))
SELECT user_id, event_id, round(x, 6) AS x, round(y, 6) AS y FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS _n FROM ok) WHERE _n >= 2"""
_tok = f"regexp_extract(trim(props), '{NUMBER_TOKEN}', 0)"
Q["extract_number"] = f"""SELECT event_id, props,
  round(coalesce({to_double('trim(props)')}, CASE WHEN {_tok} <> '' THEN TRY_CAST({_tok} AS DOUBLE) END), 6) AS number
  FROM events"""

# ---- aggregations ------------------------------------------------------------------------------
Q["mean_by_period"] = """SELECT CAST(year(o_orderdate) AS INTEGER) AS YEAR, CAST(month(o_orderdate) AS INTEGER) AS MONTH,
  round(avg(o_totalprice), 6) AS mean_totalprice FROM orders GROUP BY 1, 2"""
Q["mean_raw_clipped_by_period"] = with_(YIELD, """SELECT YEAR, MONTH, round(avg(VALUE), 6) AS VALUE,
  round(avg(VALUE_clipped), 6) AS VALUE_clipped FROM yc GROUP BY YEAR, MONTH""")
Q["preferred_value_by_period"] = with_(YIELD, """SELECT YEAR, MONTH,
  round(avg(coalesce(CASE WHEN MONTH <> 1 THEN VALUE_clipped END, VALUE)), 6) AS VALUE_used FROM yc GROUP BY YEAR, MONTH""")
Q["top_states_by_median"] = """SELECT LOCATION_DESCRIPTION, round(median, 6) AS median, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY median DESC, LOCATION_DESCRIPTION) AS INTEGER) AS rank FROM (
    SELECT o_orderpriority AS LOCATION_DESCRIPTION, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5) AS median FROM orders GROUP BY 1)) WHERE rank <= 3"""
Q["all_rows_by_period"] = with_(YIELD, """SELECT YEAR, round(avg(VALUE), 6) AS VALUE,
  round(avg(VALUE_clipped), 6) AS VALUE_clipped FROM yc GROUP BY YEAR""")
Q["total_series"] = with_(YIELD, """, t AS (SELECT *, coalesce(is_us_total AND is_all_classes, false) AS fl FROM yc),
  a AS (SELECT coalesce(bool_or(fl), false) AS anyf FROM t)
  SELECT YEAR, MONTH, round(avg(VALUE), 6) AS VALUE, round(avg(VALUE_clipped), 6) AS VALUE_clipped
  FROM t, a WHERE fl OR (NOT anyf AND coalesce(upper(LOCATION_DESCRIPTION) = 'U.S. TOTAL', false)
                         AND coalesce(upper(CLASS_DESCRIPTION) = 'ALL CLASSES', false))
  GROUP BY YEAR, MONTH""")
Q["median_by_location"] = with_(LONG, """SELECT LOCATION_DESCRIPTION, round(quantile_cont(VALUE, 0.5), 6) AS median
  FROM obs_long WHERE VALUE IS NOT NULL GROUP BY 1""")
Q["top_locations_by_median"] = with_(LONG, """SELECT LOCATION_DESCRIPTION, round(median, 6) AS median,
  CAST(row_number() OVER (ORDER BY median DESC, LOCATION_DESCRIPTION) AS INTEGER) AS rank FROM (
  SELECT LOCATION_DESCRIPTION, quantile_cont(VALUE, 0.5) AS median FROM obs_long GROUP BY 1)
  ORDER BY median DESC, LOCATION_DESCRIPTION LIMIT 12""")
Q["value_quantiles"] = """SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS p01,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99
  FROM lineitem"""
_num = ["TABLE_NUMBER", "YEAR", "MONTH"]
_lg = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM obs_raw" for c in _num)
Q["describe_numeric"] = with_(["obs_raw"], f""", lg AS ({_lg}),
  s AS (SELECT "column", CAST(count(value) AS DOUBLE) AS count, avg(value) AS mean, stddev_samp(value) AS std,
               min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
               quantile_cont(value, 0.75) AS p75, max(value) AS max FROM lg GROUP BY 1)
  SELECT "column", stat, round(value, 6) AS value FROM s
  UNPIVOT (value FOR stat IN (count, mean, std, min, p25, p50, p75, max))""")
_str = ["TABLE_NAME", "COMMODITY_DESCRIPTION", "CLASS_DESCRIPTION", "REFERENCE_PERIOD_DESCRIPTION",
        "LOCATION_DESCRIPTION", "STATISTIC_DESCRIPTION", "VALUE", "UNIT_DESCRIPTION"]
_ls = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM obs_raw" for c in _str)
CTE["ls"] = _ls
Q["describe_string"] = with_(["obs_raw", "ls"], """, vc AS (SELECT "column", value, count(*) AS cnt FROM ls WHERE value IS NOT NULL GROUP BY 1, 2)
  SELECT "column", CAST(sum(cnt) AS BIGINT) AS count, count(*) AS "unique",
         arg_min(value, (-cnt, value)) AS top, max(cnt) AS freq FROM vc GROUP BY 1""")
_types = {"TABLE_NUMBER": "int", "YEAR": "int", "MONTH": "int"}
Q["table_profile"] = with_(["obs_raw"], "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{_types.get(c, 'string')}' AS dtype, count({c}) AS non_null, "
    f"count(*) AS \"rows\", {len(RAW_COLS)} AS \"columns\" FROM obs_raw" for i, c in enumerate(RAW_COLS)) + ")")
Q["value_counts_top20"] = with_(["obs_raw", "ls"], """SELECT "column", value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC NULLS FIRST) AS rank FROM (
    SELECT "column", value, count(*) AS count FROM ls GROUP BY 1, 2)) WHERE rank <= 20""")
Q["null_counts"] = with_(["obs_raw"], "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS nulls FROM obs_raw WHERE {STAT_OK} AND {UNIT_OK}"
    for c in RAW_COLS) + ")")
_all_raw = ", ".join(RAW_COLS)
Q["duplicate_rows"] = with_(["obs_raw"], f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS "rows",
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT {_all_raw}, count(*) AS n FROM obs_raw GROUP BY ALL)""")
_clean_cols = RAW_COLS + ["is_us_total", "is_all_classes"] + [f"CLASS_{v}" for v in PART_TYPES] + \
    ["LOCATION_CODE", "YEAR_scaled", "VALUE_scaled", "is_outlier_iqr", "value_zscore", "VALUE_clipped"]
_match = " AND ".join(
    (f"c.{c} IS NOT DISTINCT FROM {to_double('r.VALUE')}" if c == "VALUE" else f"c.{c} IS NOT DISTINCT FROM r.{c}")
    for c in RAW_COLS)
CTE["dropped"] = f"SELECT r.* FROM obs_raw r WHERE NOT EXISTS (SELECT 1 FROM obs_clean c WHERE {_match})"
_missing_clean = " + ".join(f"count_if(\"{c}\" IS NULL)" for c in _clean_cols)
_missing_raw = " + ".join(f"count_if({c} IS NULL)" for c in RAW_COLS)
_dup_clean = ", ".join(f'"{c}"' for c in _clean_cols)
Q["processing_compare"] = with_(CLEAN + ["dropped"], f""", o AS (SELECT count(*) AS orig_rows, {len(RAW_COLS)} AS orig_cols,
         CAST({_missing_raw} AS BIGINT) AS orig_missing_total FROM obs_raw),
  od AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS orig_duplicates FROM (SELECT count(*) AS n FROM obs_raw GROUP BY {_all_raw})),
  cc AS (SELECT count(*) AS clean_rows, {len(_clean_cols)} AS clean_cols, CAST({_missing_clean} AS BIGINT) AS clean_missing_total FROM obs_clean),
  cd AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS clean_duplicates FROM (SELECT count(*) AS n FROM obs_clean GROUP BY {_dup_clean})),
  dr AS (SELECT count(*) AS dropped_rows_by_merge FROM dropped),
  j AS (SELECT *, orig_rows - clean_rows AS rows_removed FROM o, od, cc, cd, dr)
  SELECT metric, CAST(value AS BIGINT) AS value FROM j UNPIVOT (value FOR metric IN (orig_rows, orig_cols,
    orig_missing_total, orig_duplicates, clean_rows, clean_cols, clean_missing_total, clean_duplicates,
    rows_removed, dropped_rows_by_merge))""")
_s1 = STAT_OK
_s2 = f"{_s1} AND {UNIT_OK}"
_s3 = f"{_s2} AND YEAR IS NOT NULL AND VALUE IS NOT NULL"
_s4 = f"{_s3} AND {to_int('YEAR')} IS NOT NULL AND {to_double('VALUE')} IS NOT NULL"
_steps = ["raw_rows", "after_statistic_filter", "after_unit_filter", "after_null_drop", "after_coercion_drop",
          "iqr_outliers", "zscore_outliers"]
Q["cleaning_audit"] = with_(CLEAN, f""", s AS (SELECT count(*) AS raw_rows, count_if({_s1}) AS after_statistic_filter,
    count_if({_s2}) AS after_unit_filter, count_if({_s3}) AS after_null_drop, count_if({_s4}) AS after_coercion_drop FROM obs_raw),
  o AS (SELECT count_if(is_outlier_iqr) AS iqr_outliers, count_if(abs(value_zscore) > 3) AS zscore_outliers FROM obs_clean)
  SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT {i} AS step_no, '{m}' AS step, CAST({m} AS BIGINT) AS value FROM s, o" for i, m in enumerate(_steps)) + ")"
)
Q["dropped_rows"] = with_(CLEAN + ["dropped"], "SELECT * FROM dropped")
Q["dropped_rows_sample"] = with_(CLEAN + ["dropped"], f"SELECT * FROM dropped ORDER BY {ORDER_RAW} LIMIT 50")


def hist_sql(src: str, bins: int, grp: str | None = None) -> str:
    g = f"{grp}, " if grp else ""
    by = f"GROUP BY {grp}" if grp else ""
    join = f"USING ({grp})" if grp else "ON true"
    return f"""rng AS (SELECT {g}min(v) AS lo, max(v) AS hi FROM {src} {by}),
  b AS (SELECT {g}CASE WHEN hi - lo > 0 THEN least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS INTEGER) + 1, {bins})
                  ELSE 1 END AS bin FROM {src} JOIN rng {join}),
  cnt AS (SELECT {g}bin, count(*) AS count FROM b GROUP BY ALL),
  allb AS (SELECT {g}lo, hi, CAST(r.range AS INTEGER) AS bin FROM rng, range(1, {bins + 1}) r)
  SELECT {('allb.' + grp + ', ') if grp else ''}allb.bin, round(lo + (hi - lo) * (allb.bin - 1) / {bins}.0e0, 6) AS bin_lo,
         round(lo + (hi - lo) * allb.bin / {bins}.0e0, 6) AS bin_hi, CAST(coalesce(cnt.count, 0) AS BIGINT) AS count
  FROM allb LEFT JOIN cnt ON allb.bin = cnt.bin{(' AND allb.' + grp + ' = cnt.' + grp) if grp else ''}"""


Q["histogram_30"] = "WITH v0 AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),\n" + \
    hist_sql("v0", 30)
Q["histogram_before_after"] = with_(CLEAN, f""", v0 AS (
  SELECT 'before' AS stage, {to_double('VALUE')} AS v FROM obs_raw WHERE coalesce(regexp_matches(STATISTIC_DESCRIPTION, 'YIELD'), false)
  UNION ALL SELECT 'after' AS stage, VALUE_clipped AS v FROM obs_clean),
  v1 AS (SELECT * FROM v0 WHERE v IS NOT NULL AND NOT isnan(v)),
  """ + hist_sql("v1", 40, "stage")
)


def box_sql(src: str, grp: str | None = None) -> str:
    g = f"{grp}, " if grp else ""
    by = f"GROUP BY {grp}" if grp else ""
    join = f"USING ({grp})" if grp else "ON true"
    return f"""q AS (SELECT {g}quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM {src} {by})
  SELECT {g}count(*) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
         round(min(CASE WHEN v >= q1 - 1.5e0 * (q3 - q1) THEN v END), 6) AS whisker_lo,
         round(max(CASE WHEN v <= q3 + 1.5e0 * (q3 - q1) THEN v END), 6) AS whisker_hi,
         CAST(count_if(v < q1 - 1.5e0 * (q3 - q1) OR v > q3 + 1.5e0 * (q3 - q1)) AS BIGINT) AS n_outliers
  FROM {src} JOIN q {join} {by}"""


Q["box_stats"] = "WITH v0 AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),\n" + box_sql("v0")
Q["box_stats_top12"] = with_(LONG, """, med AS (SELECT LOCATION_DESCRIPTION, quantile_cont(VALUE, 0.5) AS m FROM obs_long GROUP BY 1),
  top AS (SELECT LOCATION_DESCRIPTION FROM med WHERE m IS NOT NULL ORDER BY m DESC, LOCATION_DESCRIPTION LIMIT 12),
  v0 AS (SELECT LOCATION_DESCRIPTION, VALUE AS v FROM obs_long WHERE LOCATION_DESCRIPTION IN (SELECT * FROM top)
         AND VALUE IS NOT NULL AND NOT isnan(VALUE)),
  """ + box_sql("v0", "LOCATION_DESCRIPTION"))

_FEATURES = "v0 AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM lineitem WHERE {c} IS NOT NULL AND NOT isnan({c})"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + "),\n"
Q["histogram_all_columns"] = "WITH " + _FEATURES + hist_sql("v0", 30, "feature")
Q["box_stats_all_columns"] = "WITH " + _FEATURES + box_sql("v0", "feature")
Q["csv_round_trip"] = "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders"

# ---- features ------------------------------------------------------------------------------
Q["one_hot_class"] = with_(["obs_raw"], "SELECT TABLE_NUMBER, YEAR, MONTH, LOCATION_DESCRIPTION, CLASS_DESCRIPTION, " +
                           ", ".join(f"coalesce(CLASS_DESCRIPTION = '{v}', false) AS \"CLASS_{v}\"" for v in PART_TYPES) +
                           " FROM obs_raw")
Q["factorize_location"] = with_(["obs_raw"], """, f AS (SELECT LOCATION_DESCRIPTION, min(YEAR) AS f FROM obs_raw WHERE LOCATION_DESCRIPTION IS NOT NULL GROUP BY 1),
  c AS (SELECT LOCATION_DESCRIPTION, CAST(row_number() OVER (ORDER BY f, LOCATION_DESCRIPTION) - 1 AS INTEGER) AS LOCATION_CODE FROM f)
  SELECT r.LOCATION_DESCRIPTION, c.LOCATION_CODE, count(*) AS "rows"
  FROM obs_raw r LEFT JOIN c ON r.LOCATION_DESCRIPTION IS NOT DISTINCT FROM c.LOCATION_DESCRIPTION GROUP BY 1, 2
""")
Q["class_codes"] = with_(["obs_raw"], """, c AS (SELECT CLASS_DESCRIPTION, CAST(row_number() OVER (ORDER BY CLASS_DESCRIPTION) - 1 AS INTEGER) AS CLASS_CODE
    FROM (SELECT DISTINCT CLASS_DESCRIPTION FROM obs_raw WHERE CLASS_DESCRIPTION IS NOT NULL))
  SELECT r.CLASS_DESCRIPTION, c.CLASS_CODE, count(*) AS "rows"
  FROM obs_raw r LEFT JOIN c ON r.CLASS_DESCRIPTION = c.CLASS_DESCRIPTION GROUP BY 1, 2""")
Q["standard_scale"] = with_(YIELD, f""", s AS (SELECT avg(YEAR) AS my, stddev_pop(YEAR) AS sy, avg(VALUE) AS mv, stddev_pop(VALUE) AS sv FROM yl)
  SELECT YEAR, MONTH, {KEYS}, round(VALUE, 6) AS VALUE,
    round((YEAR - my) / CASE WHEN sy IS NULL OR sy = 0 THEN 1.0e0 ELSE sy END, 6) AS YEAR_scaled,
    round((VALUE - mv) / CASE WHEN sv IS NULL OR sv = 0 THEN 1.0e0 ELSE sv END, 6) AS VALUE_scaled FROM yl, s
""")
Q["iqr_outliers"] = """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
  SELECT event_id, round(value, 6) AS value,
         coalesce(value < q1 - 1.5e0 * (q3 - q1) OR value > q3 + 1.5e0 * (q3 - q1), false) AS is_outlier_iqr FROM events, q"""
Q["zscore_outliers"] = """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
  SELECT event_id, round(value, 6) AS value, round(CASE WHEN sd <> 0 THEN (value - m) / sd END, 6) AS value_zscore,
         coalesce(abs(CASE WHEN sd <> 0 THEN (value - m) / sd END) > 3.0e0, false) AS is_outlier_z FROM events, s"""
Q["winsorize"] = """WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
  SELECT event_id, round(value, 6) AS value,
         round(CASE WHEN value IS NOT NULL THEN least(greatest(value, lo), hi) END, 6) AS value_clipped FROM events, q"""
Q["winsorize_by_location"] = with_(YIELD, f""", d AS (SELECT YEAR, MONTH, {KEYS}, VALUE FROM yl),
  s AS (SELECT LOCATION_DESCRIPTION, quantile_cont(VALUE, 0.01) AS lo, quantile_cont(VALUE, 0.99) AS hi,
               quantile_cont(VALUE, 0.25) AS q1, quantile_cont(VALUE, 0.75) AS q3, avg(VALUE) AS m, stddev_samp(VALUE) AS sd
        FROM d GROUP BY 1)
  SELECT YEAR, MONTH, {KEYS}, round(VALUE, 6) AS VALUE,
    round(CASE WHEN VALUE IS NOT NULL THEN least(greatest(VALUE, lo), hi) END, 6) AS VALUE_clipped,
    coalesce(VALUE < q1 - 1.5e0 * (q3 - q1) OR VALUE > q3 + 1.5e0 * (q3 - q1), false) AS is_outlier_iqr,
    round(CASE WHEN sd <> 0 THEN (VALUE - m) / sd END, 6) AS value_zscore,
    coalesce(abs(CASE WHEN sd <> 0 THEN (VALUE - m) / sd END) > 3.0e0, false) AS is_outlier_z
  FROM d LEFT JOIN s USING (LOCATION_DESCRIPTION)""")
Q["normalize_units"] = with_(LONG, f"""SELECT STATISTIC_DESCRIPTION, YEAR, MONTH, {KEYS},
  round(VALUE * CASE upper(trim(UNIT_DESCRIPTION)) WHEN 'THOUSAND ACRES' THEN 1000.0e0 WHEN 'THOUSAND CWT' THEN 100000.0e0 ELSE 1.0e0 END, 6) AS VALUE,
  CASE upper(trim(UNIT_DESCRIPTION)) WHEN 'THOUSAND ACRES' THEN 'ACRES' WHEN 'THOUSAND CWT' THEN 'POUNDS' ELSE UNIT_DESCRIPTION END AS UNIT_DESCRIPTION
  FROM obs_long""")
_piv = ["YIELD", "AREA PLANTED", "AREA HARVESTED", "PRODUCTION"]
CTE["piv"] = f"""SELECT YEAR, MONTH, {KEYS}, """ + ", ".join(
    f"avg(CASE WHEN upper(trim(STATISTIC_DESCRIPTION)) = '{s}' THEN VALUE END) AS \"{s}\"" for s in _piv) + \
    f""" FROM obs_long WHERE upper(trim(STATISTIC_DESCRIPTION)) IN ({", ".join(f"'{s}'" for s in _piv)}) GROUP BY YEAR, MONTH, {KEYS}"""
Q["pivot_statistics"] = with_(LONG + ["piv"], "SELECT * REPLACE (" + ", ".join(f'round("{s}", 6) AS "{s}"' for s in _piv) + ") FROM piv")
_pooled = ["period_idx", "AREA PLANTED", "AREA HARVESTED", "PRODUCTION", "YIELD"]
CTE["pooled"] = f"""SELECT *, CAST(CAST('0x' || substr(md5(concat_ws('|', {KEYS}, YEAR, MONTH)), 1, 8) AS UBIGINT) % 100 AS INTEGER) < 80 AS is_train,
    {" AND ".join(f'"{c}" IS NOT NULL' for c in ["LOCATION_DESCRIPTION", "CLASS_DESCRIPTION", "YEAR", "MONTH", *_pooled])} AS complete
  FROM (SELECT *, (YEAR - 1995) * 12 + MONTH AS period_idx FROM piv)"""
Q["pooled_split"] = with_(LONG + ["piv", "pooled"], """SELECT LOCATION_DESCRIPTION, count(*) FILTER (complete AND is_train) AS n_train,
  count(*) FILTER (complete AND NOT is_train) AS n_test, count(*) FILTER (NOT complete) AS n_incomplete FROM pooled GROUP BY LOCATION_DESCRIPTION""")
_scale = ", ".join(f'avg("{c}") AS m{i}, stddev_pop("{c}") AS s{i}' for i, c in enumerate(_pooled))
_features = ", ".join(["{'k': 0, 'f': '1', 'v': 1.0e0}", *(f"""{{'k': {i + 1}, 'f': '{c}', 'v': ("{c}" - m{i}) / s{i}}}""" for i, c in enumerate(_pooled)),
                       *(f"{{'k': {i + 6}, 'f': '{c}=' || {c}, 'v': 1.0e0}}" for i, c in enumerate(["LOCATION_DESCRIPTION", "CLASS_DESCRIPTION"]))])
Q["pooled_normal_equations"] = with_(LONG + ["piv", "pooled"], f""", train AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM pooled WHERE complete AND is_train),
  scale AS (SELECT {_scale} FROM train),
  feature AS MATERIALIZED (SELECT r, f.k AS k, f.f AS f, f.v AS v FROM (SELECT r, unnest([{_features}]) AS f FROM train, scale))
  SELECT a.f AS a, b.f AS b, round(sum(a.v * b.v), 6) AS value FROM feature a JOIN feature b ON a.r = b.r AND a.k <= b.k GROUP BY a.f, b.f""")
Q["impute_group_median"] = with_(["obs_raw", "raw_stat"], f""", d AS (SELECT TABLE_NUMBER, {to_int('YEAR')} AS YEAR, MONTH, {KEYS},
         {to_double('VALUE')} AS VALUE FROM raw_stat),
  g AS (SELECT LOCATION_DESCRIPTION, quantile_cont(VALUE, 0.5) AS gm FROM d GROUP BY 1),
  o AS (SELECT quantile_cont(VALUE, 0.5) AS om FROM d)
  SELECT TABLE_NUMBER, YEAR, MONTH, d.LOCATION_DESCRIPTION, CLASS_DESCRIPTION, round(VALUE, 6) AS VALUE,
         round(coalesce(VALUE, gm, om), 6) AS VALUE_imputed
  FROM d LEFT JOIN g ON d.LOCATION_DESCRIPTION IS NOT DISTINCT FROM g.LOCATION_DESCRIPTION, o""")
Q["replace_group_outliers"] = with_(YIELD, f""", d AS (SELECT YEAR, MONTH, {KEYS}, VALUE FROM yl),
  s AS (SELECT LOCATION_DESCRIPTION, avg(VALUE) AS m, stddev_samp(VALUE) AS sd, quantile_cont(VALUE, 0.5) AS med FROM d GROUP BY 1)
  SELECT YEAR, MONTH, {KEYS}, round(VALUE, 6) AS VALUE,
    round(CASE WHEN coalesce(abs(CASE WHEN sd <> 0 THEN (VALUE - m) / sd END) > 3.0e0, false) THEN med ELSE VALUE END, 6) AS VALUE_replaced
  FROM d LEFT JOIN s USING (LOCATION_DESCRIPTION)""")
_dbl_clean = ["VALUE", "YEAR_scaled", "VALUE_scaled", "value_zscore", "VALUE_clipped"]
Q["clean_observations"] = with_(CLEAN, f"SELECT * EXCLUDE (lc_loc) REPLACE ({r6(*_dbl_clean)}) FROM obs_clean"
                                if False else f"SELECT * REPLACE ({r6(*_dbl_clean)}) FROM obs_clean")
Q["clean_minimal_by_period"] = with_(["obs_raw"], f""", m0 AS (SELECT YEAR, {to_double('VALUE')} AS VALUE FROM obs_raw
         WHERE coalesce(regexp_matches(STATISTIC_DESCRIPTION, 'YIELD'), false)),
  q AS (SELECT quantile_cont(VALUE, 0.01) AS lo, quantile_cont(VALUE, 0.99) AS hi FROM m0)
  SELECT YEAR, round(avg(VALUE), 6) AS VALUE,
         round(avg(CASE WHEN VALUE IS NOT NULL THEN least(greatest(VALUE, lo), hi) END), 6) AS VALUE_clipped
  FROM m0, q GROUP BY YEAR""")

# ---- trend, inference, metrics ---------------------------------------------------------------
Q["trend_fit"] = with_(FIT, f"SELECT {KEYS}, n, {r6('slope', 'intercept', 'r2')} FROM fit")
Q["coefficients_round_trip"] = Q["trend_fit"]
Q["trend_fitted_values"] = with_(FV, f"SELECT {KEYS}, x, {r6('y', 'y_hat', 'resid')} FROM fv")
_LN2PI = dbl(1.8378770664093453)
CTE["inf0"] = """SELECT *, CAST(n - 2 AS INTEGER) AS df_resid, CASE WHEN n - 2 > 0 THEN ssr / (n - 2.0e0) END AS s2 FROM fit"""
CTE["inf1"] = """SELECT *, sqrt(s2 / sxx) AS se_slope, sqrt(s2 * (1.0e0 / n + x_mean * x_mean / sxx)) AS se_intercept FROM inf0"""
CTE["inf2"] = f"""SELECT *, slope / se_slope AS t_slope, intercept / se_intercept AS t_intercept,
         1.0e0 - (1.0e0 - r2) * (n - 1.0e0) / (n - 2.0e0) AS adj_r2,
         (-CAST(n AS DOUBLE) / 2) * ({_LN2PI} + ln(ssr / n) + 1.0e0) AS llf,
         CAST(n AS DOUBLE) + (sxx + n * x_mean * x_mean) AS tr, CAST(n AS DOUBLE) * sxx AS det FROM inf1"""
CTE["inf"] = """SELECT *, t_slope * t_slope AS f_stat, -2.0e0 * llf + 4.0e0 AS aic, -2.0e0 * llf + 2.0e0 * ln(n) AS bic,
         sqrt(((tr + sqrt(greatest(tr * tr - 4 * det, 0.0e0))) / 2) / (det / ((tr + sqrt(greatest(tr * tr - 4 * det, 0.0e0))) / 2))) AS cond_no
  FROM inf2"""
Q["ols_inference"] = with_(FIT + ["inf0", "inf1", "inf2", "inf"], f"""SELECT {KEYS}, n, df_resid,
  {r6('slope', 'intercept', 'se_slope', 'se_intercept', 't_slope', 't_intercept', 'r2', 'adj_r2', 'f_stat', 'llf', 'aic', 'bic')},
  round(cond_no, 6) AS cond_no FROM inf""")


def t_tail_sql(t: str, v: str) -> str:
    """Two-sided tail of Student's t: the power series of the incomplete beta
    function in v / (v + t^2), or 1 less that in t^2 / (v + t^2)."""
    x, y = f"({v} / ({v} + {t} * {t}))", f"({t} * {t} / ({v} + {t} * {t}))"
    far = f"sqrt({y}) * list_sum([exp(lgamma({v} / 2 + 0.5e0 + i) - lgamma(0.5e0) - lgamma({v} / 2 + 1 + i) + ({v} / 2 + i) * ln({x})) FOR i IN range(0, 2000)])"
    near = f"1 - sqrt({y}) * list_sum([exp(lgamma({v} / 2 + 0.5e0 + i) - lgamma({v} / 2) - lgamma(1.5e0 + i) + {v} / 2 * ln({x}) + i * ln({y})) FOR i IN range(0, 2000)])"
    return f"(CASE WHEN {t} IS NULL OR {v} IS NULL OR {v} < 1 THEN NULL WHEN {t} = 0 THEN 1.0e0 WHEN {t} * {t} > 4 THEN {far} ELSE {near} END)"


def sig_sql(e: str, name: str) -> str:
    return f"CASE WHEN {e} IS NOT NULL THEN CAST(printf('%.5e', {e}) AS DOUBLE) END AS {name}"


# 97.5 % points by halving, per distinct degrees of freedom
HALVING = f"""steps(v, lo, hi, k) AS (
  SELECT DISTINCT v, 0.0e0, 1000.0e0, 0 FROM vs WHERE v >= 1
  UNION ALL SELECT v, CASE WHEN p > 0.05e0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p > 0.05e0 THEN hi ELSE (lo + hi) / 2 END, k + 1
  FROM (SELECT *, {t_tail_sql("((lo + hi) / 2)", "v")} AS p FROM steps WHERE k < 60)),
  crit AS (SELECT v, (lo + hi) / 2 AS tc FROM steps WHERE k = 60)"""


def bounds_sql(c: str, se: str) -> str:
    return f"round({c} - tc * {se}, 6) AS {c}_ci_lo, round({c} + tc * {se}, 6) AS {c}_ci_hi"


Q["ols_pvalues"] = with_(FIT + ["inf0", "inf1", "inf2", "inf"], f""", vs AS (SELECT CAST(n - 2 AS DOUBLE) AS v, * FROM inf), {HALVING}
  SELECT {KEYS}, {r6('slope', 'se_slope')}, {sig_sql(t_tail_sql('t_slope', 'vs.v'), 'p_slope')}, {bounds_sql('slope', 'se_slope')},
    {r6('intercept', 'se_intercept')}, {sig_sql(t_tail_sql('t_intercept', 'vs.v'), 'p_intercept')}, {bounds_sql('intercept', 'se_intercept')},
    round(f_stat, 6) AS f_stat, {sig_sql(t_tail_sql('sqrt(f_stat)', 'vs.v'), 'p_f')}
  FROM vs LEFT JOIN crit ON vs.v = crit.v""").replace("WITH ", "WITH RECURSIVE ", 1)
Q["regression_metrics"] = with_(FV, "SELECT * REPLACE (" + r6("rmse", "mae", "r2") + ") FROM (" + metrics_sql("fv", KEYS) + ")")
_bm = metrics_sql("(SELECT *, avg(y) OVER (PARTITION BY " + KEYS + ") AS y_hat FROM pts)", KEYS)
CTE["bcomp"] = f"SELECT *, 'LinearRegression' AS model FROM ({metrics_sql('fv', KEYS)}) UNION ALL " \
               f"SELECT *, 'MeanBaseline' AS model FROM ({_bm})"
Q["baseline_comparison"] = with_(FV + ["bcomp"], f"SELECT {KEYS}, model, n, {r6('rmse', 'mae', 'r2')} FROM bcomp")
Q["model_comparison_view"] = with_(FV + ["bcomp"], f"""SELECT {KEYS},
  CASE model WHEN 'LinearRegression' THEN 'Linear Regression' WHEN 'GradientBoosting' THEN 'Gradient Boosting'
             WHEN 'RandomForest' THEN 'Random Forest' WHEN 'MeanBaseline' THEN 'Mean baseline' ELSE model END AS Model,
  round_even(rmse, 3) AS RMSE, round_even(mae, 3) AS MAE, round_even(r2, 3) AS R2
  FROM bcomp WHERE model IN ('LinearRegression', 'MeanBaseline')""")
Q["temporal_split"] = with_(SPLIT, f"SELECT {KEYS}, x, rn, n, n_test, is_test FROM split")
Q["ts_cv_folds"] = with_(FOLDS, f"SELECT {KEYS}, x, rn, fold, role FROM folds")
Q["ridge_grid_cv"] = with_(CV, f"SELECT {KEYS}, round(alpha, 6) AS alpha, degree, round(cv_mse, 2) AS cv_mse, n_folds, reason FROM cv")
Q["ridge_grid_best"] = with_(BEST, f"SELECT {KEYS}, round(alpha, 6) AS alpha, degree, round(cv_mse, 2) AS cv_mse, reason FROM best")
Q["ridge_fit"] = with_(HOLD, f"""SELECT {KEYS}, round(alpha, 6) AS alpha, degree, n_fit,
  {r6('mx', 'sx', 'b0', 'w1', 'w2')} FROM ho_coef""")
Q["ridge_holdout_metrics"] = with_(HOLD, "SELECT * REPLACE (" + r6("rmse", "mae", "r2") + ") FROM (" +
                                   metrics_sql("ho_pred", KEYS + ", part") + ")")

Q["csv_by_header"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 2 THEN o_orderstatus END AS o_orderstatus,
  round(CAST(o_totalprice AS DOUBLE), 6) AS o_totalprice, o_orderpriority, 'p' || CAST(o_orderkey % 4 AS VARCHAR) AS folder
  FROM orders WHERE o_orderkey % 100 NOT IN (1, 3)"""
Q["csv_rejected"] = """SELECT 'p' || CAST(o_orderkey % 4 AS VARCHAR) AS folder, count(*) AS bad_rows
  FROM orders WHERE o_orderkey % 100 IN (1, 3) GROUP BY 1"""

# learning curve
_step = (1.0 - 0.1) / 9
_fracs = [i * _step + 0.1 for i in range(9)] + [1.0]
CTE["lc_first"] = f"SELECT {KEYS}, count(*) AS n_first FROM folds WHERE fold = 0 AND role = 'train' GROUP BY {KEYS}"
CTE["lc_sizes"] = f"""SELECT DISTINCT {KEYS}, least(greatest(CAST(floor(f * n_first) AS INTEGER), 1), n_first) AS size
  FROM lc_first, (SELECT unnest([{", ".join(dbl(f) for f in _fracs)}]) AS f)"""
CTE["lc_prefix"] = f"SELECT s.*, z.size FROM split s JOIN lc_sizes z USING ({KEYS}) WHERE NOT s.is_test AND s.rn < z.size"
CTE["lc_tr"] = f"SELECT {KEYS}, size, CAST(x AS DOUBLE) AS xd, y FROM lc_prefix"
CTE["lc_mom"] = moments_cte("lc_tr", f"{KEYS}, size")
CTE["lc_coef0"] = coef_select(f"(SELECT * FROM lc_mom JOIN best USING ({KEYS}))")
CTE["lc_coef"] = "SELECT *, my - w1 * mz - w2 * mz2 AS b0 FROM lc_coef0"
_zx = "((CAST(x AS DOUBLE) - mx) / sx)"
_yh = f"b0 + w1 * {_zx} + w2 * {_zx} * {_zx}"
CTE["lc_trp"] = f"SELECT {KEYS}, size, y, {_yh} AS y_hat FROM lc_prefix JOIN lc_coef USING ({KEYS}, size)"
CTE["lc_vp"] = f"""SELECT {KEYS}, z.size, f.fold, f.y, {_yh.replace('x AS', 'f.x AS')} AS y_hat
  FROM folds f JOIN lc_sizes z USING ({KEYS}) JOIN lc_coef USING ({KEYS}, size) WHERE f.role = 'test'"""


def r2_sql(src: str, grp: str) -> str:
    return f"""SELECT {grp}, CASE WHEN count(*) < 2 THEN NULL
              WHEN sum((y - ym) * (y - ym)) = 0 THEN CASE WHEN sum((y - y_hat) * (y - y_hat)) = 0 THEN 1.0e0 ELSE 0.0e0 END
              ELSE 1.0e0 - sum((y - y_hat) * (y - y_hat)) / sum((y - ym) * (y - ym)) END AS score
  FROM (SELECT *, avg(y) OVER (PARTITION BY {grp}) AS ym FROM {src}) GROUP BY {grp}"""


CTE["lc_ts"] = r2_sql("lc_trp", f"{KEYS}, size")
CTE["lc_vs"] = r2_sql("lc_vp", f"{KEYS}, size, fold")
CTE["lc_va"] = f"SELECT {KEYS}, size, avg(score) AS valid_mean, stddev_pop(score) AS valid_std FROM lc_vs GROUP BY {KEYS}, size"
Q["learning_curve"] = with_(BEST + ["lc_first", "lc_sizes", "lc_prefix", "lc_tr", "lc_mom", "lc_coef0", "lc_coef",
                                    "lc_trp", "lc_vp", "lc_ts", "lc_vs", "lc_va"],
                            f"""SELECT {KEYS}, size, round(score, 6) AS train_mean,
  round(CASE WHEN score IS NOT NULL THEN 0.0e0 END, 6) AS train_std, round(valid_mean, 6) AS valid_mean, round(valid_std, 6) AS valid_std, CAST(NULL AS VARCHAR) AS reason
  FROM lc_ts JOIN lc_va USING ({KEYS}, size)
  UNION ALL SELECT DISTINCT {KEYS}, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {SHORT}
  FROM split WHERE n_train < 6""")

# ---- diagnostics ------------------------------------------------------------------------------
Q["residuals"] = with_(FV + TRES[len(PTS):], f"""SELECT {KEYS}, 'ols_full' AS kind, x, {r6('y', 'y_hat', 'resid')} FROM fv
  UNION ALL SELECT {KEYS}, 'ridge_test' AS kind, x, {r6('y', 'y_hat', 'resid')} FROM tres""")
_L = 4
_nw_lags = ", ".join(f"lag(e, {l}) OVER w AS e{l}, lag(xc, {l}) OVER w AS xc{l}" for l in range(1, _L + 1))
_s00 = "sum(e * e)" + "".join(f" + {dbl(2 * (1.0 - l / (_L + 1.0)))} * coalesce(sum(e * e{l}), 0.0e0)" for l in range(1, _L + 1))
_s01 = "sum(xc * e * e)" + "".join(f" + {dbl(1.0 - l / (_L + 1.0))} * coalesce(sum(e * e{l} * (xc + xc{l})), 0.0e0)" for l in range(1, _L + 1))
_s11 = "sum(xc * xc * e * e)" + "".join(f" + {dbl(2 * (1.0 - l / (_L + 1.0)))} * coalesce(sum(xc * xc{l} * e * e{l}), 0.0e0)" for l in range(1, _L + 1))
CTE["nw0"] = f"""SELECT {KEYS}, {_s00} AS s00, {_s01} AS s01, {_s11} AS s11 FROM (
  SELECT *, {_nw_lags} FROM (SELECT {KEYS}, x, resid AS e, CAST(x AS DOUBLE) - x_mean AS xc FROM fv)
  WINDOW w AS (PARTITION BY {KEYS} ORDER BY x)) GROUP BY {KEYS}"""
CTE["nw1"] = f"""SELECT {KEYS}, n, slope, intercept,
         sqrt(s11 / (sxx * sxx)) AS hac_se_slope,
         sqrt(s00 / (CAST(n AS DOUBLE) * n) - 2 * x_mean * (s01 / (n * sxx)) + x_mean * x_mean * (s11 / (sxx * sxx))) AS hac_se_intercept
  FROM nw0 JOIN fit USING ({KEYS})"""
Q["newey_west"] = with_(FV + ["nw0", "nw1"], f"""SELECT {KEYS}, n, {r6('slope', 'intercept', 'hac_se_slope', 'hac_se_intercept')},
  round(slope / hac_se_slope, 6) AS hac_t_slope, round(intercept / hac_se_intercept, 6) AS hac_t_intercept,
  round((slope / hac_se_slope) * (slope / hac_se_slope), 6) AS hac_f FROM nw1""")
Q["hac_pvalues"] = with_(FV + ["nw0", "nw1"], f""", vs AS (SELECT CAST(n - 2 AS DOUBLE) AS v, slope / hac_se_slope AS ts,
    intercept / hac_se_intercept AS ti, * FROM nw1), {HALVING}
  SELECT {KEYS}, n, {r6('slope', 'hac_se_slope')}, {sig_sql(t_tail_sql('ts', 'vs.v'), 'p_slope')},
    {r6('intercept', 'hac_se_intercept')}, {sig_sql(t_tail_sql('ti', 'vs.v'), 'p_intercept')},
    {bounds_sql('slope', 'hac_se_slope')}, {bounds_sql('intercept', 'hac_se_intercept')},
    round(ts * ts, 6) AS hac_f, {sig_sql(t_tail_sql('abs(ts)', 'vs.v'), 'p_f')}
  FROM vs LEFT JOIN crit ON vs.v = crit.v""").replace("WITH ", "WITH RECURSIVE ", 1)
Q["durbin_watson"] = with_(FV, f"""SELECT {KEYS}, round(sum(d * d) / sum(resid * resid), 6) AS dw FROM (
  SELECT {KEYS}, resid, resid - lag(resid, 1) OVER (PARTITION BY {KEYS} ORDER BY x) AS d FROM fv) GROUP BY {KEYS}""")
_NL = 20
_acf_lags = ", ".join(f"lag(c, {k}) OVER (PARTITION BY {KEYS} ORDER BY x) AS c{k}" for k in range(1, _NL + 1))
_acf_sums = ", ".join(["sum(c * c) AS s0"] + [f"sum(c * c{k}) AS s{k}" for k in range(1, _NL + 1)])
CTE["acf0"] = f"""SELECT {KEYS}, count(*) AS n, {_acf_sums} FROM (
  SELECT *, {_acf_lags} FROM (SELECT {KEYS}, x, resid - avg(resid) OVER (PARTITION BY {KEYS}) AS c FROM fv)) GROUP BY {KEYS}"""
CTE["acf1"] = " UNION ALL ".join(f"SELECT {KEYS}, n, {k} AS lag, coalesce(s{k}, 0.0e0) / s0 AS acf FROM acf0" for k in range(_NL + 1))
Q["residual_acf"] = with_(FV + ["acf0", "acf1"], f"""SELECT {KEYS}, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf,
  round(CASE WHEN lag = 0 THEN 0.0e0 ELSE {dbl(1.959963984540054)} * sqrt((1.0e0 + 2 * coalesce(sum(CASE WHEN lag >= 1 THEN acf * acf END)
        OVER (PARTITION BY {KEYS} ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0)) / CAST(n AS DOUBLE)) END, 6) AS band
  FROM acf1""")
_th = probit_sql("(i / (n + 1.0e0))")
Q["residual_qq"] = with_(FV, f"""SELECT {KEYS}, CAST(i AS INTEGER) AS i, round(sample, 6) AS sample, round({_th}, 6) AS theoretical,
  round(sd * {_th} + m, 6) AS line FROM (
  SELECT {KEYS}, resid AS sample, row_number() OVER (PARTITION BY {KEYS} ORDER BY resid) AS i,
         count(*) OVER (PARTITION BY {KEYS}) AS n, avg(resid) OVER (PARTITION BY {KEYS}) AS m,
         stddev_pop(resid) OVER (PARTITION BY {KEYS}) AS sd FROM fv)""")
CTE["nm0"] = f"""SELECT {KEYS}, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM (
  SELECT {KEYS}, resid - avg(resid) OVER (PARTITION BY {KEYS}) AS d FROM fv) GROUP BY {KEYS} HAVING count(*) >= 4"""
CTE["nm1"] = """SELECT *, m3 / pow(m2, 1.5e0) AS skew, m4 / (m2 * m2) AS kurtosis, CAST(n AS DOUBLE) AS nd FROM nm0"""
CTE["nm2"] = """SELECT *, nd / 6 * (skew * skew + (kurtosis - 3) * (kurtosis - 3) / 4) AS jb,
    skew * sqrt((nd + 1) * (nd + 3) / (6.0e0 * (nd - 2))) AS y0,
    3.0e0 * (nd * nd + 27 * nd - 70) * (nd + 1) * (nd + 3) / ((nd - 2.0e0) * (nd + 5) * (nd + 7) * (nd + 9)) AS beta2,
    3.0e0 * (nd - 1) / (nd + 1) AS ek,
    24.0e0 * nd * (nd - 2) * (nd - 3) / ((nd + 1) * (nd + 1) * (nd + 3) * (nd + 5)) AS varb2,
    6.0e0 * (nd * nd - 5 * nd + 2) / ((nd + 7) * (nd + 9)) * sqrt((6.0e0 * (nd + 3) * (nd + 5)) / (nd * (nd - 2) * (nd - 3))) AS sb1
  FROM nm1"""
CTE["nm3"] = """SELECT *, -1.0e0 + sqrt(2 * (beta2 - 1)) AS w2, CASE WHEN y0 = 0 THEN 1.0e0 ELSE y0 END AS yv,
    (kurtosis - ek) / sqrt(varb2) AS xk, 6.0e0 + 8.0e0 / sb1 * (2.0e0 / sb1 + sqrt(1 + 4.0e0 / (sb1 * sb1))) AS a FROM nm2"""
CTE["nm4"] = """SELECT *, 1.0e0 / sqrt(0.5e0 * ln(w2)) AS delta, sqrt(2.0e0 / (w2 - 1)) AS alpha,
    1 - 2 / (9.0e0 * a) AS term1, 1 + xk * sqrt(2 / (a - 4.0e0)) AS denom FROM nm3"""
CTE["nm5"] = """SELECT *, delta * ln(yv / alpha + sqrt((yv / alpha) * (yv / alpha) + 1)) AS zs,
    (term1 - sign(denom) * cbrt((1 - 2.0e0 / a) / abs(denom))) / sqrt(2 / (9.0e0 * a)) AS zk FROM nm4"""
Q["normality_tests"] = with_(FV + ["nm0", "nm1", "nm2", "nm3", "nm4", "nm5"], f"""SELECT {KEYS}, n,
  round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(jb, 6) AS jarque_bera, round(exp(-jb / 2), 6) AS jb_pvalue,
  round(zs * zs + zk * zk, 6) AS omnibus, round(exp(-(zs * zs + zk * zk) / 2), 6) AS omnibus_pvalue FROM nm5""")
Q["residual_kde"] = with_(TRES, f""", st AS (SELECT {KEYS}, count(resid) AS n, min(resid) AS lo, max(resid) AS hi,
         stddev_samp(resid) AS sd FROM tres GROUP BY {KEYS} HAVING count(resid) >= 2 AND stddev_samp(resid) > 0),
  gr AS (SELECT st.*, pow(CAST(n AS DOUBLE), -0.2e0) * sd AS h, CAST(g.range AS INTEGER) AS g FROM st, range(0, 200) g)
  SELECT {KEYS}, g, round(lo + (hi - lo) * g / 199.0e0, 6) AS gx,
    {sig_sql(f"(sum(exp(-0.5e0 * ((lo + (hi - lo) * g / 199.0e0 - resid) / h) * ((lo + (hi - lo) * g / 199.0e0 - resid) / h))) / (n * h * {dbl(2.5066282746310002)}))", "density")}
  FROM gr JOIN (SELECT {KEYS}, resid FROM tres) t USING ({KEYS}) GROUP BY {KEYS}, g, lo, hi, n, h
  UNION ALL SELECT {KEYS}, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM tres GROUP BY {KEYS}
    HAVING NOT (count(resid) >= 2 AND coalesce(stddev_samp(resid), 0) > 0)""")
Q["residual_histogram"] = with_(TRES, f""", st AS (SELECT {KEYS}, count(resid) AS n, min(resid) AS lo, max(resid) AS hi,
         quantile_cont(resid, 0.75) - quantile_cont(resid, 0.25) AS iqr FROM tres GROUP BY {KEYS}),
  wd AS (SELECT *, (hi - lo) / (log2(n) + 1) AS w1, 2 * iqr / pow(n, 1.0e0 / 3) AS w2 FROM st),
  bn AS (SELECT *, CASE WHEN hi > lo THEN CAST(ceil((hi - lo) / CASE WHEN w2 > 0 THEN least(w1, w2) ELSE w1 END) AS INTEGER) WHEN hi = lo THEN 1 END AS k FROM wd),
  sz AS (SELECT *, CASE WHEN hi > lo THEN lo ELSE lo - 0.5e0 END AS fr, CASE WHEN hi > lo THEN (hi - lo) / k ELSE 1.0e0 END AS w FROM bn),
  ct AS (SELECT {KEYS}, least(CAST(floor((resid - fr) / w) AS INTEGER) + 1, k) AS bin, count(*) AS c
         FROM tres JOIN sz USING ({KEYS}) WHERE resid IS NOT NULL GROUP BY ALL),
  ev AS (SELECT {KEYS}, fr, w, CAST(unnest(CASE WHEN k > 0 THEN range(1, k + 1) ELSE [NULL] END) AS INTEGER) AS bin FROM sz)
  SELECT {KEYS}, bin, round(fr + w * (bin - 1), 6) AS bin_lo, round(fr + w * (bin - 1) + w, 6) AS bin_hi,
    CASE WHEN bin IS NOT NULL THEN coalesce(c, 0) END AS count FROM ev LEFT JOIN ct USING ({KEYS}, bin)""")
Q["pred_vs_actual"] = with_(TRES, f"""SELECT {KEYS}, x, round(y, 6) AS actual, round(y_hat, 6) AS predicted, round(resid, 6) AS resid,
  round(least(min(y) OVER w, min(y_hat) OVER w), 6) AS lim_lo, round(greatest(max(y) OVER w, max(y_hat) OVER w), 6) AS lim_hi
  FROM tres WINDOW w AS (PARTITION BY {KEYS})""")

# ---- plot-backing tables ------------------------------------------------------------------------
Q["scatter_pairs"] = with_(LONG + ["piv"], """SELECT * FROM (
  SELECT 'YIELD vs YEAR' AS pair, round(CAST(YEAR AS DOUBLE), 6) AS x, round("YIELD", 6) AS y FROM piv
  UNION ALL SELECT 'YIELD vs AREA PLANTED', round("AREA PLANTED", 6), round("YIELD", 6) FROM piv
  UNION ALL SELECT 'YIELD vs PRODUCTION', round("PRODUCTION", 6), round("YIELD", 6) FROM piv
  UNION ALL SELECT 'PRODUCTION vs AREA PLANTED', round("AREA PLANTED", 6), round("PRODUCTION", 6) FROM piv)""")
CTE["ov"] = f"""SELECT {KEYS}, x, y_raw, y AS y_clipped, y_hat AS fit, slope,
    rn = CAST(floor(n * 0.7e0) AS INTEGER) AS is_annotation, rn FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY x) - 1 AS INTEGER) AS rn,
         count(*) OVER (PARTITION BY {KEYS}) AS n FROM fv)"""
_ovcols = f"{KEYS}, x, {r6('y_raw', 'y_clipped', 'fit', 'slope')}, is_annotation"
Q["trend_overlay"] = with_(FV + ["ov"], f"SELECT {_ovcols} FROM ov")
Q["recent_20"] = with_(FV + ["ov"], f"""SELECT {_ovcols} FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY x DESC) AS _r FROM ov) WHERE _r <= 20""")


def _zero_canonical(sql: str) -> str:
    """Rewrite every ``round(...)`` as ``(round(...) + 0.0e0)``: a rounded
    -0.0 becomes 0.0, as in the Spark output."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        out.append("(round(" + _zero_canonical(sql[j + 6:k]) + ") + 0.0e0)")
        i = k + 1


ORACLE_SQL = {name: _zero_canonical(sql) for name, sql in ORACLE_SQL.items()}
