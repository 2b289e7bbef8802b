"""Parity with the published numbers on the 66-point national series."""

import pytest

from golden import golden_points
from furrow.operators import diagnostics as D
from furrow.operators import ridge as RG
from furrow.operators import trend as TR

K = ["LOCATION_DESCRIPTION", "CLASS_DESCRIPTION"]


@pytest.fixture(scope="module")
def pts(spark):
    return golden_points(spark).cache()


def test_ols_inference(pts):
    r = TR.ols_inference(TR.ols_fit(pts, K)).first()
    assert r.n == 66
    assert r.slope == pytest.approx(67.4283, abs=5e-5)
    assert r.intercept == pytest.approx(-128555.661, abs=1e-3)
    assert r.se_slope == pytest.approx(1.710, abs=5e-4)
    assert r.se_intercept == pytest.approx(3406.094, abs=1e-3)
    assert r.r2 == pytest.approx(0.960, abs=5e-4)
    assert r.adj_r2 == pytest.approx(0.960, abs=5e-4)
    assert r.f_stat == pytest.approx(1554, abs=0.5)
    assert r.llf == pytest.approx(-460.82, abs=5e-3)
    assert r.aic == pytest.approx(925.6, abs=0.05)
    assert r.bic == pytest.approx(930.0, abs=0.05)
    assert r.cond_no == pytest.approx(2.08e5, rel=5e-3)


def test_hac_and_durbin_watson(pts):
    nw = D.newey_west(pts, K).first()
    assert nw.hac_se_slope == pytest.approx(2.644, abs=5e-4)
    assert nw.hac_se_intercept == pytest.approx(5280.803, abs=1e-3)
    assert nw.hac_f == pytest.approx(650.4, abs=0.05)
    from furrow.functions.distributions import hac_pvalues
    p = hac_pvalues(D.newey_west(pts, K), K).first()
    assert p.slope_ci_lo == pytest.approx(62.147, abs=5e-4) and p.slope_ci_hi == pytest.approx(72.710, abs=5e-4)
    assert p.p_f == pytest.approx(3.07e-35, rel=5e-3)
    fv = TR.fitted_values(pts, TR.ols_fit(pts, K), K)
    assert D.durbin_watson(fv, K).first().dw == pytest.approx(0.8222, abs=5e-5)


def test_normality_and_acf(pts):
    fv = TR.fitted_values(pts, TR.ols_fit(pts, K), K)
    nt = D.normality_tests(fv, K).first()
    assert nt.omnibus == pytest.approx(2.780, abs=5e-4)
    assert nt.omnibus_pvalue == pytest.approx(0.249, abs=5e-4)
    assert nt.jarque_bera == pytest.approx(1.699, abs=5e-4)
    assert nt.jb_pvalue == pytest.approx(0.428, abs=5e-4)
    assert nt.skew == pytest.approx(-0.122, abs=5e-4)
    assert nt.kurtosis == pytest.approx(2.253, abs=5e-4)
    acf = {r.lag: r.acf for r in D.residual_acf(fv, K).where("lag between 1 and 5").collect()}
    for lag, v in zip(range(1, 6), [0.582964, 0.390547, 0.262425, 0.150290, 0.144290]):
        assert acf[lag] == pytest.approx(v, abs=5e-7)


CV_TABLE = {  # (degree, alpha) -> mean CV MSE on the first 52 years
    (1, 0.01): 204107.0310, (1, 0.1): 201965.1555, (1, 1.0): 185014.1321, (1, 10.0): 214733.2287,
    (1, 100.0): 973149.8459, (2, 0.01): 401642.0378, (2, 0.1): 400553.9546, (2, 1.0): 391732.5944,
    (2, 10.0): 412167.4664, (2, 100.0): 1027938.4088,
}


def test_ridge_grid_and_holdout(spark, pts):
    cv = RG.ridge_grid_cv(pts, K)
    got = {(r.degree, r.alpha): r.cv_mse for r in cv.collect()}
    for k, v in CV_TABLE.items():
        assert got[k] == pytest.approx(v, abs=5e-5)
    best = RG.ridge_grid_best(cv, K)
    b = best.first()
    assert (b.alpha, b.degree) == (1.0, 1)
    m = {r.part: r for r in TR.regression_metrics(RG.ridge_holdout_predictions(pts, K, best), K + ["part"]).collect()}
    assert (m["train"].n, m["test"].n) == (52, 14)
    assert m["test"].r2 == pytest.approx(-0.9540, abs=5e-5)
    assert m["test"].rmse == pytest.approx(260.732, abs=5e-4)
    assert m["test"].mae == pytest.approx(203.792, abs=5e-4)
    assert m["train"].r2 == pytest.approx(0.9344, abs=5e-5)
    assert m["train"].rmse == pytest.approx(265.397, abs=5e-4)
    assert m["train"].mae == pytest.approx(226.572, abs=5e-4)


def test_folds_and_learning_curve_sizes(spark, pts):
    folds = RG.cv_folds(pts, K)
    spans = {}
    for r in folds.collect():
        lo, hi = spans.get((r.fold, r.role), (10**9, -1))
        spans[(r.fold, r.role)] = (min(lo, r.rn), max(hi, r.rn))
    for i, start in enumerate([12, 20, 28, 36, 44]):
        assert spans[(i, "train")] == (0, start - 1)
        assert spans[(i, "test")] == (start, start + 7)
    best = RG.ridge_grid_best(RG.ridge_grid_cv(pts, K), K)
    lc = RG.learning_curve(pts, K, best).orderBy("size").collect()
    assert [r.size for r in lc] == [1, 2, 3, 4, 6, 7, 8, 9, 10, 12]
    assert lc[0].train_mean is None and lc[0].valid_mean is not None


def test_ols_pvalues(pts):
    from furrow.functions.distributions import ols_pvalues
    r = ols_pvalues(TR.ols_inference(TR.ols_fit(pts, K)), K).first()
    assert r.p_slope < 1e-40
    assert r.slope_ci_lo == pytest.approx(64.012, abs=5e-3)
    assert r.slope_ci_hi == pytest.approx(70.845, abs=5e-3)
