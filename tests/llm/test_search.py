"""Operators 5 and 7 against all inner products."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from furrow.llm.hilbert import hilbert_keys
from furrow.llm.hilbert_ann import nearest
from furrow.llm.queries import op5_exact_topk, op7_hilbert_ann
from furrow.llm.topk import top_k


def _brute(ids, x, every, k):
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        score = (x * x[n]).sum(1)
        order = np.lexsort((ids, -score))
        order = order[ids[order] != ids[n]][:k]
        out[int(ids[n])] = [(int(ids[j]), score[j]) for j in order]
    return out


def _table(sf):
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    return np.asarray([r["vec_id"] for r in rows]), np.asarray([r["embedding"] for r in rows], np.float64)


def _by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r)
        assert r.rank == len(out[r.query_id])
    return out


def test_op5_equals_brute_force(spark, sf):
    ids, x = _table(sf)
    want = _brute(ids, np.floor(256 * x), 50, 5)
    got = _by_query(op5_exact_topk(spark, sf).collect())
    assert {q: [(r.vec_id, r.score) for r in rs] for q, rs in got.items()} == want


def test_op5_repeated_rows_and_ids_are_one_candidate(spark):
    """Every row 6 times, and one id with ten good vectors, in one block."""
    rng = np.random.default_rng(3)
    ids, x = np.arange(40), rng.normal(size=(40, 8))
    ids, x = np.r_[ids, np.full(10, 7)], np.vstack([x, 3 * x[0] + rng.normal(scale=0.01, size=(10, 8))])
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] * 6
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    y, best = np.floor(256 * x), {}
    for a in np.flatnonzero(ids % 10 == 0):
        for b in np.flatnonzero(ids != ids[a]):
            pair = int(ids[a]), int(ids[b])
            best[pair] = max(best.get(pair, -np.inf), (y[a] * y[b]).sum())
    want = {q: sorted(((c, s) for (p, c), s in best.items() if p == q), key=lambda z: (-z[1], z[0]))[:5] for q in (0, 10, 20, 30)}
    got = _by_query(top_k(df, 5, F.col("vec_id") % 10 == 0).collect())
    assert {q: [(r.vec_id, r.score) for r in rs] for q, rs in got.items()} == want


def test_op7_recall_and_scores(spark, sf):
    ids, x = _table(sf)
    want = _brute(ids, x, 20, 20)
    got = _by_query(op7_hilbert_ann(spark, sf).collect())
    assert got.keys() == want.keys() and all(len(r) == 20 for r in got.values())
    at = {int(i): n for n, i in enumerate(ids)}
    for q, rs in got.items():
        assert [r.score for r in rs] == pytest.approx([x[at[q]] @ x[at[r.vec_id]] for r in rs])
    assert np.mean([len({r.vec_id for r in rs} & {i for i, _ in want[q]}) / 20 for q, rs in got.items()]) >= 0.9


def test_op7_windows_alone_reach_the_recall(spark, sf, monkeypatch):
    """Without the least window, a tenth of the table on each curve."""
    import furrow.llm.hilbert_ann as ann
    monkeypatch.setattr(ann, "LEAST", 1)
    monkeypatch.setattr(ann, "BLOCK", 64)
    ids, x = _table(sf)
    want = _brute(ids, x, 20, 20)
    got = _by_query(op7_hilbert_ann(spark, sf).collect())
    assert np.mean([len({r.vec_id for r in rs} & {i for i, _ in want[q]}) / 20 for q, rs in got.items()]) >= 0.9


def test_op7_spread_knows_every_length(spark, monkeypatch):
    import furrow.llm.hilbert_ann as ann
    monkeypatch.setattr(ann, "SAMPLE", 60)
    monkeypatch.setattr(ann, "SAMPLE_LEAST", 30, raising=False)
    rng = np.random.default_rng(5)
    few = rng.normal(size=(30, 3))
    rows = [(n, v.tolist()) for n, v in enumerate([*rng.normal(size=(3000, 8)), *few])]
    spread = ann._spread(ann.packed(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v"))
    assert sorted(spread) == [3, 8]
    for c, (w, _) in enumerate(ann._projections(3)):
        assert spread[3][c] == pytest.approx(np.quantile(few @ w, np.linspace(0, 1, 257), axis=0).T)


def test_op7_tiles_do_not_change_the_result(spark, sf, monkeypatch):
    import furrow.llm.hilbert_ann as ann
    want = sorted(op7_hilbert_ann(spark, sf).collect())
    monkeypatch.setattr(ann, "TILE", 3)
    assert sorted(op7_hilbert_ann(spark, sf).collect()) == want


def test_hilbert_curve_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25, 1.0]
    rows = [(0, same, 1)] + [(i, same, 1) for i in range(100, 160)] + [
        (1, None, 1), (2, [], 1), (3, [nan, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0], 1), (5, [None, 1.0, 1.0], 1), (6, [0.0, 0.0, 0.0], 1), (None, same, 1),
        (7, [1.0, 1.0], 1), (8, [-1.0, 0.5, 0.25], 1), (8, [-1.0, 0.5, 0.25], 1), (9, [0.1, 0.2, 0.3], 1), (9, [0.9, 0.2, 0.3], 1), (10, [2.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")


def test_odd_vectors_exact(odd_vectors):
    got = _by_query(top_k(odd_vectors, 3, F.col("vec_id") % 10 == 0).collect())
    assert [(r.vec_id, r.score) for r in got[0]] == [(i, 128 * 128 + 64 * 64 + 256 * 256) for i in (100, 101, 102)]
    assert [r.vec_id for r in got[100]] == [0, 101, 102]
    assert [(r.vec_id, r.score) for r in got[10]] == [(7, 2 * 512 * 256)]
    all_of_0 = [r.vec_id for r in _by_query(top_k(odd_vectors, 100, F.col("vec_id") == 0).collect())[0]]
    assert sorted(all_of_0) == [6, 8, 9, *range(100, 160)]
    assert top_k(odd_vectors.limit(0), 3, F.lit(True)).count() == 0


def test_odd_vectors_near(odd_vectors):
    got = _by_query(nearest(odd_vectors, 3, lambda i: i % 10 == 0).collect())
    assert [r.vec_id for r in got[0]] == [100, 101, 102] and [r.vec_id for r in got[100]] == [0, 101, 102]
    assert [(r.vec_id, r.score) for r in got[10]] == [(7, 4.0)]
    every = _by_query(nearest(odd_vectors, 100, lambda i: i == 0).collect())[0]
    assert sorted(r.vec_id for r in every) == [8, 9, *range(100, 160)]
    assert {r.vec_id: r.score for r in every}[9] == pytest.approx(0.45 - 0.05 + 0.3)
    assert nearest(odd_vectors.limit(0), 3, lambda i: i % 10 == 0).count() == 0
