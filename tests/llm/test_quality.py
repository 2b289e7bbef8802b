"""Operator 8: the identity behind the scores, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from furrow.llm import quality_fm
from furrow.llm.queries import op8_quality_fm, training_rows

SF = "/root/testdata/sf0.1"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.3, rng.normal(size=9), rng.normal(size=(4, 9)))
    x = rng.normal(size=9)
    pairs = sum(m.vector[:, i] @ m.vector[:, j] * x[i] * x[j] for i in range(9) for j in range(i))
    got, _ = m.raw(1, np.zeros(9, int), np.arange(9), x)
    assert got[0] == pytest.approx(0.3 + m.weight @ x + pairs)


def test_held_out_accuracy(spark):
    rows = op8_quality_fm(spark, SF).collect()
    assert len(rows) == pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).num_rows
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p == q for p, q in held]) >= 0.98
    assert np.mean([p for p, q in held if q == 1]) >= 0.99


def test_reruns_agree_and_other_columns_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one = quality_fm.fit(training_rows(docs, labels))
    two = quality_fm.fit(training_rows(docs.repartition(5).drop("lang", "source"), labels.repartition(3)))
    assert one.bias == two.bias and (one.weight == two.weight).all() and (one.vector == two.vector).all()


def test_sample_is_bounded_and_depends_on_the_rows_alone(spark):
    rows = spark.range(9000).selectExpr("id div 2 as key", "concat('w', id % 7) as text", "cast(id % 2 as double) as label")
    a, b = (sorted(map(tuple, quality_fm.sampled(rows.repartition(n), 2000).collect())) for n in (3, 7))
    assert a == b and len(a) == 2000
    same = spark.range(500).selectExpr("1 as key", "'x' as text", "cast(id % 2 as double) as label")
    assert quality_fm.sampled(same, 50).count() == 50 and quality_fm.sampled(rows.limit(0), 50).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (6, None), (2, 1), (None, 0)], "doc_id long, quality int")
    machine = quality_fm.fit(training_rows(odd_docs, labels))
    rows = quality_fm.score(odd_docs, machine).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[2] == by[3]
    assert quality_fm.score(no_docs, machine).count() == 0
    # no labels: one half; one label only: its share
    none = quality_fm.fit(training_rows(no_docs, labels))
    assert {r.score for r in quality_fm.score(odd_docs, none).collect()} == {0.5}
    good = quality_fm.fit(training_rows(odd_docs, labels.where("quality = 1")))
    assert all(r.score > 0.5 for r in quality_fm.score(odd_docs, good).collect())
