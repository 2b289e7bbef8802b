"""The pipeline, stage by stage, each against a plain version of its step."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline as cp
from furrow.llm.common import materialize
from test_dedup import _groups, _plain, _set


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        got = materialize(stage(spark, docs, sf), "test-stage")
        out.append((name, docs, got))
        docs = got
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order_and_columns(steps):
    assert [n for n, _, _ in steps] == ["quality classifier", "line dedup", "near-duplicates", "mixing", "sentencepiece"]
    for _, before, after in steps[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_rows_as_they_are(steps):
    _, before, after = steps[0]
    assert set(after.collect()) <= set(before.collect()) and 0.6 * before.count() < after.count() < before.count()


def test_lines(steps):
    _, before, after = steps[1]
    old, new = _texts(before), _texts(after)
    gone = _plain(list(old.items()))
    assert new == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in old.items()}
    assert all(r.n_chars == len(r.text) for r in after.collect() if gone[r.doc_id])


def test_near(steps):
    _, before, after = steps[2]
    want = _groups({i: _set(t, cp.SHINGLE) for i, t in _texts(before).items()})
    assert sorted(_texts(after)) == sorted(i for i, g in want.items() if i == g)


def test_mixing(steps):
    _, before, after = steps[3]
    rows = after.collect()
    assert set(rows) <= set(before.collect()) and max(Counter(r.doc_id for r in rows).values()) <= 3
    assert all(r.text.split() for r in rows)


def test_encoding(steps, sp):
    _, before, after = steps[4]
    texts = _texts(before)
    assert after.count() == before.count()
    for r in after.collect():
        ids = sp.encode(texts[r.doc_id], add_eos=True)
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_every_stage_takes_odd_rows(spark, sf, odd_docs, no_docs):
    clash = odd_docs.withColumnRenamed("ids", "kept").withColumnsRenamed({"lang": "size"}).withColumn("removed", odd_docs["n_chars"])
    for docs in (clash, no_docs):
        for name, stage in cp.STAGES:
            got = stage(spark, docs, sf)
            if stage is not cp.encoding:
                assert got.columns == docs.columns, name
            got.collect()
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(8, base + " x"), (8, base + " y"), (None, base + " z"), (None, base), (None, "alone " * 9), (3, ""), (3, ""), (None, None)]
    kept = cp.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(3, ""), (3, ""), (None, None), (None, "alone " * 9), min(r for r in map(tuple, kept) if r[0] == 8)], key=str)
    once = cp.near(spark, odd_docs, sf).collect()
    assert sum(r.doc_id == 1 for r in once) == 1 and not any(r.doc_id == 5 for r in once)
