"""Operator 2: targets against a plain loop, and the rounding's bounds."""

import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from furrow.llm.mixing import mix
from furrow.llm.queries import op2_mix_sources


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        target = {s: 3.0 * sizes[s] if s in stopped else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in stopped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        stopped |= over


def _words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_and_bounds(spark, sf):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    rows = op2_mix_sources(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = defaultdict(int)
    for d in docs.values():
        sizes[d["source"]] += _words(d["text"])
    want, taken, largest = _targets(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in rows:
        s = docs[r.doc_id]["source"]
        assert r.size == _words(docs[r.doc_id]["text"]) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(rows) == sorted(op2_mix_sources(spark, sf).collect())


def test_capped_sources_and_expectation(spark):
    rows = [(i, "w " * 10, "big") for i in range(400)] + [(1000 + i, "w " * 10, "s") for i in range(4)] + [(2000, "w " * 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = _targets({"big": 4000, "s": 40, None: 8})
    got = defaultdict(int)
    for r in mix(df).collect():
        assert r.target == pytest.approx(want[r.source])
        if r.source != "big":
            assert r.copies == 3
        got[r.source] += r.copies * r.size
    assert abs(got["big"] - want["big"]) <= 10
    # every document's share of takes is about its expectation
    total = sum(r.copies for seed in range(6) for r in mix(df, seed=seed).where("doc_id < 50").collect())
    assert abs(total / 300 - want["big"] / 4000) < 0.08


def test_odd_rows(odd_docs, no_docs):
    rows = mix(odd_docs.withColumnRenamed("ids", "size")).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.copies == 0 for r in rows if not _words(r.text))
    assert {r.source_size for r in rows if r.source is None} == {6}
    twins = [r.copies for r in rows if r.doc_id == 1]
    assert len(twins) == 2 and abs(twins[0] - twins[1]) <= 1 and max(twins) <= 3
    assert mix(no_docs).count() == 0
    empty = mix(odd_docs.where("text is null or trim(text) = ''")).collect()
    assert empty and all(r.copies == 0 and r.target == 0 for r in empty)


def test_main_path_has_no_python(spark, sf):
    plan = op2_mix_sources(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
