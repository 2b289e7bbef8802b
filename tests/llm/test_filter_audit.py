"""Operator 12 against a run of every order, document by document."""

import re
from collections import Counter
from itertools import permutations


from furrow.llm.filter_audit import LETTERS, document_cells, interactions, lattice_edges
from furrow.llm.queries import ORACLE_SQL, op12_filter_audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(docs, labels):
    """{(part, order, step): counts} of (doc_id, text, source) rows."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = set("A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)))
        return out | set("D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and least[t] < i))

    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(i, fails(i, t)) for i, t, s in docs if (s or "") == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [i for i, x in left if f in x]
                redundant = sum(f in x for _, x in mine) - len(gone)
                left = [(i, x) for i, x in left if f not in x]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x == {f} for _, x in mine),
                                                  sum(i in good for i in gone), sum(i in toxic for i in gone)]
                total[f] += len(gone)
        for key in out:
            if key[0] == part:
                out[key].append(total[key[1][key[2] - 1]])
    return out


def check(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert [r[c] for c in COUNTS] == want[r.part, r.filter_order, r.step], r


def test_edges_hold_every_order():
    for k in (1, 3, 5):
        edges, taken = lattice_edges(k), Counter()
        for order in permutations(range(k)):
            for i, f in enumerate(order):
                taken[sum(1 << g for g in order[:i]), f] += 1
        assert {e: a * b for e, (a, b) in edges.items()} == taken


def test_op12_over_a_table(spark, sf):
    import pyarrow.parquet as pq
    docs = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()]
    df = op12_filter_audit(spark, sf)
    assert dict(df.dtypes)["step"] == "int" and all(dict(df.dtypes)[c] == "bigint" for c in COUNTS)
    check(df.collect(), plain(docs, labels))


def test_odd_rows(odd_docs, no_docs, spark):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    shared = " ".join(f"w{i}" for i in range(60))
    rows += [(30 + i, shared, "a") for i in range(300)] + [(9, shared, "b"), (9, shared, "b"), (9, shared, "c"), (None, shared, None)]
    rows += [(400 + i, shared + " & A" * (i % 3) * 20, None) for i in range(9)] + [(1000, f"TEXT {i}", "b") for i in range(400)]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (30, 1, 1), (31, 1, None), (1000, 1, 1), (5, 0, 0), (77_777, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS `KEY`", "3 AS n", "4 AS fails")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS text", "5 AS n")
    check(interactions(document_cells(docs, marks), LETTERS).collect(), plain(rows, labels))
    assert interactions(document_cells(docs.limit(0), marks), LETTERS).count() == 0
    check(interactions(document_cells(docs, marks.limit(0)), LETTERS).collect(), plain(rows, []))


def test_op12_against_its_sql(spark, sf):
    import oracle_check
    r = oracle_check.compare(spark, oracle_check.duck(sf), "op12", op12_filter_audit, ORACLE_SQL["op12_filter_audit"], sf)
    assert r["status"] == "OK" and "types" not in r, r
