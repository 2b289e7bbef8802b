"""Operators 6 and 9 against brute force over all pairs."""

import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

import oracle_check
from furrow.llm.components import components
from furrow.llm.line_dedup import dedup_lines
from furrow.llm.minhash_forest import near_duplicates
from furrow.llm.queries import ORACLE_SQL, op6_minhash_forest, op9_line_dedup


def _set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def _groups(sets, percent=80):
    """Smallest id reachable by links, over all pairs."""
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_op6_equals_all_pairs(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    sets = {i: _set(t, 4) for i, t in docs.items()}
    want = _groups(sets)
    rows = op6_minhash_forest(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_large_groups_of_near_copies(spark):
    """Copies that link with one text only, beside copies that link with many."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    texts = {}
    for base in range(2):
        start = rng.choices(vocab, k=150)
        for k in range(150):
            t = list(start)
            for at in rng.sample(range(150), rng.randint(0, 6)):
                t[at] = rng.choice(vocab)
            texts[len(texts)] = " ".join(t)
    for _ in range(100):
        texts[len(texts)] = " ".join(rng.choices(vocab, k=rng.randint(1, 80)))
    ids = list(texts)
    rng.shuffle(ids)
    df = spark.createDataFrame([(ids[i], t) for i, t in texts.items()], "doc_id long, text string")
    want = _groups({ids[i]: _set(t, 4) for i, t in texts.items()})
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows_near(odd_docs, no_docs):
    rows = near_duplicates(odd_docs.withColumnRenamed("ids", "kept")).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [r.component_id for r in by[1]] == [1, 1] and by[5][0].component_id == 1 and not by[5][0].kept
    for i in (2, 3, 4):
        assert by[i][0].n_shingles == 0 and by[i][0].component_id == i and by[i][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert sorted(r.n_shingles for r in by[7]) == sorted(len(_set(r.text, 4)) for r in by[7])
    assert near_duplicates(no_docs).count() == 0


def test_op9_equals_its_sql(spark, sf):
    con = oracle_check.duck(sf)
    assert oracle_check.compare(spark, con, "op9", op9_line_dedup, ORACLE_SQL["op9_line_dedup"], sf)["status"] == "OK"


def _plain(rows, least=1):
    """Lines to remove, by comparing every line with all earlier ones."""
    seen, out = [], defaultdict(list)
    for i, t in sorted(rows):
        for k, line in enumerate(t.split("\n")):
            x = set(line.encode().split())
            if len(x) < least:
                continue
            if any(180 * len(x & y) >= 80 * (len(x) + len(y)) for y in seen):
                out[i].append(k)
            seen.append(x)
    return out


@pytest.mark.parametrize("bits", [10, 20])
def test_op9_equals_all_pairs(spark, bits):
    rng = random.Random(bits)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    base = [rng.choices(common, k=6) + rng.choices(rare, k=rng.randint(2, 8)) for _ in range(12)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(common, k=9)
            if rng.random() < 0.7:
                line[rng.randrange(len(line))] = rng.choice(rare)
            rng.shuffle(line)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    want = _plain(rows)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()
    assert {r.doc_id: r.removed for r in got} == {i: want[i] for i, _ in rows}
    for r in got:
        lines = dict(rows)[r.doc_id].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in want[r.doc_id])
        assert (r.n_lines, r.n_removed) == (len(lines), len(want[r.doc_id]))


def test_op9_minimum_of_words_is_the_callers(spark):
    """Short lines, and a long line of few words, against an earlier equal one."""
    short = ["Read more", "menu", "la la la la la la la", "a b c d"]
    rows = [(i, "\n".join([short[i % 4], "", " ", short[(i + 1) % 4], f"own{i}", "d c b a"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = set(), {}
    for i, text in rows:
        want[i] = []
        for k, line in enumerate(text.split("\n")):
            words = frozenset(line.split())
            if words and words in seen:
                want[i].append(k)
            seen.add(words)
    assert {r.doc_id: r.removed for r in dedup_lines(df).collect()} == want
    assert all(r.removed == [] for r in dedup_lines(df, min_words=5).collect())


def test_a_line_that_most_documents_share(spark):
    rows = [(i, f"the line that all of them have\nown{i} words{i} here{i}") for i in range(300)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == {i: [0] if i else [] for i in range(300)}


def test_odd_rows_lines(odd_docs, no_docs):
    rows = dedup_lines(odd_docs.withColumnRenamed("ids", "removed")).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [r.n_removed for r in by[1]] == [0, 0]
    assert by[2][0].text is None and by[2][0].n_lines == 0 and by[3][0].n_lines == 1 and by[4][0].text == " \t\n "
    assert by[5][0].text == "" and by[5][0].removed == [0]
    assert sorted(r.n_removed for r in by[7]) == [0, 1] and by[None][0].n_removed == 0
    assert len(by[6][0].text) > 200_000
    assert dedup_lines(no_docs).count() == 0


def test_op9_main_path_has_no_python(spark, sf):
    plan = op9_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
