"""Operator 11 against the pattern itself, on whole texts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import fill_middle as fim
from furrow.llm.frames import Frames
from furrow.llm.queries import ORACLE_SQL, op11_fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(key, text):
    """n, form, prefix_chars, middle_chars, output of a text."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x85\xa0 abé日🙂<PSM>", max_size=40), st.integers(1, 9))
def test_frames_of_any_size(text, size):
    frames = Frames(size)
    raw = text.encode()
    fs = frames.write([raw[:0], text[:len(text) // 2].encode(), text[len(text) // 2:].encode()])
    units = UNIT.findall(text)
    assert b"".join(frames.read(fs)) == raw and (fs[-1]["units"] if fs else 0) == len(units)
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert frames.place(fs, k) == (len(head.encode()), len(head))
    for i in range(0, len(raw) + 1, 3):
        assert b"".join(frames.read(fs, i, i + 5)) == raw[i:i + 5]
    assert frames.find(fs, fim.MARKS) == {m: raw.find(m) for m in fim.MARKS if m in raw}


def check(rows, texts):
    assert len(rows) == len(texts)
    want = sorted((str((k, *plain(k, t)[:4], SHA(plain(k, t)[4]), SHA(t or ""))) for k, t in texts))
    assert sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256)) for r in rows) == want


def test_op11_over_a_table(spark, sf):
    import pyarrow.parquet as pq
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    rows = op11_fill_in_middle(spark, sf).collect()
    check(rows, docs)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", [5, 1000])
def test_odd_rows(odd_docs, no_docs, spark, size):
    more = [(k, t) for k in range(20, 60) for t in ("<", "a <P", "x<S>y", "b ", " \n", "<P<S <M", "> <M")]
    extra = spark.createDataFrame([(k, t, "", "", 0, "", 0.0) for k, t in more], odd_docs.schema)
    docs = odd_docs.where("doc_id is null or doc_id <> 6" if size < 10 else "true").unionByName(extra)
    made = fim.fill_in_middle(fim.store(docs, size=size), size=size)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "Score", "frames", "marked", "n", "form", "prefix_chars",
                            "middle_chars", "output"]
    check(fim.digests(made, size=size).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    for r in fim.texts(made.select("doc_id", "output", "text"), out="whole").collect():
        assert r.whole == plain(r.doc_id, r.text)[4]
    assert fim.digests(fim.fill_in_middle(fim.store(no_docs))).count() == 0


def test_columns_of_the_results_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b c", 9, "q", "z")], "doc_id long, text string, N int, Form string, frames string")
    made = fim.digests(fim.fill_in_middle(fim.store(df)))
    assert [c.lower() for c in made.columns].count("n") == 1 and made.first().form == plain(1, "a b c")[1]


def test_op11_against_its_sql(spark, sf):
    import oracle_check
    r = oracle_check.compare(spark, oracle_check.duck(sf), "op11", op11_fill_in_middle, ORACLE_SQL["op11_fill_in_middle"], sf)
    assert r["status"] == "OK" and "types" not in r, r
