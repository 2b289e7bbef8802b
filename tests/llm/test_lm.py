"""Operator 3: base scores in a plain loop, lattices by direct summation."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from furrow.llm.lattice import Lattice
from furrow.llm.lm_scoring import score_texts
from furrow.llm.queries import op3_lattice_lm

WORDS = ["the", "thntbleea", "é", "🙂x", "a▁b", "=", "\x01", "x" * 60]


def _direct(lattice, vocab, logp, word):
    pieces = {p: i for i, p in enumerate(vocab.pieces) if vocab.kinds[i] == 1}
    s = "▁" + word
    a = [1.0] + [0.0] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 16), j):
            p = s[i:j]
            known = p in pieces and (p[0] == "▁" and p[1:2] != "▁" if i == 0 else "▁" not in p)
            if known:
                a[j] += a[i] * math.exp(logp[pieces[p]])
            elif j == i + 1 and i:
                a[j] += a[i] * math.exp(sum(logp[lattice.byte[b]] for b in p.encode()))
    return math.log10(a[-1] * math.exp(logp[-1]))


def test_lattice_sums_all_segmentations(vocab):
    lattice = Lattice(vocab)
    logp = lattice.from_scores()
    got = lattice.score(WORDS, logp)
    assert got == pytest.approx([_direct(lattice, vocab, logp, w) for w in WORDS])
    uses = lattice.expected(WORDS, logp)
    assert uses[-1] == len(WORDS) and uses[lattice.start].sum() == pytest.approx(len(WORDS))
    again = lattice.normalised(np.exp(logp) + uses)
    assert lattice.score(WORDS, again).sum() > got.sum()


def test_counts_and_base_score(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    words = {d["doc_id"]: d["text"].encode().lower().split() + [b" "] for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = op3_lattice_lm(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert math.isfinite(r.score) and r.score < 0


def test_whole_texts_by_plain_counting(spark, vocab):
    """score of whole texts: every word's segmentations summed in a plain loop,
    weights from two rounds of expected uses, counts from a dictionary."""
    texts = ["the cat the thing", "The thntbleea = x", "a b a", "", "thing é", "unseen the é words"]
    train = [True, True, True, True, False, False]
    bags = [t.lower().split() for t in texts]
    c = Counter(w for b, k in zip(bags, train) if k for w in b)
    lattice = Lattice(vocab)
    logp = lattice.from_scores()
    prior = np.exp(logp)
    for _ in range(2):
        logp = lattice.normalised(prior + lattice.expected(sorted(c), logp))
    words, distinct, ends = sum(c.values()), len(c), sum(train)
    ones, twos = (sum(n == k for n in c.values()) for k in (1, 2))
    discount = min(max(ones / (ones + 2 * twos), 0.05), 0.95)
    end = (ends + 1) / (words + ends + 2)

    def word(w):
        spelled = 10.0 ** _direct(lattice, vocab, logp, w)
        return math.log10((max(c[w] - discount, 0) + discount * distinct * spelled) / words) + math.log10(1 - end)

    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, train))], "i int, text string, k boolean")
    got = {r.i: r.score for r in score_texts(df, vocab, F.col("k")).collect()}
    for i, b in enumerate(bags):
        assert got[i] == pytest.approx(sum(map(word, b)) + math.log10(end), rel=1e-9)


def test_probabilities_of_words_add_up(spark, vocab):
    """One word more known makes its text likelier, and no score exceeds 0."""
    df = spark.createDataFrame([(1, "a b a b c", True), (2, "a", False), (3, "qqqzzz", False), (4, None, False)], "k long, text string, t boolean")
    got = {r.k: r for r in score_texts(df, vocab, F.col("t")).collect()}
    assert got[3].score < got[2].score < got[4].score < 0
    assert got[4].n_tokens == 1 and got[1].n_known == 6


def test_odd_rows(odd_docs, no_docs, vocab):
    rows = score_texts(odd_docs, vocab, F.col("doc_id") != 7).collect()
    assert len(rows) == odd_docs.count()
    assert "text" not in rows[0].asDict() and [c.lower() for c in rows[0].asDict()].count("score") == 1
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert math.isfinite(r.score)
    assert by[1][0] == by[1][1]
    assert by[2][0].n_tokens == by[3][0].n_tokens == 1 and by[2][0].score == by[3][0].score
    assert score_texts(no_docs, vocab, F.lit(True)).count() == 0
    none = score_texts(odd_docs, vocab, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.score < 0 for r in none)
