"""Operators 1 and 10 against the sentencepiece library."""

import hashlib
import random

import pytest

from furrow.llm.bpe import Decoder, Merger
from furrow.llm.queries import op1_sentencepiece, op10_token_counts
from furrow.llm.sentencepiece_codec import decode, encode, encode_and_decode
from furrow.llm.token_counts import count_tokens


def _texts(sp):
    rng = random.Random(5)
    bits = ["a", " ", "  ", "\n", "\t", "\r", "é", "日", "🙂", "\x00", "▁", "the", "ing", "aaaa", "====", "00", "(", "​", "ff"]
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(rng.choices(pieces, k=3)) for _ in range(4000)]
    return texts + ["", " ", "▁", "a" * 3000, " " * 700, "=-" * 500, "\n" * 40]


def test_merges_equal_the_library(vocab, sp):
    texts = _texts(sp)
    merger, decoder = Merger(vocab), Decoder(vocab)
    ids, n = merger.encode(texts)
    want = sp.encode(texts, num_threads=1)
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert decoder.decode(ids, n) == [sp.decode(w) for w in want]


def test_known_words_are_forgotten_without_a_trace(vocab, sp):
    merger = Merger(vocab)
    merger.KEPT = 3
    for t in ["a b c d e f", "f e d c b a g", "the end"]:
        assert merger.encode([t])[0].tolist() == sp.encode(t)


def test_op1_and_op10_over_a_table(spark, sf, sp):
    import pyarrow.parquet as pq
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = op1_sentencepiece(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = sp.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    for r in op10_token_counts(spark, sf).collect():
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_odd_rows(odd_docs, no_docs, vocab, sp):
    coded = decode(encode(odd_docs, vocab), vocab)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "Score", "ids", "decoded"]
    rows = coded.collect()
    assert encode_and_decode(odd_docs, vocab).columns == coded.columns and sorted(map(str, encode_and_decode(odd_docs, vocab).collect())) == sorted(map(str, rows))
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.ids == sp.encode(r.text or "", add_eos=True)
        assert r.decoded == sp.decode(r.ids)
    assert encode(odd_docs, vocab, add_eos=False).where("text is null").first().ids == []
    counted = count_tokens(odd_docs, vocab, out="n_chars").collect()
    assert sorted(r.n_chars for r in counted) == sorted(len(sp.encode(r.text or "")) for r in rows)
    assert encode(no_docs, vocab).count() == 0 and count_tokens(no_docs, vocab).count() == 0


def test_decode_null_and_empty_lists(spark, vocab):
    df = spark.createDataFrame([(1, None), (2, []), (3, [2])], "k int, ids array<int>")
    assert [r.decoded for r in decode(df, vocab).orderBy("k").collect()] == ["", "", ""]


def test_other_models_are_refused(tmp_path, vocab):
    import public_tokenizers

    from furrow.llm.bpe import Vocabulary
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    path = tmp_path / "m.model"
    path.write_bytes(data.replace(b"\x18\x02\x20\x80\xfa\x01", b"\x18\x01\x20\x80\xfa\x01", 1))
    with pytest.raises(ValueError):
        Vocabulary.read(str(path))
