"""SentencePiece encoding and decoding over Spark partitions (operator 1).

Encoding runs the vectorised merge rounds of :mod:`furrow.llm.bpe` on the
distinct words of each Arrow batch; decoding gathers piece bytes. No shuffle:
a lost executor's partitions are simply read and encoded again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.bpe import Decoder, Merger, Vocabulary
from furrow.llm.common import batches

#: Bytes of Arrow rows that become flat symbol arrays at once.
PIECE_BYTES = 2 << 20


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one column added, or replaced under the same name."""
    names = [n for n in batch.schema.names if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [values], names=names + [name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def _encoder(vocab: Vocabulary, add_eos: bool):
    """texts -> (list array of ids)."""
    merger, eos = Merger(vocab), [vocab.eos] if add_eos else []

    def step(texts: list[str | None]) -> pa.ListArray:
        ids, n = merger.encode([t or "" for t in texts])
        ends = np.cumsum(n + len(eos))
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        if eos:
            last = np.zeros(len(flat), bool)
            last[ends - 1] = True
            flat[last] = eos[0]
            flat[~last] = ids
        else:
            flat[:] = ids
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))

    return step


def _decoder(vocab: Vocabulary):
    """List array of ids -> array of texts."""
    decoder = Decoder(vocab)

    def step(lists: pa.ListArray) -> pa.Array:
        lists = lists.fill_null([]) if lists.null_count else lists
        return pa.array(decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())), pa.string())

    return step


def encode(df: DataFrame, vocab: Vocabulary, text: str = "text", out: str = "ids", add_eos: bool = True) -> DataFrame:
    """Add ``out``, the ids (array<int>) of each whole text.

    Null and empty texts have the end id alone (no id without ``add_eos``).
    Rows are independent: repeated rows and ids give the same result each,
    other columns pass through, and a column already named ``out`` is
    replaced. An empty table gives an empty table.
    """

    def run(rows):
        step = _encoder(vocab, add_eos)
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                yield _with(piece, out, step(piece.column(text).to_pylist()))

    return df.mapInArrow(run, _schema(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text that each list of ids stands for.

    Null and empty lists give an empty text; ids that the vocabulary does not
    have raise an error. Other columns pass through, and a column already
    named ``out`` is replaced.
    """

    def run(rows):
        step = _decoder(vocab)
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                yield _with(piece, out, step(piece.column(ids)))

    return df.mapInArrow(run, _schema(df, out, T.StringType()))


def encode_and_decode(df: DataFrame, vocab: Vocabulary, text: str = "text", ids: str = "ids", decoded: str = "decoded", add_eos: bool = True) -> DataFrame:
    """:func:`encode`, then :func:`decode` of its ids, in one worker a task, so
    that ids don't go back and forth."""

    def run(rows):
        forth, back = _encoder(vocab, add_eos), _decoder(vocab)
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                coded = forth(piece.column(text).to_pylist())
                yield _with(_with(piece, ids, coded), decoded, back(coded))

    schema = _schema(df, ids, T.ArrayType(T.IntegerType()))
    fields = [f for f in schema.fields if f.name.lower() != decoded.lower()]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(decoded, T.StringType())]))
