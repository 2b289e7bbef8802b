"""Token counts without ids (operator 10).

Each batch of documents is reduced to its distinct pre-tokens and a
(document, pre-token, frequency) table; pieces are counted once per distinct
pre-token, joined to the frequencies by the pre-token's code, and summed per
document. Both sides of that join are built inside the partition: the
frequency table is about as large as the text itself, so sending it through a
shuffle to meet a global count table would cost more than counting a
pre-token once in every partition that has it.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.bpe import Merger, Vocabulary
from furrow.llm.common import batches
from furrow.llm.sentencepiece_codec import PIECE_BYTES, _schema, _with

#: So many pre-tokens are known from batch to batch; beyond it all are forgotten.
KEPT = 150_000


def count_tokens(df: DataFrame, vocab: Vocabulary, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out`` (long), the number of pieces of each whole text.

    Null and empty texts count 0. Rows are independent; other columns pass
    through, and a column already named ``out`` is replaced.
    """

    def run(rows):
        merger = Merger(vocab)
        known, pieces = defaultdict(), np.zeros(0, np.int64)
        known.default_factory = known.__len__
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                if len(known) > KEPT:
                    known.clear()
                    pieces = np.zeros(0, np.int64)
                codes, per_doc = [], []
                for t in piece.column(text).to_pylist():
                    ws = merger.split(t) if t else []
                    per_doc.append(len(ws))
                    codes.extend(map(known.__getitem__, ws))
                # pieces of each distinct pre-token, once
                if len(known) > len(pieces):
                    fresh = list(known)[len(pieces):]
                    pieces = np.r_[pieces, merger.count_words(fresh)]
                # frequencies by (document, pre-token), joined and summed
                doc = np.repeat(np.arange(len(per_doc)), per_doc)
                pair, freq = np.unique((doc << 32) | np.asarray(codes, np.int64), return_counts=True)
                total = np.bincount(pair >> 32, weights=freq * pieces[pair & 0xFFFFFFFF], minlength=len(per_doc))
                yield _with(piece, out, pa.array(total.astype(np.int64)))

    return df.mapInArrow(run, _schema(df, out, T.LongType()))
