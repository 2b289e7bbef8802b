"""Quality classifier: a factorisation machine (operator 8).

Features are hashed words, hashed word shapes, structure statistics and size
classes of the text. Beside a weight every feature has a short vector, and two
features interact by the product of their vectors; with

    sum over pairs <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2

a text is scored in time linear in its features. The model is fitted on a
bounded sample of labelled rows, in one task, and scores whole texts inside the
partitions.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.common import batches
from furrow.llm.sentencepiece_codec import _schema, _with

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 8_000
#: Buckets of words and of word shapes, size classes, length of the vectors.
WORDS, SHAPES, SIZES, FACTORS = 1 << 15, 1 << 12, 32, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 128, 0.02, 1e-5, 7
PIECE_BYTES, KEPT = 2 << 20, 150_000

_RUNS = re.compile(rb"([A-Z]+)|([a-z]+)|([0-9]+)|([\x80-\xff]+)")
#: Classes of bytes: upper, lower, digit, space, line end, other ASCII, beyond.
_CLASS = np.full(256, 5)
for _c, _s in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 11, 12, 13, 32), (10,))):
    _CLASS[list(_s)] = _c
_CLASS[128:] = 6
STATISTICS = 17


def _shape(word: bytes) -> bytes:
    """A word with its runs of letters, digits and other signs shortened."""
    out = _RUNS.sub(lambda m: b"A" if m[1] else b"a" if m[2] else b"0" if m[3] else b"u", word)
    return re.sub(rb"(.)\1+", rb"\1\1", out)[:12]


class Features:
    """Sparse features of texts: (row, index, value) arrays."""

    size = WORDS + SHAPES + SIZES + STATISTICS

    def __init__(self):
        self._forget()

    def _forget(self):
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.word, self.shape = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.known) > KEPT:
            self._forget()
        raw = [(t or "").encode() for t in texts]
        codes, n_words, n_lines, once = [], [], [], []
        for r in raw:
            ws = r.split()
            codes.extend(map(self.known.__getitem__, ws))
            n_words.append(len(ws))
            lines = r.split(b"\n")
            n_lines.append(len(lines))
            once.append(len(set(lines)))
        fresh = list(self.known)[len(self.word):]
        self.word = np.r_[self.word, np.fromiter((zlib.crc32(w.lower()) % WORDS for w in fresh), np.int64, len(fresh))]
        self.shape = np.r_[self.shape, np.fromiter((zlib.crc32(_shape(w)) % SHAPES for w in fresh), np.int64, len(fresh))]
        n, n_words = len(raw), np.asarray(n_words)
        row = np.repeat(np.arange(n), n_words)
        code = np.asarray(codes, np.int64)

        def counted(index, width):
            key, tf = np.unique(row * width + index[code], return_counts=True)
            return key // width, key % width, tf.astype(float)

        r1, i1, tf1 = counted(self.word, WORDS)
        norm = np.sqrt(np.bincount(r1, weights=tf1 ** 2, minlength=n))
        r2, i2, tf2 = counted(self.shape, SHAPES)
        # statistics of bytes, words and lines
        flat = np.frombuffer(b"".join(raw), np.uint8)
        length = np.fromiter(map(len, raw), np.int64, n)
        kinds = np.bincount(np.repeat(np.arange(n), length) * 7 + _CLASS[flat], minlength=7 * n).reshape(n, 7)
        distinct, top = np.bincount(r1, minlength=n), np.zeros(n)
        np.maximum.at(top, r1, tf1)
        one = np.maximum(length, 1)
        w1 = np.maximum(n_words, 1)
        again = np.flatnonzero((code[1:] == code[:-1]) & (row[1:] == row[:-1]))
        n_lines, once = np.asarray(n_lines), np.asarray(once)
        stats = np.column_stack([
            4 * kinds / one[:, None], np.log1p(length) / 4, np.log1p(n_words) / 4, np.log1p(n_lines) / 2, distinct / w1, 2 * top / w1,
            once / n_lines, np.minimum(length / w1, 40) / 10, np.log1p(length / n_lines) / 4, np.ones(n),
            4 * np.bincount(row[again], minlength=n) / w1])
        size = np.minimum(np.log2(one).astype(np.int64), SIZES - 1)
        rows = np.r_[r1, r2, np.arange(n), np.repeat(np.arange(n), STATISTICS)]
        index = np.r_[i1, WORDS + i2, WORDS + SHAPES + size, WORDS + SHAPES + SIZES + np.tile(np.arange(STATISTICS), n)]
        value = np.r_[tf1 / norm[r1], 4 * tf2 / w1[r2], np.ones(n), stats.ravel()]
        return rows, index, value


@dataclass
class Machine:
    """bias, weights (features) and vectors (factors, features)."""

    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def raw(self, n: int, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the sums of the vectors."""
        y = self.bias + np.bincount(row, weights=self.weight[index] * value, minlength=n)
        sums = np.empty((len(self.vector), n))
        for f, v in enumerate(self.vector):
            vx = v[index] * value
            sums[f] = np.bincount(row, weights=vx, minlength=n)
            y += 0.5 * (sums[f] ** 2 - np.bincount(row, weights=vx * vx, minlength=n))
        return y, sums

    def probability(self, n, row, index, value) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(n, row, index, value)[0], -500, 500)))


def train(parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Fit by Adam on the logistic loss to (index, value) arrays, one pair a
    text. Without both labels the machine is the share of label 1 alone (one
    half without any row)."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    rng = np.random.default_rng(SEED)
    size = Features.size
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (FACTORS, size)))
    if len(np.unique(labels)) < 2:
        m.vector[:] = 0
        return m
    index, value = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    begin = np.r_[0, np.cumsum([len(i) for i, _ in parts])]
    params = np.vstack([m.weight, m.vector])
    m1, m2, step = np.zeros_like(params), np.zeros_like(params), 0
    bias = np.zeros(3)
    bias[0] = m.bias
    for epoch in range(EPOCHS):
        order = rng.permutation(len(parts))
        for k in range(0, len(order), BATCH):
            rows = order[k:k + BATCH]
            n_of = begin[rows + 1] - begin[rows]
            at = np.repeat(begin[rows] - np.r_[0, np.cumsum(n_of)[:-1]], n_of) + np.arange(n_of.sum())
            r, i, x = np.repeat(np.arange(len(rows)), n_of), index[at], value[at]
            now = Machine(bias[0], params[0], params[1:])
            y, sums = now.raw(len(rows), r, i, x)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[rows]) / len(rows)
            gx = g[r] * x
            grad = np.vstack([np.bincount(i, weights=gx, minlength=size)] +
                             [np.bincount(i, weights=gx * (sums[f][r] - now.vector[f][i] * x), minlength=size) for f in range(FACTORS)])
            grad += DECAY * params
            step += 1
            m1 += 0.1 * (grad - m1)
            m2 += 0.001 * (grad * grad - m2)
            rate = RATE * (1 - epoch / EPOCHS)
            params -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
            bias[0] -= rate * g.sum()
    return Machine(float(bias[0]), params[0].copy(), params[1:].copy())


def sampled(labelled: DataFrame, sample: int = SAMPLE, made=None) -> DataFrame:
    """The first ``sample`` of the labelled rows in the order of (hash of the
    key, hash of the text, label), which depends on the rows alone, as h, t,
    label, text. Rows with a null label are no labelled rows. ``made`` may turn
    the rows into others that keep h, t and label."""
    rows = labelled.where("label is not null").withColumn("h", F.xxhash64("key", F.lit(SEED)))
    total = rows.count()
    # the lowest hashes first: a filter on the key alone, before texts move
    share = 1.2 * (sample + 500) / max(1, total)
    while share < 1:
        low = rows.where(F.col("h") <= int(share * 2 ** 64) - 2 ** 63)
        if low.count() >= sample:
            rows = low
            break
        share *= 2
    rows = rows.select("h", F.coalesce("text", F.lit("")).alias("text"), "label").withColumn("t", F.xxhash64("text"))
    # features first, in all tasks: one task sorts and learns, of rows of bounded size
    return (made(rows) if made else rows).orderBy("h", "t", "label").limit(sample)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on labelled rows (key, text, label 0 or 1), at most ``sample`` of
    them (:func:`sampled`), so reruns agree. Features are made in the tasks,
    one task fits on the sample, and only the machine reaches the driver. Null
    texts count as empty."""

    def features(rows):
        made = Features()
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                row, index, value = made.of(piece.column("text").to_pylist())
                order = np.argsort(row, kind="stable")
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=piece.num_rows))].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[order].astype(k))) for v, k in ((index, np.int32), (value, np.float32))]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("h", "t", "label")] + lists, names=["h", "t", "label", "index", "value"])

    def learn(rows):
        parts, keys = [], []
        for b in rows:
            keys += zip(*(b.column(c).to_pylist() for c in ("h", "t", "label")))
            lists = [b.column(c) for c in ("index", "value")]
            parts += [tuple(x[k].values.to_numpy() for x in lists) for k in range(b.num_rows)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        machine = train([parts[k] for k in order], np.array([keys[k][2] for k in order]))
        yield pa.RecordBatch.from_arrays([pa.array([machine.bias]), pa.array([machine.weight.tobytes()]), pa.array([machine.vector.tobytes()])],
                                         names=["bias", "weight", "vector"])

    made = sampled(labelled, sample, lambda rows: rows.mapInArrow(features, "h long, t long, label double, index array<int>, value array<float>"))
    got = made.coalesce(1).mapInArrow(learn, "bias double, weight binary, vector binary").collect()
    if not got:  # no labelled row, no task
        return train([], np.zeros(0))
    return Machine(got[0].bias, np.frombuffer(got[0].weight), np.frombuffer(got[0].vector).reshape(FACTORS, Features.size))


def score(df: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability of label 1, of every whole text.

    Null texts score as empty ones. Rows are independent; other columns pass
    through, and a column already named ``out`` is replaced.
    """

    def run(rows):
        made = Features()
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                texts = piece.column(text).to_pylist()
                yield _with(piece, out, pa.array(machine.probability(len(texts), *made.of(texts))))

    return df.mapInArrow(run, _schema(df, out, T.DoubleType()))
