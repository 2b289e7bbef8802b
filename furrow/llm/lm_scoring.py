"""Language-model scores by subword lattice likelihood (operator 3).

A word's probability sums over all its segmentations into the pieces of an
existing vocabulary (:mod:`furrow.llm.lattice`), the whole word being one more
arc with its training count as score: with absolute discount D,

    P(w) = (max(c - D, 0) + D * V * lattice(w)) / N

for count c, V distinct and N training words. Piece weights start from the
vocabulary's scores and are re-estimated on all distinct training words. A
text is its words and one end; its score is the sum of their log10
probabilities.

Words are counted once over the whole corpus, scored once each, and joined to
the documents: the most frequent words are few and travel to the documents,
all others meet by a shuffle, in which no word can be frequent.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.bpe import Vocabulary
from furrow.llm.common import batches, fresh, materialize
from furrow.llm.lattice import Lattice

#: The end of a text among its words; no word can be a space.
END = " "
#: Passes of re-estimation of the piece weights.
PASSES = 2
#: Words that travel to the documents: at most so many, of so many bytes.
FREQUENT, FREQUENT_BYTES = 1 << 16, 64
PIECE_BYTES = 4 << 20


def text_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, every) of docs (train, text): occurrences in training texts
    and in all; the end of a text is a word too."""

    def run(rows):
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                flags = piece.column("train").to_numpy(zero_copy_only=False)
                texts = piece.column("text").to_pylist()
                seen, kept = Counter(), Counter()
                for t, f in zip(texts, flags):
                    (kept if f else seen).update(text_words(t))
                kept[END.encode()] = int(flags.sum())
                seen[END.encode()] = len(texts) - int(flags.sum())
                words = list(kept.keys() | seen.keys())
                c = np.fromiter((kept[w] for w in words), np.int64, len(words))
                every = c + np.fromiter((seen[w] for w in words), np.int64, len(words))
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(c), pa.array(every)], names=["word", "c", "every"])

    return (docs.select("train", "text").mapInArrow(run, "word string, c long, every long")
            .groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every")))


def train_pieces(words: DataFrame, vocab: Vocabulary, passes: int = PASSES) -> np.ndarray:
    """Log weights of the pieces, re-estimated on all distinct words."""
    lattice = Lattice(vocab)
    logp = lattice.from_scores()
    prior = np.exp(logp)

    def expect(rows):
        total = np.zeros(lattice.size)
        for b in rows:
            total += lattice.expected(b.column("word").to_pylist(), logp)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    for _ in range(passes):
        # one row per piece of the vocabulary at most
        uses = words.select("word").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        weight = prior.copy()
        for r in uses:
            weight[r.piece] += r.uses
        logp = lattice.normalised(weight)
    return logp


@dataclass
class Model:
    """Counts that every score uses."""

    tokens: int        # N, ends included
    distinct: int      # V, the end included
    ends: int
    discount: float

    def base(self, c: np.ndarray) -> np.ndarray:
        """Log10 of the add-one estimate."""
        return np.log10((c + 1) / float(self.tokens + self.distinct + 1))

    def score(self, c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """Log10 probability of words; of the end where ``lattice`` is NaN."""
        end = (self.ends + 1) / (self.tokens + 2)
        n, v, d = self.tokens - self.ends, self.distinct - (self.ends > 0), self.discount
        word = lattice
        if n:
            seen = np.maximum(c - d, 0) + d * v * np.power(10.0, lattice)
            word = np.where(c > 0, np.log10(np.maximum(seen, 1e-300) / n), np.log10(d * v / n) + lattice)
        return np.where(np.isnan(lattice), np.log10(end), np.log10(1 - end) + word)


def fit(counts: DataFrame) -> Model:
    """The corpus counts of a word table (word, c)."""
    known, end = F.col("c") > 0, F.col("word") == END
    n, v, ends, ones, twos = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(known), F.coalesce(F.sum(F.when(end, F.col("c"))), F.lit(0)),
        F.count_if((F.col("c") == 1) & ~end), F.count_if((F.col("c") == 2) & ~end)).first()
    discount = ones / (ones + 2 * twos) if ones else 0.5
    return Model(n, v, ends, min(max(discount, 0.05), 0.95))


def _frequent(words: DataFrame) -> list:
    """Rows of the most frequent short words, at most FREQUENT of them; every
    other short word occurs at most 1 / FREQUENT of the time."""
    step = F.floor(F.log2("every") * 8)
    short = words.where(F.octet_length("word") <= FREQUENT_BYTES)
    sizes = short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # a few hundred
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > FREQUENT:
            break
        least = r.step
    return short.where(step >= least).select("word", "c", "score").collect() if least is not None else []


def score_texts(df: DataFrame, vocab: Vocabulary, train: Column, text: str = "text") -> DataFrame:
    """Every column of the rows but the text, and n_tokens, n_known,
    train_tokens, base_score and score.

    ``train`` marks the rows to learn from (null: not). Null and empty texts
    are their end alone. With no training row the base score is 0 and words
    have their lattice probability. Repeated rows are scored each (and counted
    each in training). Input columns named as an added one are replaced. An
    empty table gives an empty table.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    carry = [f for f in df.schema.fields if f.name.lower() not in (*added, text.lower())]
    counts = materialize(count_words(df.select(F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))), "lm-counts")
    model = fit(counts)
    lattice, logp = Lattice(vocab), train_pieces(counts.where("c > 0").where(F.col("word") != END), vocab)

    def values(rows):
        for b in rows:
            words, c = b.column("word").to_pylist(), b.column("c").to_numpy()
            real = np.fromiter((w != END for w in words), bool, len(words))
            got = np.full(len(words), np.nan)
            got[real] = lattice.score([w for w in words if w != END], logp)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), b.column("every"), pa.array(model.score(c, got))], names=["word", "c", "every", "score"])

    words = materialize(counts.mapInArrow(values, "word string, c long, every long, score double"), "lm-words")
    frequent = _frequent(words)
    near = {r.word.encode(): i for i, r in enumerate(frequent)}
    near_c = np.asarray([r.c for r in frequent], np.int64)
    near_score = np.asarray([r.score for r in frequent], np.float64)
    near_base = model.base(near_c)

    # parts of a row: one with its columns and the sums over frequent words
    # (word null), and one for each other word
    rid, word, tf, known, base, total = names = [fresh(df, f"__{x}") for x in ("rid", "word", "tf", "known", "base", "total")]
    kinds = ["long", "string", "long", "long", "double", "double"]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    for f in carry:
        schema += f", `{f.name}` {f.dataType.simpleString()}"

    def split(rows):
        first = at = TaskContext.get().partitionId() << 33
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                first, codes, counted, sizes, far = at, [], [], [], []
                for t in piece.column(text).to_pylist():
                    freq = Counter(text_words(t))
                    freq[END.encode()] = 1
                    before = len(codes)
                    for w, n in freq.items():
                        i = near.get(w)
                        if i is None:
                            far.append((at, w, n))
                        else:
                            codes.append(i)
                            counted.append(n)
                    sizes.append(len(codes) - before)
                    at += 1
                row = np.repeat(np.arange(len(sizes)), sizes)
                i, n = np.asarray(codes, np.int64), np.asarray(counted, np.int64)
                add = lambda x: np.bincount(row, weights=n * x[i], minlength=len(sizes))
                head = [np.arange(first, at), None, add(np.ones_like(near_c)).astype(np.int64), add(near_c > 0).astype(np.int64), add(near_base), add(near_score)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) if x is not None else pa.nulls(len(sizes), pa.string()) for x in head] + [piece.column(f.name) for f in carry],
                    names=names + [f.name for f in carry])
                if far:
                    rest = [pa.array([x[0] for x in far]), pa.array([x[1].decode() for x in far], pa.string()), pa.array([x[2] for x in far])]
                    empty = [pa.nulls(len(far), t) for t in (pa.int64(), pa.float64(), pa.float64(), *(piece.column(f.name).type for f in carry))]
                    yield pa.RecordBatch.from_arrays(rest + empty, names=names + [f.name for f in carry])

    parts = materialize(df.select(text, *[f.name for f in carry]).mapInArrow(split, schema), "lm-parts")
    far = (parts.where(F.col(word).isNotNull()).select(rid, word, tf)
           .join(words.select(F.col("word").alias(word), F.col("c").alias(known), F.col("score").alias(total)), word)
           .select(rid, tf, known, total).repartition(rid))
    rid2, tf2, known2, base2, total2 = [x + "2" for x in (rid, tf, known, base, total)]
    far = far.groupBy(F.col(rid).alias(rid2)).agg(
        F.sum(tf).alias(tf2), F.sum(F.when(F.col(known) > 0, F.col(tf)).otherwise(0)).alias(known2),
        F.sum(F.col(tf) * F.log10((F.col(known) + 1) / F.lit(float(model.tokens + model.distinct + 1)))).alias(base2),
        F.sum(F.col(tf) * F.col(total)).alias(total2))
    out = parts.where(F.col(word).isNull()).join(far, F.col(rid) == F.col(rid2), "left")
    both = lambda x, y, zero: F.col(x) + F.coalesce(F.col(y), F.lit(zero))
    return out.select(*[f.name for f in carry], both(tf, tf2, 0).alias("n_tokens"), both(known, known2, 0).alias("n_known"),
                      F.lit(model.tokens).cast("long").alias("train_tokens"), both(base, base2, 0.0).alias("base_score"), both(total, total2, 0.0).alias("score"))
