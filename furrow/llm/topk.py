"""Exact top-k search by a three-phase uniform threshold (operator 5).

A score is the sum of the partial scores of S slices of the components, each a
sorted list of its own. Phase 1 gathers, from every block of candidates, the
best entries of each list; their full scores give every query a safe cutoff t:
its k-th best score is at least t. Phase 2 sends the cutoffs back, and a block
collects the entries of at least t / S, which any candidate of score t or more
has in some list. Phase 3 drops entries whose unknown parts, below t / S each,
can't lift them to t, and resolves the rest exactly. A block returns its best
k per query, never more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import materialize
from furrow.llm.vectors import blocks, matrix, packed, query_blocks

#: Lists that a score is summed from; factor of the integer components.
SLICES, SCALE = 4, 256
#: Candidates of a block, and queries of a block.
CANDIDATES, QUERIES = 2048, 512


def _slices(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The partial scores of each slice, as whole numbers in doubles (exact
    below 2 ** 53)."""
    return [a @ b.T for a, b in zip(np.array_split(q, SLICES, axis=1), np.array_split(c, SLICES, axis=1))]


def _best(query: np.ndarray, cand: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows with the k best candidates of each query, the best row of each:
    highest score, then smallest id."""
    order = np.lexsort((-score, cand, query))
    q, c = query[order], cand[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])][:len(order)]]
    order = order[np.lexsort((cand[order], -score[order], query[order]))]
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]]
    nth = np.arange(len(q)) - np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(q)]))
    return order[nth < k]


def _frame(query, cand, score) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query, "vec_id": cand, "score": score.astype(np.int64)})


def _cells(rows: pd.DataFrame):
    """The queries' and candidates' ids and whole-number matrices of each cell
    (vectors of other lengths don't meet)."""
    for r in rows.itertuples(index=False):
        if r.dims == r.qdims:
            q = np.floor(SCALE * matrix([r.q], r.qdims))
            c = np.floor(SCALE * matrix([r.c], r.dims))
            yield np.frombuffer(r.qids, "<i8"), q, np.frombuffer(r.ids, "<i8"), c, np.frombuffer(r.extra, "<f8")


def top_k(df: DataFrame, k: int, is_query, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner
    products, ties to the smaller id; all candidates if fewer.

    Components x count as floor(256 * x). Queries are the rows where
    ``is_query`` holds; candidates are all rows of another id. Rows with a
    null id, and vectors that are null, empty or hold null or non-finite
    components take no part; vectors of different lengths are not compared.
    Rows that repeat an id stand for one candidate with its best score. Scores
    are exact below 2 ** 53. An empty table gives an empty table.
    """
    rows = packed(df, id_col, vector).distinct()
    # no more partitions than full blocks: every block returns k rows a query
    rows = rows.coalesce(max(1, -(-df.count() // CANDIDATES)))
    cand = materialize(blocks(rows, CANDIDATES, ("ids", "dims", "c", "none")).drop("none"), "topk-blocks")
    queries = materialize(packed(df.where(is_query), id_col, vector).distinct(), "topk-queries")

    def gather(parts):
        for pdf in parts:
            for qid, q, cid, c, _ in _cells(pdf):
                lists = _slices(q, c)
                total = sum(lists)
                at = np.argsort(cid)
                pick = np.zeros(total.shape, bool)
                # so many rows have k candidates beside the query itself
                m = min((k + 1) * int(np.unique(cid, return_counts=True)[1].max()), len(cid))
                for part in lists:
                    np.put_along_axis(pick, np.argpartition(-part, m - 1, axis=1)[:, :m], True, axis=1)
                pick &= qid[:, None] != cid[None, :]
                i, j = np.nonzero(pick[:, at])
                j = at[j]
                best = _best(qid[i], cid[j], total[i, j], k)
                yield _frame(qid[i][best], cid[j][best], total[i, j][best])

    def resolve(parts):
        for pdf in parts:
            for qid, q, cid, c, cut in _cells(pdf):
                lists, share = _slices(q, c), cut / SLICES
                known, missing = np.zeros((len(qid), len(cid))), np.full((len(qid), len(cid)), SLICES)
                for part in lists:
                    enough = part >= share[:, None]
                    known[enough] += part[enough]
                    missing -= enough
                # what is unknown lies below the share in every list
                unknown = np.where(missing > 0, missing * np.where(np.isfinite(share), share, 0)[:, None], 0.0)
                i, j = np.nonzero((missing < SLICES) & (known + unknown >= cut[:, None]) & (qid[:, None] != cid[None, :]))
                score = sum(part[i, j] for part in lists)
                ok = score >= cut[i]
                i, j, score = i[ok], j[ok], score[ok]
                best = _best(qid[i], cid[j], score, k)
                yield _frame(qid[i][best], cid[j][best], score[best])

    schema = "query_id long, vec_id long, score long"
    one = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = cand.crossJoin(query_blocks(queries, QUERIES)).mapInPandas(gather, schema)
    # a repeated id is one entry, so that the k-th is of the k-th candidate
    entries = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    cutoffs = (entries.withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= k).where(F.col("rank") == k)
               .select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("cut")))
    told = queries.join(cutoffs, "id", "left").withColumn("cut", F.coalesce("cut", F.lit(float("-inf"))))
    found = cand.crossJoin(query_blocks(told, QUERIES, "cut")).mapInPandas(resolve, schema)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(one).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
