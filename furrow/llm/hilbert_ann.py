"""Approximate nearest neighbours by shifted space-filling curves (operator 7).

Every curve projects the vectors onto a few random directions, evens the
coordinates out and shifts them, and orders the vectors along a Hilbert curve.
Spark range-partitions each order; a query meets the vectors whose places are
within its window, curve by curve, and the candidates are merged and ranked by
their exact inner products.

The window is a share of the table, so recall depends on the data and not on
their number. Equal vectors are one entry with its smallest ids, which are all
that a result can need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import materialize
from furrow.llm.hilbert import hilbert_keys
from furrow.llm.vectors import matrix, packed

#: Curves, directions and bits of each, and the seed of the projections.
CURVES, DIRECTIONS, BITS, SEED = 12, 4, 12, 11
#: Places on each side of a query: this share of all, at least so many.
SHARE, LEAST = 0.06, 256
#: Vectors that the spread of the projections is taken from, about, shared by
#: the vector lengths; no length has a share below the second number.
SAMPLE, SAMPLE_LEAST = 20_000, 512
#: Places of a block, and asking rows that meet it in one task, about.
BLOCK, TILE = 4096, 4096


def _projections(dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directions (dims, DIRECTIONS) and shift of each curve."""
    rng = np.random.default_rng([SEED, dims])
    out = []
    for _ in range(CURVES):
        full, _r = np.linalg.qr(rng.normal(size=(max(dims, DIRECTIONS), DIRECTIONS)))
        out.append((full[:dims], rng.uniform(0, 0.25, DIRECTIONS)))
    return out


def _spread(rows: DataFrame) -> dict[int, np.ndarray]:
    """Quantiles (curve, direction, 257) of the projections by vector length,
    from a bounded sample of each, chosen by a hash of the vectors."""
    totals = {r.dims: r.n for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # vector lengths
    if not totals:
        return {}
    share = max(SAMPLE_LEAST, SAMPLE // len(totals))
    keep = F.create_map(*[F.lit(x) for d, n in totals.items() for x in (d, 1_000_000 if n <= share else max(1, 1_000_000 * share // n))])
    picked = F.pmod(F.xxhash64("v", F.lit(SEED)), F.lit(1_000_000)) < F.element_at(keep, F.col("dims"))
    got = rows.where(picked).select("dims", "v").toPandas()
    return {d: np.stack([np.quantile(matrix(same["v"], d) @ w, np.linspace(0, 1, 257), axis=0).T for w, _ in _projections(d)])
            for d, same in got.groupby("dims")}


def curve_orders(vectors: DataFrame) -> DataFrame:
    """(curve, pos, id, ids, dims, v): the place of every vector on every curve."""
    spread = _spread(vectors)

    def run(parts):
        for pdf in parts:
            for d, same in pdf.groupby("dims"):
                x, known = matrix(same["v"], d), spread.get(d)
                for c, (w, shift) in enumerate(_projections(d)):
                    y = x @ w
                    even = np.column_stack([np.interp(y[:, k], known[c, k], np.linspace(0, 1, 257)) if known is not None else np.zeros(len(y))
                                            for k in range(DIRECTIONS)])
                    grid = np.minimum((even + shift) / 1.25 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
                    yield pd.DataFrame({"curve": c, "key": hilbert_keys(grid, BITS), "id": same["id"], "ids": same["ids"], "dims": d, "v": same["v"]})

    keyed = vectors.mapInPandas(run, "curve int, key long, id long, ids array<long>, dims int, v binary")
    order = ["curve", "dims", "key", "id"]
    runs = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    runs = materialize(runs.drop("key"), "ann-runs").withColumn("part", F.shiftright("at", 33))
    # places count from 0 in every curve: rows of the parts before, less those
    # of the curves before
    counts = runs.groupBy("part", "curve", "dims").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = (counts.alias("a").join(counts.alias("b"), F.expr("b.curve = a.curve and b.dims = a.dims and b.part < a.part"), "left")
              .groupBy("a.part", "a.curve", "a.dims", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before")))
    before = before.select(F.col("part"), F.col("curve"), F.col("dims"), (F.col("before") - F.col("first")).alias("base"))
    return runs.join(F.broadcast(before), ["part", "curve", "dims"]).select(  # a row per part and curve
        "curve", (F.col("at") + F.col("base")).alias("pos"), "id", "ids", "dims", "v")


def nearest(df: DataFrame, k: int, is_query, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by
    largest inner product, ties to the smaller id; all candidates if fewer.

    Queries are the rows where ``is_query`` (an expression of the id column)
    holds; candidates are all rows of another id. Rows with a null id, and
    vectors that are null, empty, zero or hold null or non-finite components
    take no part; vectors of different lengths are not compared. Rows that
    repeat an id stand for one candidate with its best score. An empty table
    gives an empty table.
    """
    rows = materialize(packed(df, id_col, vector, zero=False).distinct(), "ann-rows")
    asked = is_query(F.col("id"))
    smallest = Window.partitionBy("v", "dims").orderBy("id")
    entries = rows.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    entries = entries.groupBy("v", "dims").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"))
    entries = materialize(entries.select("id", "ids", "dims", "v"), "ann-entries")
    queries = rows.where(asked).select(F.col("id").alias("query_id"), "v", "dims")
    sizes = {r.dims: max(LEAST, int(np.ceil(SHARE * r.n))) for r in entries.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # vector lengths
    places = materialize(curve_orders(entries), "ann-places")
    if not sizes:
        return places.selectExpr("id as query_id", "cast(0 as int) as rank", "id as vec_id", "cast(0 as double) as score")
    reach = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("dims")).cast("long")
    # an entry is asked for once, however many queries have its vector
    wanted = queries.select("v", "dims").distinct()
    asking = (places.join(wanted, ["v", "dims"], "left_semi").withColumn("reach", reach)
              .select("curve", "dims", F.explode(F.expr(f"sequence(greatest(pos - reach, 0) div {BLOCK}, (pos + reach) div {BLOCK})")).alias("block"), "pos", "reach", "id", "v"))
    blocks = places.select(F.col("curve").alias("curve2"), F.col("dims").alias("dims2"), F.expr(f"pos div {BLOCK}").alias("block2"),
                           F.col("pos").alias("pos2"), F.col("id").alias("id2"), F.col("v").alias("v2"))

    # the rows that ask a block are dealt into tiles, each with the whole block
    tiles = asking.groupBy("curve", "dims", "block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiles = materialize(tiles, "ann-tiles")
    asking = asking.join(tiles, ["curve", "dims", "block"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).drop("tiles")
    blocks = (blocks.join(tiles.toDF("curve2", "dims2", "block2", "tiles"), ["curve2", "dims2", "block2"])
              .withColumn("tile2", F.explode(F.expr("sequence(0, tiles - 1)"))).drop("tiles"))

    def rank(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return pd.DataFrame({"q": [], "c": [], "score": []}).astype({"q": "int64", "c": "int64"})
        dims = int(ask["dims"].iloc[0])
        have = have.sort_values("id2")
        x, cid, cpos = matrix(have["v2"], dims), have["id2"].to_numpy(), have["pos2"].to_numpy()
        out = []
        for at in range(0, len(ask), 256):
            part = ask.iloc[at:at + 256]
            q, pos, near = matrix(part["v"], dims), part["pos"].to_numpy(), part["reach"].to_numpy()
            score = np.where(np.abs(cpos[None, :] - pos[:, None]) <= near[:, None], q @ x.T, -np.inf)
            m = min(k + 1, len(cid))
            least = -np.partition(-score, m - 1, axis=1)[:, m - 1]
            for i, qid in enumerate(part["id"].to_numpy()):
                # products of rounding alike everywhere, among what may be best
                j = np.flatnonzero((score[i] >= least[i] - 1e-9 * abs(least[i])) & np.isfinite(score[i]))
                exact = (x[j] * q[i]).sum(1)
                best = np.lexsort((cid[j], -exact))[:k + 1]
                out.append((np.full(len(best), qid), cid[j][best], exact[best]))
        q, c, s = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"q": q, "c": c, "score": s})

    found = (asking.groupBy("curve", "dims", "block", "tile").cogroup(blocks.groupBy("curve2", "dims2", "block2", "tile2"))
             .applyInPandas(rank, "q long, c long, score double"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    found = found.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    # entries back to ids: each query id against the ids of its entry's best
    ids = entries.select(F.col("id").alias("c"), "ids")
    asks = queries.join(entries.select("v", "dims", F.col("id").alias("q")), ["v", "dims"]).select("query_id", "q")
    pairs = (asks.join(found.join(ids, "c"), "q").select("query_id", F.explode("ids").alias("vec_id"), "score")
             .where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
