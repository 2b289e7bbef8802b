"""Vector columns packed for numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import materialize

#: Packed queries are broadcast up to so many bytes; beyond that blocks meet
#: blocks without a broadcast.
BROADCAST_BYTES = 32 << 20


def usable(vector: Column, zero: bool = True) -> Column:
    """Not null, not empty, only finite components (and not all 0)."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False))
    return ok if zero else ok & F.exists(x, lambda v: v != 0)


def packed(df: DataFrame, id_col: str, vector: str, zero: bool = True) -> DataFrame:
    """(id long, dims int, v binary) of the rows that can be compared: the
    components as little-endian doubles. Rows with a null id take no part."""

    def run(rows):
        for b in rows:
            lists = b.column("v")
            size = np.diff(lists.offsets.to_numpy())
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            ends = np.r_[0, np.cumsum(size)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size.astype(np.int32)), pa.array([raw[a:e].tobytes() for a, e in zip(ends[:-1], ends[1:])], pa.binary())],
                names=["id", "dims", "v"])

    good = df.where(F.col(id_col).isNotNull() & usable(F.col(vector), zero))
    good = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return good.mapInArrow(run, "id long, dims int, v binary")


def matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dims)


def blocks(rows: DataFrame, size: int, names: tuple[str, str, str, str], extra: str | None = None) -> DataFrame:
    """Rows (id, dims, v[, extra double]) as blocks of up to ``size`` vectors of
    one length, cut inside the partitions: (ids, dims, matrix, extra)."""
    ids, dims, mat, more = names

    def run(parts):
        for pdf in parts:
            for d, same in pdf.groupby("dims"):
                for k in range(0, len(same), size):
                    cut = same.iloc[k:k + size]
                    rest = cut[extra].to_numpy("<f8").tobytes() if extra else b""
                    yield pd.DataFrame({ids: [cut["id"].to_numpy("<i8").tobytes()], dims: [d], mat: [b"".join(cut["v"])], more: [rest]})

    return rows.mapInPandas(run, f"{ids} binary, {dims} int, {mat} binary, {more} binary")


def query_blocks(queries: DataFrame, size: int, extra: str | None = None) -> DataFrame:
    """Queries dealt into full blocks: (qids, qdims, q, extra), ready to meet
    every block of candidates."""
    count, length = queries.agg(F.count("*"), F.coalesce(F.sum(F.length("v")), F.lit(0))).first()
    dealt = queries.repartition(max(1, -(-count // size)))
    out = materialize(blocks(dealt, size, ("qids", "qdims", "q", "extra"), extra), "query-blocks")
    return F.broadcast(out) if length <= BROADCAST_BYTES else out
