"""Join helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps
from inspect import signature

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reserved_keys(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run an operator ``fn(df, ..., keys, ...)`` with its key columns under
    reserved names, in every frame that it gets, so that a key may have any
    name the operator uses inside. A result column named as a key (case
    aside) gets a trailing underscore."""
    sig = signature(fn)

    @wraps(fn)
    def run(*args, **kwargs):
        call = sig.bind(*args, **kwargs)
        call.apply_defaults()
        keys = list(call.arguments.get("keys") or ())
        if all(k.startswith("__key_") for k in keys):
            return fn(*args, **kwargs)
        free = (n for n in map("__key_{}".format, range(2 * len(keys))) if n not in keys)
        names = {k: k if k.startswith("__key_") else next(free) for k in keys}
        for name, value in call.arguments.items():
            if isinstance(value, DataFrame):
                call.arguments[name] = value.withColumnsRenamed({k: v for k, v in names.items() if k in value.columns})
        call.arguments["keys"] = list(names.values())
        out = fn(*call.args, **call.kwargs)
        taken = {k.lower() for k in keys}
        back = {v: k for k, v in names.items()}
        return out.toDF(*[back.get(c, c + "_" if c.lower() in taken else c) for c in out.columns])

    return run


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Attach per-key (or global) statistics to detail rows.

    With no keys the stats table is one row by construction, so it is
    broadcast and cross-joined. With keys it has one row per key; no hint
    is given: AQE turns it into a broadcast only when its runtime size is
    below the threshold and otherwise splits skewed key partitions. Keys
    are matched null-safely (null keys form a group, as in groupBy).
    """
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    renamed = stats
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = df.join(renamed, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return out
    return out.drop(*[f"__r_{k}" for k in keys])


#: Written size of a statistics table up to which it is broadcast. Parquet is
#: packed, so the rows in memory may be some ten times as large.
BROADCAST_BYTES = 8 << 20
#: A key with more than one in so many rows is hot; its rows go to as many places.
HOT = 64


def attach_checked(df: DataFrame, stats: DataFrame, keys: Sequence[str], name: str = "stats", how: str = "inner") -> DataFrame:
    """Attach one row of statistics per key without shuffling ``df`` where the
    statistics are small: they are written first, and broadcast if the written
    table has at most ``BROADCAST_BYTES``. A larger table is joined by key, with
    the rows of hot keys (fewer than ``HOT`` of them) dealt over places and
    their statistics copied to each. ``how`` is inner or left."""
    keys = list(keys)
    stats = materialize(stats, name)
    size = int(str(stats._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= BROADCAST_BYTES:
        return attach(df, F.broadcast(stats), keys, how)
    return _attach_salted(df, stats, keys, how)


def _attach_salted(df: DataFrame, stats: DataFrame, keys: list[str], how: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("__n") > total / HOT).select(*keys).collect()
    is_hot = F.lit(False)
    for row in hot:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.lit(row[k]))
        is_hot = is_hot | same
    dealt = df.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*df.columns), F.lit(HOT)).cast("int")).otherwise(F.lit(0)))
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))
    return attach(dealt, stats.withColumn("__salt", F.explode(places)), [*keys, "__salt"], how).drop("__salt")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the session's checkpoint folder and
    read it back.

    Used where one intermediate feeds several branches (statistics and the
    rows they are attached to): later passes read the written columns
    instead of re-running scans and joins, and the plan below is cut, so
    lost executors never force recomputation of the upstream stages. The
    folder comes from ``spark.checkpoint.dir`` (a shared location on a
    cluster); only local runs without it get a scratch folder.
    """
    import uuid

    from furrow.session import ensure_checkpoint_dir
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/furrow-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
