"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import fresh

#: A key with more than one in so many rows is hot; so there are fewer than
#: this many hot keys, whatever the table.
SHARE = 64
#: Places over which the rows of a hot key are dealt.
SALTS = 64


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys that hold more than 1 / SHARE of all rows, fewer than SHARE of
    them; counted over all rows, combined before the shuffle. Null keys meet
    nothing in a join and are not listed."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    total = F.coalesce(F.sum("__n"), F.lit(0)).alias("__n")
    rows = counts.agg(total).first()["__n"]
    return [r[0] for r in counts.where((F.col("__n") > rows / SHARE) & F.col(key).isNotNull()).select(key).collect()]


def salted_join(df: DataFrame, keyed: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Join ``keyed``, one row per key, to ``df`` (inner or left). Rows of hot
    keys, and of null keys, are dealt over places by a hash of all their
    columns; ``keyed`` has its hot rows once per place."""
    salt = fresh(df, "__salt")
    places = F.array(*[F.lit(i) for i in range(SALTS)])
    dealt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    left = df.withColumn(salt, F.when(is_hot | F.col(key).isNull(), dealt).otherwise(F.lit(0)))
    right = keyed.withColumn(salt, F.explode(F.when(is_hot, places).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, salt], how).drop(salt)
