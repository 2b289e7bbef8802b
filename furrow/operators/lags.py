"""Lags within a series without a task that holds the whole series.

Rows are numbered by their place in the series, which is cut into blocks of
``BLOCK`` places. A block's last rows are copied to the next one as its halo,
so that every row finds the rows before it in its own block. A window then
holds one block and its halo, whatever the length of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.ranking import grouped_rank

#: Places of a block.
BLOCK = 4096


def with_lags(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], lags: int,
              block: int | None = None) -> DataFrame:
    """Add ``<column>_<l>`` for l = 1 to ``lags``: the column's value l rows
    before in the order of ``order`` within ``keys``; null where there is none.
    Rows that tie in ``order`` come in the order of the columns. ``__place``,
    ``__block`` and ``__own`` are reserved names."""
    keys, columns = list(keys), list(columns)
    block = max(block or BLOCK, lags)
    if not lags:
        return df
    placed = grouped_rank(df, list(dict.fromkeys([*order, *columns])), keys, "__place")
    own = F.floor(F.col("__place") / block)
    halo = F.col("__place") % block >= block - lags
    dealt = placed.withColumn("__block", F.explode(F.when(halo, F.array(own, own + 1)).otherwise(F.array(own))))
    before = Window.partitionBy(*keys, "__block").orderBy("__place")
    values = {f"{c}_{l}": F.lag(c, l).over(before) for c in columns for l in range(1, lags + 1)}
    mine = dealt.withColumn("__own", F.col("__block") == own).withColumns(values)
    return mine.where("__own").drop("__place", "__block", "__own")
