"""Incremental period means over a growing folder of long-format files.

The same cleaning rules and mean-by-period as the batch path, run with
Structured Streaming: a file source (explicit schema) feeds the stateless
row steps; every micro-batch writes its partial sums and counts per
(series, period) into its own ``batch_id=`` folder (overwritten on replay,
so a retried batch is idempotent); readers combine the partials. No
long-lived aggregation state is kept in the stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.clean import coerce_numeric, drop_null_keys, filter_statistic, filter_unit
from furrow.session import ensure_checkpoint_dir


def stream_period_sums(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                       keys: Sequence[str], period_cols: Sequence[str], fmt: str = "parquet",
                       checkpoint_location: str | None = None, statistic: str = "YIELD",
                       available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``. Its state lives in a
    folder of its own per sink unless one is named."""
    keys, period_cols = list(keys), list(period_cols)
    checkpoint_location = checkpoint_location or f"{ensure_checkpoint_dir(spark).rstrip('/')}/furrow-stream/{zlib.crc32(sink_dir.rstrip('/').encode()):08x}"
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = reader.format(fmt).load(source_dir)
    rows = drop_null_keys(coerce_numeric(filter_unit(filter_statistic(rows, statistic))))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*keys, *period_cols).agg(F.sum("VALUE").alias("value_sum"),
                                                       F.count("VALUE").alias("value_count"))
        part.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch_id={batch_id}")

    w = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_period_means(spark: SparkSession, sink_dir: str, keys: Sequence[str],
                      period_cols: Sequence[str]) -> DataFrame:
    """Combine the per-batch partials into means per (series, period)."""
    parts = spark.read.parquet(sink_dir)
    return parts.groupBy(*keys, *period_cols).agg(
        (F.sum("value_sum") / F.sum("value_count")).alias("VALUE"))
