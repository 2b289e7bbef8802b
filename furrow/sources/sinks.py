"""Sinks: tables (CSV/parquet, optionally partitioned), long metric tables,
and fitted coefficient tables / ML pipelines (save and load)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write a result table; large outputs are partitioned by period keys so
    readers can prune. CSV gets a header row."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def metrics_frame(spark: SparkSession, step: str, metrics: Mapping[str, float]) -> DataFrame:
    """A (step, metric, value) table from a small dict of run metrics."""
    rows = [(step, k, float(v) if v is not None else None) for k, v in metrics.items()]
    return spark.createDataFrame(rows, "step string, metric string, value double")


def to_long_metrics(df: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """Unpivot every numeric column of a per-key result into (keys, step,
    metric, value) rows - the long metrics sink format."""
    num = [f.name for f in df.schema.fields if f.name not in keys and f.dataType.typeName()
           in ("double", "float", "integer", "long", "short", "decimal")]
    return df.select(*keys, F.lit(step).alias("step"),
                     F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                         for c in num])).alias("_m")).select(*keys, "step", "_m.metric", "_m.value")


def save_coefficients(coefs: DataFrame, path: str) -> None:
    """A fitted model is its coefficient table (one row per series)."""
    coefs.write.mode("overwrite").parquet(path)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_pipeline(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
