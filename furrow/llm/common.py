"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.common import materialize

__all__ = ["WORD_SEP", "batches", "fresh", "lower_ascii", "materialize", "table", "words"]

#: Words are the runs of anything but these characters.
WORD_SEP = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEP), lambda w: w != "")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names match without case)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name = "_" + name
    return name


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about ``most_bytes`` (a row at least),
    so that flat arrays built from a piece stay small however long texts are."""
    for b in rows:
        start = 0
        while start < b.num_rows:
            n = max(1, min(b.num_rows - start, int(b.num_rows * most_bytes / max(1, b.nbytes)) or 1))
            piece = b.slice(start, n)
            while n > 1 and piece.nbytes > 2 * most_bytes:
                n = max(1, n // 2)
                piece = b.slice(start, n)
            yield piece
            start += n
