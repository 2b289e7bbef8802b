"""Scans: parquet tables and CSV long-format files under one schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from furrow.sources.csv_files import scan_csv_checked

# The raw long-format statistics table. VALUE is read as text so that the
# cleaning chain owns number coercion (bad cells become null, not errors).
RAW_SCHEMA = T.StructType([
    T.StructField("TABLE_NAME", T.StringType()),
    T.StructField("TABLE_NUMBER", T.IntegerType()),
    T.StructField("COMMODITY_DESCRIPTION", T.StringType()),
    T.StructField("CLASS_DESCRIPTION", T.StringType()),
    T.StructField("YEAR", T.StringType()),
    T.StructField("REFERENCE_PERIOD_DESCRIPTION", T.StringType()),
    T.StructField("LOCATION_DESCRIPTION", T.StringType()),
    T.StructField("STATISTIC_DESCRIPTION", T.StringType()),
    T.StructField("VALUE", T.StringType()),
    T.StructField("UNIT_DESCRIPTION", T.StringType()),
])


_READERS: dict = {}


def fingerprint(spark: SparkSession, path: str) -> int:
    """A hash of the names, sizes and times of the files under ``path``: one
    listing, no data read. Rewriting, adding or removing a file changes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    files = []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(files)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; callers select columns so the scan is pruned.

    The reader (schema and file listing) is kept per session and path while
    the path's files stay as they are, so building many plans over the same
    table does not repeat footer reads.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key, files = (id(spark), path), fingerprint(spark, path)
    df, of = _READERS.get(key, (None, None))
    if df is None or df.sparkSession is not spark or of != files:
        df = spark.read.parquet(path)
        _READERS[key] = df, files
    return df


def scan_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = RAW_SCHEMA,
             with_source: bool = False) -> DataFrame:
    """The readable rows of CSV files from a path, glob or path list, as one
    table under one explicit schema (no inference pass over the data); columns
    are found by each file's own header. ``with_source`` adds the originating
    file path. :func:`furrow.sources.csv_files.scan_csv_checked` also gives the
    lines that could not be read.
    """
    return scan_csv_checked(spark, paths, schema, with_source).rows
