"""CSV files read by their own headers.

Files of one table may order their columns differently, lack some or have
others. Each file's header line is read once, files with the same header are
read together under their own column order, and the groups are united by
name. Lines that don't fit their header or the column types are set apart,
never shifted into other columns.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headers are read by so many threads, as many opens as there are files.
HEADER_THREADS = 16
_BAD = "__bad_record"


@dataclass
class CsvScan:
    """``rows`` under the wanted schema, and ``rejected`` (source_file, record),
    the lines that could not be read."""

    rows: DataFrame
    rejected: DataFrame


def read_headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files below the paths (folders, globs, compressed files), grouped by
    their column names without white space around them. Empty files have no
    header and are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def header(file: str):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")).readLine()
        finally:
            stream.close()
        if not line:
            return None
        names = next(csv.reader([line.removeprefix("﻿")]))
        if line.count('"') % 2:
            raise ValueError(f"line break inside the header of {file}")
        return tuple(n.strip() for n in names), re.sub(r"([\[\]{}*?\\])", r"\\\1", path.toString())

    groups = defaultdict(list)
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        for found in pool.map(header, sorted(spark.read.text(list(paths)).inputFiles())):
            if found:
                groups[found[0]].append(found[1])
    return dict(groups)


def _file_schema(names: Sequence[str], wanted: dict[str, T.DataType], renames: Mapping[str, str]) -> T.StructType:
    """The columns of a file in its order: wanted ones by name, others (and
    repeats of a name) as text under names of their own."""
    fields, have = [], set(names)
    for i, name in enumerate(names):
        other = renames.get(name)
        name = other if other and other not in have else name
        if name in wanted and name not in {f.name for f in fields}:
            fields.append(T.StructField(name, wanted[name]))
        else:
            fields.append(T.StructField(f"__other_{i}", T.StringType()))
    return T.StructType([*fields, T.StructField(_BAD, T.StringType())])


def scan_csv_checked(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, with_source: bool = False,
                     renames: Mapping[str, str] | None = None) -> CsvScan:
    """Read CSV files (quoted commas allowed) as one table under ``schema``.

    Columns are found by their header names, exactly; ``renames`` maps other
    spellings, used in files that lack the right one. A column that a file
    lacks is null in its rows, one that the schema lacks is left out, and a
    file with none of the schema's columns is an error. A line with too many or
    too few fields, or a value that its column's type can't hold, is rejected.
    ``with_source`` adds ``source_file``. Text stays as it is, ``VALUE`` columns
    are best read as text and coerced later.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    wanted = {f.name: f.dataType for f in schema.fields}
    rows, rejected = [], []
    for names, files in sorted(read_headers(spark, paths).items()):
        own = _file_schema(names, wanted, renames or {})
        if not wanted.keys() & {f.name for f in own}:
            raise ValueError(f"no column of the schema in {files[0]}: {', '.join(names)}")
        # every field is parsed, whatever columns a query takes, so that a line
        # is good or bad in itself
        raw = (spark.read.schema(own).option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
               .option("columnPruning", False).option("columnNameOfCorruptRecord", _BAD).csv(files))
        all_read = F.xxhash64(*[f.name for f in own if f.name != _BAD]) >= F.lit(-2 ** 63)
        raw = raw.select("*", F.col("_metadata.file_path").alias("source_file")).where(all_read)
        have = {f.name for f in own}
        rows.append(raw.where(F.col(_BAD).isNull()).select(
            *[(F.col(c) if c in have else F.lit(None).cast(k)).alias(c) for c, k in wanted.items()], *(["source_file"] if with_source else [])))
        rejected.append(raw.where(F.col(_BAD).isNotNull()).select("source_file", F.col(_BAD).alias("record")))
    if not rows:
        extra = [T.StructField("source_file", T.StringType())] if with_source else []
        return CsvScan(spark.createDataFrame([], T.StructType(schema.fields + extra)), spark.createDataFrame([], "source_file string, record string"))
    return CsvScan(reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, rejected))


def rejected_counts(scan: CsvScan) -> DataFrame:
    """Rejected lines per file, files without any left out."""
    return scan.rejected.groupBy("source_file").agg(F.count("*").alias("bad_rows"))
