"""CSV files by their headers: orders, missing and other columns, bad lines."""

import gzip

import pytest
from pyspark.sql import types as T

import oracle_check
from furrow.plans import ORACLE_SQL, QUERIES
from furrow.sources.csv_files import read_headers, rejected_counts, scan_csv_checked
from furrow.sources.tables import scan_csv

SCHEMA = T.StructType([T.StructField("YEAR", T.IntegerType()), T.StructField("VALUE", T.StringType()), T.StructField("LOC", T.StringType())])


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "d").mkdir()
    texts = {"a.csv": "YEAR,VALUE,LOC\n1990,5,X\n1991,\"1,200\",\"A \"\"b\"\"\"\n",
             "b.csv": "LOC,YEAR,VALUE\nY,1991,6\nZ,1992,7,8\nonly\n",
             "d/c [1].csv": "﻿ VALUE , YEAR\n9,1993\n10,nineteen\n",
             "d/e.csv": "Year,note,LOC,YEAR,LOC\n1,n,Q,1994,other\n",
             "d/r.csv": "Year,LOC\n1995,R\n", "d/empty.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "d/g.csv.gz").write_bytes(gzip.compress(b"LOC,VALUE,YEAR\nG,1,1996\n"))
    return tmp_path


WANT = {(1990, "5", "X"), (1991, "1,200", 'A "b"'), (1991, "6", "Y"), (1993, "9", None), (1994, None, "Q"), (1995, None, "R"), (1996, "1", "G")}


def test_rows_provenance_and_rejected_lines(spark, files):
    scan = scan_csv_checked(spark, [f"{files}/*.csv", f"{files}/d"], SCHEMA, with_source=True, renames={"Year": "YEAR"})
    rows = scan.rows.collect()
    assert {(r.YEAR, r.VALUE, r.LOC) for r in rows} == WANT and len(rows) == len(WANT)
    assert {r.source_file.rsplit("/", 1)[1] for r in rows if r.LOC == "Y"} == {"b.csv"}
    assert {r.record for r in scan.rejected.collect()} == {"Z,1992,7,8", "only", "10,nineteen"}
    assert sorted(r.bad_rows for r in rejected_counts(scan).collect()) == [1, 2]


def test_a_line_is_bad_whatever_columns_are_taken(spark, files):
    scan = scan_csv_checked(spark, [f"{files}/b.csv", f"{files}/d/c*"], SCHEMA)
    assert scan.rows.count() == 2 and scan.rejected.count() == 3
    assert [r.VALUE for r in scan.rows.select("VALUE").orderBy("VALUE").collect()] == ["6", "9"]
    assert {r.LOC for r in scan.rows.select("LOC").collect()} == {"Y", None}


def test_headers_are_grouped(spark, files):
    (files / "a2.csv").write_text("YEAR , VALUE,LOC\n2000,1,W\n")
    groups = read_headers(spark, [f"{files}/*.csv"])
    assert {k: len(v) for k, v in groups.items()} == {("YEAR", "VALUE", "LOC"): 2, ("LOC", "YEAR", "VALUE"): 1}


def test_files_without_a_known_column_and_without_rows(spark, files):
    (files / "odd.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="odd.csv"):
        scan_csv(spark, f"{files}/odd.csv", SCHEMA)
    none = scan_csv_checked(spark, f"{files}/d/empty.csv", SCHEMA, with_source=True)
    assert none.rows.columns == ["YEAR", "VALUE", "LOC", "source_file"] and none.rows.count() == 0 and none.rejected.count() == 0


@pytest.mark.parametrize("name", ["csv_by_header", "csv_rejected", "csv_round_trip"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    r = oracle_check.compare(spark, oracle_check.duck(sf), name, QUERIES[name], ORACLE_SQL[name], sf)
    assert r["status"] == "OK" and "types" not in r, r
