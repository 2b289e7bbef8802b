"""Kept readers and derived inputs follow the files that they came from."""

import shutil

from furrow.plans import QUERIES
from furrow.sources.tables import fingerprint, read_table

SF = "/root/testdata/sf0.001"


def test_rewritten_table_gives_new_results(spark, tmp_path):
    for t in ("lineitem", "supplier", "nation", "part"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        (tmp_path / f"{t}.parquet").chmod(0o644)
    sf = str(tmp_path)
    rows, before = read_table(spark, sf, "nation").count(), QUERIES["trend_fit"](spark, sf).collect()
    assert read_table(spark, sf, "nation") is read_table(spark, sf, "nation")
    for t, keep in (("lineitem", "l_orderkey % 2 = 0"), ("nation", "n_nationkey > 0")):
        spark.read.parquet(f"{SF}/{t}.parquet").where(keep).coalesce(1).write.parquet(str(tmp_path / f"new-{t}"))
        shutil.copy(next((tmp_path / f"new-{t}").glob("part-*.parquet")), tmp_path / f"{t}.parquet")
    assert read_table(spark, sf, "nation").count() == rows - 1
    assert QUERIES["trend_fit"](spark, sf).collect() != before


def test_fingerprint_of_a_folder_sees_each_file(spark, tmp_path):
    spark.range(5).repartition(2).write.parquet(str(tmp_path / "t"))
    one = fingerprint(spark, str(tmp_path / "t"))
    assert fingerprint(spark, str(tmp_path / "t")) == one
    spark.range(5).write.mode("append").parquet(str(tmp_path / "t"))
    assert fingerprint(spark, str(tmp_path / "t")) != one
