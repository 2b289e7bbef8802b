"""Incremental period means equal the batch result; CSV scan/sink round trip."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from furrow.operators import clean as C
from furrow.operators import series as S
from furrow.sources.sinks import load_coefficients, save_coefficients, to_long_metrics, write_table
from furrow.sources.tables import RAW_SCHEMA, scan_csv
from furrow.streaming import read_period_means, stream_period_sums

ROWS = [
    ("T, one", 1, "GRAIN", "ALL CLASSES", "2015", "CROP YEAR", "ARKANSAS", "YIELD", "7000", "POUNDS PER ACRE"),
    ("T, one", 1, "GRAIN", "ALL CLASSES", "2015", "CROP YEAR", "ARKANSAS", "YIELD", "7200", "POUNDS PER ACRE"),
    ("T, one", 1, "GRAIN", "LONG GRAIN", "2016", "CROP YEAR", "LOUISIANA", " yield ", "n/a", "POUNDS PER ACRE"),
    ("T, two", 2, "GRAIN", "LONG GRAIN", "2016", "CROP YEAR", "LOUISIANA", "YIELD", " 6100.5 ", "POUNDS PER ACRE"),
    ("T, two", 2, "GRAIN", "LONG GRAIN", "2016", "CROP YEAR", "LOUISIANA", "AREA PLANTED", "1065", "THOUSAND ACRES"),
    ("T, two", 2, "GRAIN", "LONG GRAIN", None, "CROP YEAR", "LOUISIANA", "YIELD", "6000", "POUNDS PER ACRE"),
]


def test_csv_round_trip_with_quoted_commas(spark):
    d = tempfile.mkdtemp(prefix="furrow-test-")
    df = spark.createDataFrame(ROWS, RAW_SCHEMA)
    write_table(df, f"{d}/a", fmt="csv")
    write_table(df.limit(2), f"{d}/b", fmt="csv")
    back = scan_csv(spark, [f"{d}/a", f"{d}/b"], with_source=True)
    assert back.count() == 8
    assert back.where(F.col("TABLE_NAME") == "T, one").count() == 5
    assert back.select("source_file").distinct().count() >= 2


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="furrow-test-")
    df = spark.createDataFrame(ROWS, RAW_SCHEMA)
    src = f"{d}/src"
    os.makedirs(src)
    for i, chunk in enumerate([ROWS[:3], ROWS[3:]]):
        spark.createDataFrame(chunk, RAW_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{d}/stage{i}")
        for f in os.listdir(f"{d}/stage{i}"):
            if f.endswith(".parquet"):
                os.rename(f"{d}/stage{i}/{f}", f"{src}/{i}-{f}")
    q = stream_period_sums(spark, src, RAW_SCHEMA, f"{d}/sink", ["LOCATION_DESCRIPTION"], ["YEAR"],
                           checkpoint_location=f"{d}/ckpt")
    q.awaitTermination(120)
    got = {(r.LOCATION_DESCRIPTION, r.YEAR): r.VALUE
           for r in read_period_means(spark, f"{d}/sink", ["LOCATION_DESCRIPTION"], ["YEAR"]).collect()}
    batch = C.drop_null_keys(C.coerce_numeric(C.filter_unit(C.filter_statistic(df))))
    want = {(r.LOCATION_DESCRIPTION, r.YEAR): r.VALUE
            for r in S.mean_by_period(batch, ["YEAR"], ["VALUE"], ["LOCATION_DESCRIPTION"]).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_coefficient_sink_and_long_metrics(spark):
    d = tempfile.mkdtemp(prefix="furrow-test-")
    coefs = spark.createDataFrame([("A", 1.0, 2.0)], "k string, b0 double, w1 double")
    save_coefficients(coefs, f"{d}/m")
    assert load_coefficients(spark, f"{d}/m").first().w1 == 2.0
    long = to_long_metrics(coefs, ["k"], "fit").orderBy("metric").collect()
    assert [(r.metric, r.value) for r in long] == [("b0", 1.0), ("w1", 2.0)]


def test_pipeline_model_round_trip(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from furrow.sources.sinks import load_pipeline, save_pipeline
    d = tempfile.mkdtemp(prefix="furrow-test-")
    df = spark.createDataFrame([(float(x), 2.0 * x + 1.0) for x in range(10)], "x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             LinearRegression(labelCol="y", solver="normal")]).fit(df)
    save_pipeline(model, f"{d}/pipe")
    back = load_pipeline(f"{d}/pipe")
    pred = back.transform(df.limit(3)).select("y", "prediction").collect()
    assert all(abs(r.y - r.prediction) < 1e-6 for r in pred)
