"""Pooled multi-feature models on all series rows.

Features: period index and the scaled companion statistics plus one
indicator per location and class; label: YIELD. A split by a hash of the keys
keeps 80 % of the rows for training. Models: least squares and ridge (alpha =
1 in the sum-of-squares convention) from the normal equations of the training
rows, gradient-boosted trees and a random forest by pyspark.ml. Metrics are
computed for all models in one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.common import attach, materialize
from furrow.operators.gram import normal_equations, predict, scaled, solve, spread

NUMERIC = ["period_idx", "AREA PLANTED", "AREA HARVESTED", "PRODUCTION"]
CATEGORICAL = ["LOCATION_DESCRIPTION", "CLASS_DESCRIPTION"]
KEYS = [*CATEGORICAL, "YEAR", "MONTH"]
LABEL = "YIELD"
SEED = 42


def hash_split(df: DataFrame, cols: Sequence[str], pct: int = 80) -> DataFrame:
    """Add ``is_train``, true for about ``pct`` percent of the keys: those whose
    first 8 hex digits of the md5 of the keys' texts, joined by |, leave a
    remainder below ``pct`` by 100. Null keys are left out of the text."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols])), 1, 8)
    return df.withColumn("is_train", F.conv(digits, 16, 10).cast("long") % 100 < pct)


def complete() -> Column:
    """Whether a row has every feature and the label."""
    ok = F.lit(True)
    for c in [*KEYS, *NUMERIC, LABEL]:
        ok = ok & F.col(f"`{c}`").isNotNull()
    return ok


def split_counts(pivoted: DataFrame) -> DataFrame:
    """Rows for training and testing per location, and those left out because a
    feature or the label is missing."""
    d = hash_split(pivoted, KEYS)
    count = lambda c: F.count(F.when(c, 1))
    return d.groupBy(CATEGORICAL[0]).agg(count(complete() & F.col("is_train")).alias("n_train"), count(complete() & ~F.col("is_train")).alias("n_test"),
                                         count(~complete()).alias("n_incomplete"))


def training_equations(pivoted: DataFrame) -> DataFrame:
    """The normal equations of the pooled linear models."""
    train = hash_split(pivoted.where(complete()), KEYS).where("is_train")
    return normal_equations(train, [*NUMERIC, LABEL], CATEGORICAL, spread(train, [*NUMERIC, LABEL]))


def pooled_model_comparison(pivoted: DataFrame, ridge_alpha: float = 1.0) -> DataFrame:
    """n_test, rmse, mae and r2 of each model on the test rows, with the numbers
    of training rows and of rows left out as incomplete."""
    rows = hash_split(pivoted.select(*KEYS, *NUMERIC, LABEL), KEYS).withColumn("complete", complete())
    # in a fixed order, which the trees' samples depend on
    parts = int(pivoted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartition(parts, *KEYS).sortWithinPartitions(*KEYS), "pooled-rows")
    counts = rows.agg(F.count(F.when(F.col("complete") & F.col("is_train"), 1)).alias("n_train"), F.count(F.when(~F.col("complete"), 1)).alias("n_incomplete"))
    d = rows.where("complete")
    train, test = d.where("is_train"), d.where(~F.col("is_train"))
    by = spread(train, [*NUMERIC, LABEL])
    equations = materialize(normal_equations(train, [*NUMERIC, LABEL], CATEGORICAL, by), "normal-equations")
    weights = solve(equations, LABEL, {"LinearRegression": 0.0, "Ridge_alpha1": ridge_alpha})
    linear = predict(test, NUMERIC, CATEGORICAL, LABEL, by, weights)
    preds = linear.select(F.col(LABEL).alias("y"), F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("y_hat")) for m in weights])))
    preds = preds.select("model", "y", "y_hat")

    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep") for c in CATEGORICAL]
    ohe = OneHotEncoder(inputCols=[f"{c}_ix" for c in CATEGORICAL], outputCols=[f"{c}_oh" for c in CATEGORICAL],
                        dropLast=False, handleInvalid="keep")
    features = VectorAssembler(inputCols=[*(f"num_{i}" for i in range(len(NUMERIC))), *[f"{c}_oh" for c in CATEGORICAL]], outputCol="features")
    numbers = {f"num_{i}": scaled(c, by) for i, c in enumerate(NUMERIC)}
    tr, te = train.withColumns(numbers), test.withColumns(numbers)
    if not tr.isEmpty():
        prep = Pipeline(stages=[*idx, ohe, features]).fit(tr)
        tr, te = prep.transform(tr), prep.transform(te)
        trees = {"GradientBoosting": GBTRegressor(labelCol=LABEL, seed=SEED, maxIter=30, maxDepth=4),
                 "RandomForest": RandomForestRegressor(labelCol=LABEL, seed=SEED, numTrees=40, maxDepth=8)}
        for name, est in trees.items():
            preds = preds.unionByName(est.fit(tr).transform(te).select(F.lit(name).alias("model"), F.col(LABEL).alias("y"), F.col("prediction").alias("y_hat")))
    e = F.col("y") - F.col("y_hat")
    out = preds.groupBy("model").agg(F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                     F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"),
                                     (F.var_pop("y") * F.count("y")).alias("_sst"))
    return attach(out, counts).select("model", "n_train", "n_test", "n_incomplete", "rmse", "mae",
                                      F.when(F.col("_sst") != 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"))
