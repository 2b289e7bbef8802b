"""Least squares over all rows of a table from its normal equations.

Products of the columns are summed per combination of categories by one
grouping with partial sums, and the cells of the matrix are sums over those
groups: rows never leave their tasks, and indicator columns are never built.
Only the matrix, as large as the square of the number of features, reaches
the driver, where it is solved once per model.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of the constant feature, and the most features that are solved for.
CONSTANT = "1"
MAX_FEATURES = 2000


def spread(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; 1 for a deviation of 0."""
    row = df.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(columns) for f in (F.avg, F.stddev_pop)]).first()
    return {c: (row[f"avg{i}"] or 0.0, row[f"stddev_pop{i}"] or 1.0) for i, c in enumerate(columns)}


def scaled(c: str, by: dict[str, tuple[float, float]]) -> Column:
    return (F.col(f"`{c}`").cast("double") - F.lit(by[c][0])) / F.lit(by[c][1])


def normal_equations(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], by: dict[str, tuple[float, float]]) -> DataFrame:
    """(a, b, value): the sum over the rows of the product of features a and b,
    for the constant, the scaled numbers and one indicator per category value
    (named column=value), in this order and a not after b. Products that no row
    has are left out. Rows with nulls are the caller's to drop."""
    numbers, categories = list(numbers), list(categories)
    dense = [CONSTANT, *numbers]
    value = {CONSTANT: F.lit(1.0), **{c: scaled(c, by) for c in numbers}}
    pairs = [(i, j) for i in range(len(dense)) for j in range(i, len(dense))]
    groups = df.groupBy(*categories).agg(*[F.sum(value[dense[i]] * value[dense[j]]).alias(f"_{i}_{j}") for i, j in pairs])
    name = {c: F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in categories}

    def cell(a: Column, b: Column, product: str) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), F.col(product).alias("value"))

    cells = [cell(F.lit(dense[i]), F.lit(dense[j]), f"_{i}_{j}") for i, j in pairs]
    cells += [cell(F.lit(d), name[c], f"_0_{i}") for c in categories for i, d in enumerate(dense)]
    cells += [cell(name[c], name[e], "_0_0") for k, c in enumerate(categories) for e in categories[k:]]
    return groups.select(F.inline(F.array(*cells))).groupBy("a", "b").agg(F.sum("value").alias("value"))


def solve(equations: DataFrame, label: str, penalties: dict[str, float]) -> dict[str, dict[str, float]]:
    """Weights by feature for each named penalty: those that make the squared
    error plus the penalty times the squared weights (the constant's apart)
    least, and of several the shortest."""
    features = [r.a for r in equations.select("a").unionAll(equations.select("b")).distinct().limit(MAX_FEATURES + 3).collect()]
    if len(features) > MAX_FEATURES + 2:
        raise ValueError(f"more than {MAX_FEATURES} features")
    if CONSTANT not in features:
        return {name: {} for name in penalties}
    names = sorted(x for x in features if x not in (CONSTANT, label))
    order = {x: i for i, x in enumerate([CONSTANT, label, *names])}
    m = np.zeros((len(order), len(order)))
    for a, b, value in equations.collect():  # at most the square of MAX_FEATURES + 2
        m[order[a], order[b]] = m[order[b], order[a]] = value
    mean = m[0] / m[0, 0]
    centred = m - m[0, 0] * np.outer(mean, mean)
    g, target = centred[2:, 2:], centred[2:, 1]
    out = {}
    for name, penalty in penalties.items():
        if penalty > 0:
            w = np.linalg.solve(g + penalty * np.eye(len(g)), target)
        else:
            w = np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ target
        out[name] = {CONSTANT: float(mean[1] - mean[2:] @ w), **dict(zip(names, map(float, w)))}
    return out


def predict(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], label: str, by: dict[str, tuple[float, float]],
            weights: dict[str, dict[str, float]]) -> DataFrame:
    """Add one column per model with its prediction. Category values without a
    weight count nothing. The tables of weights have at most ``MAX_FEATURES``
    rows and are broadcast."""
    models = list(weights)
    total = {m: F.lit(weights[m].get(CONSTANT, 0.0)) for m in models}
    for c in numbers:
        total = {m: total[m] + F.lit(weights[m].get(c, 0.0)) * scaled(c, by) for m in models}
    out = df
    schema = "__value string, " + ", ".join(f"__w{i} double" for i in range(len(models)))
    for k, c in enumerate(categories):
        start = f"{c}="
        values = sorted({f for m in models for f in weights[m] if f.startswith(start)})
        table = df.sparkSession.createDataFrame([(v[len(start):], *(weights[m].get(v, 0.0) for m in models)) for v in values], schema)
        table = F.broadcast(table.toDF(f"__value{k}", *(f"__w{k}_{i}" for i in range(len(models)))))
        out = out.join(table, F.col(c).cast("string") == F.col(f"__value{k}"), "left").drop(f"__value{k}")
        total = {m: total[m] + F.coalesce(F.col(f"__w{k}_{i}"), F.lit(0.0)) for i, m in enumerate(models)}
    mean, sd = by[label]
    out = out.withColumns({m: total[m] * F.lit(sd) + F.lit(mean) for m in models})
    return out.drop(*(f"__w{k}_{i}" for k in range(len(categories)) for i in range(len(models))))
