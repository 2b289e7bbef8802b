"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component is named
    after its smallest node.

    Alternating large-star and small-star contractions, each a grouped minimum
    joined back to the edges, until the table no longer changes. Every round
    is written to the shared folder, so the plan stays short and lost
    executors only repeat one round. Only counts come to the driver.
    """
    links = materialize(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "cc-links")
    before = None
    while True:
        links = materialize(_star(_star(links, larger=True), larger=False), "cc-links")
        now = links.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    stars = links.selectExpr("b as node", "a as component")
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component")).distinct()


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Connect each node's larger neighbours (or its smaller ones and itself)
    to the smallest node beside it. Edges come in and go out as a < b."""
    both = links.selectExpr("a as u", "b as v").unionAll(links.selectExpr("b as u", "a as v")) if larger else links.selectExpr("b as u", "a as v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
    out = both.join(least, "u")
    out = out.where("v > u").selectExpr("m", "v") if larger else out.selectExpr("m", "v").unionAll(least.selectExpr("m", "u as v"))
    return out.where("m <> v").selectExpr("least(m, v) as a", "greatest(m, v) as b").distinct()
