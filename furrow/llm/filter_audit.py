"""Audit of how filters interact, over all orders of applying them
(operator 12).

A document's results are a set of failed filters, so a part of the table
comes down to counts per set: at most 2^k cells for k filters. Orders are the
paths through the lattice of sets of applied filters. An edge of the lattice,
a filter applied after a set of others, has its own counts (removed, kept,
redundant, lost) whatever the order inside the set; the number of orders
through it is the number of paths that reach its start times the number that
leave its end. Steps of single orders are read from the same edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import materialize, words
from furrow.llm.salting import hot_keys, salted_join

#: Filters of the registered audit, in the order of their bits.
LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, UPPER_SHARE = 50, 65, 5
SYMBOLS = r"[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of filters A to D on a whole text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    found = words(text)
    n, distinct = F.size(found), F.size(F.array_distinct(found))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < MIN_WORDS, "B": 100 * distinct < DISTINCT_SHARE * n, "C": 100 * upper > UPPER_SHARE * F.length(text),
            "D": text.rlike(SYMBOLS)}


def _bits(failures: Sequence[Column]) -> Column:
    total = F.lit(0)
    for i, failed in enumerate(failures):
        total = total + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    return total


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts ``n`` of documents per (part, fails, good, toxic): the bits of
    the failed filters A to E and whether a label says quality 1 or toxic 1.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and
    toxic. A null source is the empty part, a null text an empty one. Filter
    E fails a document whose text a smaller doc_id has as well, anywhere in
    the table; rows of one doc_id don't fail each other, and null ids are
    neither smaller nor larger than others. A doc_id with several labels is
    good, or toxic, if one of them says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"),
                       _bits(list(text_failures(F.col("text")).values())).alias("fails"))
    # rows of one id, part and text count once from here on
    rows = materialize(rows.groupBy("doc_id", "part", "key", "fails").agg(F.count("*").alias("n")), "audit-rows")
    marks = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
                  F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
             .where("good or toxic"))
    rows = salted_join(rows, marks, "doc_id", hot_keys(rows, "doc_id"), how="left")
    rows = rows.select("doc_id", "part", "key", "fails", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    # per text and part: the smallest id, and the rows that have it
    same = rows.groupBy("key", "fails", "part", "good", "toxic", "doc_id").agg(F.sum("n").alias("n"))
    same = same.groupBy("key", "fails", "part", "good", "toxic").agg(
        F.min("doc_id").alias("low"), F.sum("n").alias("n"), F.min_by("n", "doc_id").alias("n_low"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    same = materialize(same, "audit-texts")
    least = same.groupBy("key").agg(F.min("low").alias("least"), F.count("*").alias("cells")).where("cells > 1").drop("cells")
    same = salted_join(same, least, "key", hot_keys(same, "key"), how="left")
    # a text of one cell has its smallest id there
    first = F.when(F.col("low") == F.coalesce("least", "low"), F.col("n_low")).otherwise(0) + F.col("n_null")
    halves = F.array(F.struct(F.lit(0).alias("e"), first.alias("n")), F.struct(F.lit(1 << 4).alias("e"), (F.col("n") - first).alias("n")))
    cells = same.select("part", "fails", "good", "toxic", F.explode(halves).alias("h")).where("h.n > 0")
    return cells.groupBy("part", (F.col("fails") + F.col("h.e")).alias("fails"), "good", "toxic").agg(F.sum("h.n").alias("n"))


def lattice_edges(k: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(paths that reach the start, paths that leave the end) of every edge
    (applied set, filter) of the subset lattice of k filters."""
    forward, backward = [0] * (1 << k), [0] * (1 << k)
    forward[0] = backward[-1] = 1
    for s in range(1 << k):
        for f in range(k):
            if not s >> f & 1:
                forward[s | 1 << f] += forward[s]
    for s in reversed(range(1 << k)):
        for f in range(k):
            if not s >> f & 1:
                backward[s] += backward[s | 1 << f]
    return {(s, f): (forward[s], backward[s | 1 << f]) for s in range(1 << k) for f in range(k) if not s >> f & 1}


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, with long counts kept,
    removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    ``cells`` has part, fails (bits in the order of ``letters``), good, toxic
    and n. Every part with a row has all k! * k rows; the result of an empty
    table is empty. k! orders are listed, so k is meant to be small.
    """
    k = len(letters)
    spark = cells.sparkSession
    edges = lattice_edges(k)
    # one row per part from here on: at most 4 * 2^k cells, an edge each
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "good", "toxic", "n")).alias("cells"))
    lattice = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(fore * back).alias("orders"))
                        for (s, f), (fore, back) in edges.items()])

    def count(test) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(test(c), c["n"]).otherwise(F.lit(0)))

    def edge(e: Column) -> Column:
        reached = lambda c: c["fails"].bitwiseAND(e["s"]) == 0
        fails = lambda c: c["fails"].bitwiseAND(e["bit"]) != 0
        here = lambda c: reached(c) & fails(c)
        return F.struct(
            e["s"].alias("s"), e["f"].alias("f"), e["orders"].alias("orders"),
            count(lambda c: reached(c) & ~fails(c)).alias("kept"), count(here).alias("removed"),
            count(lambda c: fails(c) & ~reached(c)).alias("redundant"),
            count(lambda c: c["fails"] == e["bit"]).alias("unique_fails"),
            count(lambda c: here(c) & c["good"]).alias("good_lost"), count(lambda c: here(c) & c["toxic"]).alias("toxic_lost"))

    counted = parts.select("part", F.transform(lattice, edge).alias("edges"))
    shapley = F.transform(F.array(*map(F.lit, range(k))), lambda f: F.aggregate(
        "edges", F.lit(0).cast("long"), lambda a, e: a + F.when(e["f"] == f, e["orders"] * e["removed"]).otherwise(F.lit(0))))
    place = {edge_: i for i, edge_ in enumerate(edges)}
    steps = [(",".join(str(place[sum(1 << f for f in order[:i]), order[i]]) for i in range(k)), "".join(letters[f] for f in order))
             for order in permutations(range(k))]
    orders = spark.createDataFrame(steps, "path string, filter_order string")
    # the list of orders has k! rows whatever the tables hold
    out = counted.withColumn("shapley", shapley).crossJoin(F.broadcast(orders))
    out = out.select("part", "filter_order", "edges", "shapley", F.posexplode(F.split("path", ",")).alias("pos", "at"))
    out = out.select("part", "filter_order", (F.col("pos") + 1).alias("step"), F.get("edges", F.col("at").cast("int")).alias("e"), "shapley")
    return out.select("part", "filter_order", "step", *[F.col(f"e.{c}").alias(c) for c in
                      ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")],
                      F.get("shapley", F.col("e.f")).alias("shapley"))


#: The same rows in DuckDB's SQL: every document meets every order.
ORACLE = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
f AS (
  SELECT t.doc_id, part,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN t.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM t JOIN firsts USING (text)),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN marks USING (doc_id) GROUP BY ALL),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
seen AS (
  SELECT part, o, step, o[step] AS l, n, good, toxic, fails, contains(fails, o[step]) AS hit,
         length(translate(fails, o[1:step - 1], '')) < length(fails) AS earlier
  FROM cells, steps),
rows_ AS (
  SELECT part, o AS filter_order, step::INT AS step, l,
         coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (hit AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (hit AND earlier), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = l), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (hit AND NOT earlier AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (hit AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, o, step, l)
SELECT * EXCLUDE (l), (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM rows_
"""
