"""Mixing sources to target weights by pivotal dependent rounding (operator 2).

A document of source s should be taken target(s) / size(s) times. The whole
part is given to every document; the fractional parts are rounded together:
two fractions are paired and word mass moves at random from one to the other
until one of them is 0 or 1, which keeps each document's expectation and the
source's expected words. What is left of a bucket of documents, one fraction,
goes on to the next level of a reduction tree, so a source's words miss their
target by less than one document however large or hot the source is.

DataFrame functions only: a bucket is folded by ``aggregate`` over an array of
at most a few hundred entries, and every level is a shuffle of its residuals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WORD_SEP, fresh, materialize

#: A source's target is at most so many times its size.
MOST_COPIES = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Documents (then residuals) folded together at each node of the tree.
FAN_IN = 64
#: Per-source tables are broadcast up to so many sources; beyond that they are
#: joined by a shuffle, whose hot partitions adaptive execution splits.
BROADCAST_ROWS = 100_000
_EPS = 1e-12


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SEP.replace("[", "[^"))), F.lit(0)).cast("long")


def ranked(sources: DataFrame, by: str) -> DataFrame:
    """Number the rows from 0 in the order of ``by``, nulls last.

    The rows are range-partitioned; only one count per partition is summed in
    a single task, never the rows.
    """
    order = F.col(by).asc_nulls_last()
    parts = (sources.repartitionByRange(order).sortWithinPartitions(order)
             .withColumn("at", F.monotonically_increasing_id()))
    parts = materialize(parts, "mix-sources")
    parts = parts.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    counts = parts.groupBy("part").count()
    before = counts.alias("a").join(counts.alias("b"), F.col("b.part") < F.col("a.part")).groupBy(F.col("a.part").alias("part")).agg(F.sum("b.count").alias("before"))
    return (parts.join(before, "part", "left")
            .withColumn("rank", F.col("at") + F.coalesce("before", F.lit(0)))
            .drop("part", "at", "before"))


def source_targets(items: DataFrame) -> DataFrame:
    """Columns source, source_size, target of items (source, size, m).

    Every source gets a share of all words by its weight; a target above
    ``MOST_COPIES`` times the source's size stops there and the excess is
    shared again until none is above. A pass is one aggregate over the table
    of sources, and the sources that stop only ever grow in number.
    """
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = materialize(ranked(sizes, "source").withColumn("weight", weight), "mix-weights")
    most = F.col("source_size") * float(MOST_COPIES)
    total, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    share, stopped = (total / free if total else 0.0), -1
    while total:
        over = F.col("weight") * share > most
        got = sources.agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first()
        if got[0] == stopped or not got[2]:
            break
        stopped, share = got[0], (total - (got[1] or 0.0)) / got[2]
    return sources.select("source", "source_size", F.least(F.col("weight") * share, most).alias("target"))


def _by_source(per_source: DataFrame) -> DataFrame:
    """A table of one row per source, ready to be joined to documents."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_ROWS else per_source


def _uniform(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / float(1 << 53)


def _fold(entries: Column, seed: int, level: int) -> Column:
    """Fold sorted (a, k, f) entries: struct of the residual and the rounded.

    a: words a copy adds, k: key, f: fraction. ``k``, ``a``, ``f`` of the
    result are the fraction left (f null if none), ``out`` the keys rounded
    with their values.
    """
    start = F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("f"),
                     F.array().cast("array<struct<k:bigint,up:int>>").alias("out"))

    def done(k, up):
        return F.struct(k.alias("k"), up.cast("int").alias("up"))

    def state(a, k, f, out):
        # a fraction that has become whole is rounded, not carried
        whole = (f < _EPS) | (f > 1 - _EPS)
        return F.struct(F.when(~whole, a).alias("a"), F.when(~whole, k).alias("k"), F.when(~whole, f).alias("f"),
                        F.when(whole, F.array_append(out, done(k, f > 0.5))).otherwise(out).alias("out"))

    def step(acc, x):
        rise, fall = acc.a * (1 - acc.f), acc.a * acc.f        # words to the carried entry's 1 and 0
        x_rise, x_fall = x.a * (1 - x.f), x.a * x.f
        to_carry, to_x = F.least(rise, x_fall), F.least(fall, x_rise)
        up = _uniform(F.lit(seed), F.lit(level), acc.k, x.k) * (to_carry + to_x) < to_x
        carried_ends = F.when(up, rise <= x_fall).otherwise(fall <= x_rise)
        keep_x = state(x.a, x.k, F.when(up, x.f - rise / x.a).otherwise(x.f + fall / x.a), F.array_append(acc.out, done(acc.k, up)))
        keep_carried = state(acc.a, acc.k, F.when(up, acc.f + x_fall / acc.a).otherwise(acc.f - x_rise / acc.a), F.array_append(acc.out, done(x.k, ~up)))
        return (F.when(acc.f.isNull(), F.struct(x.a.alias("a"), x.k.alias("k"), x.f.alias("f"), acc.out.alias("out")))
                .when(carried_ends, keep_x).otherwise(keep_carried))

    return F.aggregate(entries, start, step)


def _round(parts: DataFrame, counts: DataFrame, seed: int) -> DataFrame:
    """Round the fractions of parts (source_no, k, a, f): rows (k, up)."""
    nodes = parts.join(_by_source(counts), "source_no").withColumn(
        "node", F.pmod(F.xxhash64(F.lit(seed), "k"), F.ceil(F.col("n") / FAN_IN))).drop("n")
    most = counts.agg(F.max("n")).first()[0] or 0
    nodes_left, level, rounded = -(-most // FAN_IN), 0, []
    while True:
        folded = (nodes.groupBy("source_no", "node")
                  .agg(F.reverse(F.array_sort(F.collect_list(F.struct("a", "k", "f")))).alias("entries"))
                  .select("source_no", "node", _fold(F.col("entries"), seed, level).alias("s")))
        folded = materialize(folded.select("source_no", "node", "s.*"), f"mix-level{level}")
        rounded.append(folded.select(F.inline("out")))
        nodes = folded.where("f is not null").select("source_no", F.expr(f"node div {FAN_IN}").alias("node"), "k", "a", "f")
        if nodes_left <= 1:
            break
        nodes_left, level = -(-nodes_left // FAN_IN), level + 1
    # the last fraction of a source is drawn by itself
    rounded.append(nodes.select("k", (_uniform(F.lit(seed), F.lit("last"), F.col("k")) < F.col("f")).cast("int").alias("up")))
    out = rounded[0]
    for r in rounded[1:]:
        out = out.unionAll(r)
    return out


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """Add size, source_size, target and copies to every row.

    ``size`` is the row's words, ``copies`` how often the mix takes it (0 to
    ``MOST_COPIES``). Null texts have size 0, and rows without words are never
    taken; null sources form one source, last in order. Rows with the same id,
    text and source are one item whose copies are dealt evenly over them.
    Reruns agree: random numbers are hashes of the rows and ``seed``. Input
    columns named as an added one are replaced. An empty table gives an empty
    table.
    """
    added = ("size", "source_size", "target", "copies")
    keep = [c for c in df.columns if c.lower() not in added]
    key, n_words, nth = fresh(df, "__key"), fresh(df, "__size"), fresh(df, "__nth")
    keyed = df.withColumns({
        key: F.xxhash64(*[x for c in (id_col, text, source) for x in (F.col(c).isNull(), F.col(c))]), n_words: word_count(F.col(text))})
    items = materialize(
        keyed.groupBy(F.col(key).alias("k"), F.col(n_words).alias("size"), F.col(source).alias("source")).agg(F.count("*").alias("m")), "mix-items")
    targets = source_targets(items).withColumn("source_no", F.xxhash64(F.col("source").isNull(), "source"))
    targets = materialize(targets, "mix-targets")
    want = F.when(F.col("size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(0.0)
    items = (items.withColumn("source_no", F.xxhash64(F.col("source").isNull(), "source")).drop("source")
             .join(_by_source(targets.drop("source")), "source_no")
             .withColumn("want", want).withColumn("whole", F.floor(F.col("want") + _EPS)))
    items = items.withColumn("f", F.greatest(F.col("want") - F.col("whole"), F.lit(0.0)))
    parts = items.where(F.col("f") > _EPS).select("source_no", "k", F.col("size").alias("a"), "f")
    rounded = _round(parts, parts.groupBy("source_no").agg(F.count("*").alias("n")), seed)
    plan = (items.join(rounded, "k", "left")
            .select("k", "size", "m", "source_size", "target", (F.col("whole") + F.coalesce("up", F.lit(0))).alias("all_copies")))
    plan = materialize(plan, "mix-plan")
    names = {c: fresh(df, f"__mix_{c}") for c in plan.columns}
    plan = plan.toDF(*[names[c] for c in plan.columns])
    repeats = plan.agg(F.max(names["m"])).first()[0] or 1
    out = keyed.join(plan, (F.col(key) == F.col(names["k"])) & (F.col(n_words) == F.col(names["size"])))
    if repeats > 1:
        from pyspark.sql import Window
        out = out.withColumn(nth, F.row_number().over(Window.partitionBy(key, n_words).orderBy(F.col(key))) - 1)
    else:
        out = out.withColumn(nth, F.lit(0))
    share = F.expr(f"`{names['all_copies']}` div `{names['m']}`") + (F.col(nth) < F.expr(f"`{names['all_copies']}` % `{names['m']}`")).cast("long")
    return out.select(*keep, F.col(n_words).alias("size"), F.col(names["source_size"]).alias("source_size"),
                      F.col(names["target"]).alias("target"), share.cast("int").alias("copies"))
