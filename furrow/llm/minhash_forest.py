"""Near-duplicate documents by an LSH forest of MinHash signatures (operator 6).

Every text is a set of word shingles with a MinHash signature; equal sets are
one class from there on. A tree of the forest is one sorted order of the
signatures, each starting at another of their values. In a tree the
neighbours of a class with the longest common prefix stand beside it, so the
depth at which it is compared adapts to how crowded its region is: alone in a
sparse region down to the least depth, only with deeper matches in a crowded
one. The orders are range-partitioned and cut into blocks that overlap by the
window, so a group of copies of any size is spread over many tasks.

Neighbours whose signatures agree enough make candidate groups. The full sets
of a group are compared with each other, and the links are contracted to
connected components; neither step returns pairs, only enough edges to keep
what belongs together connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import batches, fresh, materialize
from furrow.llm.components import components
from furrow.llm.shingles import Shingler, mix64

#: Values of a signature, trees, and the first value of each tree's order.
VALUES, TREES = 64, 16
#: Least common prefix of two neighbours; two texts of similarity 0.8 miss it
#: in all 16 trees once in ten million.
LEAST_DEPTH = 2
#: Neighbours looked at on each side in a tree, and rows of a block.
WINDOW, BLOCK = 256, 4096
#: Neighbours belong to one candidate group if their share of equal values is
#: at most this far below the threshold (more than four standard deviations).
SLACK = 0.22
#: Classes of a bucket, and elements compared at once in a cell.
BUCKET, COLUMNS = 512, 4096
#: Documents to fetch are broadcast by id up to so many.
BROADCAST_ROWS = 500_000
PIECE_BYTES = 2 << 20


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, c1, c2, sig) of docs (id, text): number of shingles, a 128-bit
    name of the set, and the signature (64 little-endian 32-bit values)."""
    mult = mix64(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    def run(rows):
        shingler = Shingler(width)
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                sets = shingler.sets(piece.column("text").to_pylist())
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                sig = np.zeros((len(sets), VALUES), "<u4")
                full = np.flatnonzero(n)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.r_[0, np.cumsum(n[full])[:-1]]
                    for k in range(VALUES):
                        sig[full, k] = np.minimum.reduceat((flat * mult[k]) >> np.uint64(32), starts)
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                c = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(n), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["id", "n", "c1", "c2", "sig"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, c1 long, c2 long, sig binary")


def _rotated(sig, tree):
    """A tree's sort key: the signature's values from the tree's first one on."""
    start = tree * (4 * VALUES // TREES)
    return F.concat(F.substring(sig, start + 1, F.lit(4 * VALUES)), F.substring(sig, F.lit(1), start))


def ordered_blocks(classes: DataFrame) -> DataFrame:
    """(block, pos, c, key): each tree's order in overlapping blocks.

    Classes whose least prefix nobody shares in a tree don't enter it.
    """
    entries = classes.select("c", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    entries = entries.select("c", "tree", F.substring(_rotated(F.col("sig"), F.col("tree")), 1, 4 * LEAST_DEPTH).alias("head"))
    shared = entries.groupBy("tree", "head").agg(F.count("*").alias("many")).where("many > 1")
    inside = entries.join(shared, ["tree", "head"]).select("c", "tree")
    keyed = inside.join(classes.select("c", "sig"), "c").select("c", "tree", _rotated(F.col("sig"), F.col("tree")).alias("key"))
    order = ["tree", "key", "c"]
    runs = materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "forest-runs")
    runs = runs.withColumn("part", F.shiftright("at", 33))
    counts = runs.groupBy("part").count()
    offsets = (counts.alias("a").join(counts.alias("b"), F.col("b.part") < F.col("a.part"), "left")
               .groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before")))
    pos = F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")
    placed = runs.join(F.broadcast(offsets), "part").select("c", "tree", "key", pos.alias("pos"))  # a row per partition
    block = F.expr(f"pos div {BLOCK}")
    blocks = F.when(F.expr(f"pos % {BLOCK} < {WINDOW} and pos >= {BLOCK}"), F.array(block, block - 1)).otherwise(F.array(block))
    return placed.select("c", "tree", "key", "pos", F.explode(blocks).alias("block"))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that keep the connections of edges (i, j) of nodes below n: each
    node to the smallest one that it reaches."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, root[i], root[j])
        np.minimum.at(least, root[j], root[i])
        least = least[least[root]]
        if (least == root).all():
            break
        root = least
    away = np.flatnonzero(root != np.arange(n))
    return away, root[away]


def neighbours(blocks: DataFrame, least_share: float) -> DataFrame:
    """Edges (a, b) that connect, within each block, the classes whose
    signatures agree in enough values: of all such neighbours in the window, as
    many edges as it takes to keep them connected, so fewer than rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        c, tree = pdf["c"].to_numpy(), pdf["tree"].to_numpy()
        key = np.frombuffer(b"".join(pdf["key"]), "<u4").reshape(-1, VALUES)
        # a region: rows of one tree that share the least prefix
        new = np.r_[True, (tree[1:] != tree[:-1]) | (key[1:, :LEAST_DEPTH] != key[:-1, :LEAST_DEPTH]).any(1)]
        end = np.r_[np.flatnonzero(new)[1:], len(c)][np.cumsum(new) - 1]
        at = np.arange(len(c))
        left, right = [at[:0]], [at[:0]]
        for lag in range(1, WINDOW + 1):
            i = at[at + lag < end]
            if not len(i):
                break
            i = i[(key[i] == key[i + lag]).mean(1) >= least_share]
            left.append(i)
            right.append(i + lag)
        i, j = _forest(len(c), np.concatenate(left), np.concatenate(right))
        return pd.DataFrame({"a": c[i], "b": c[j]})

    return blocks.groupBy("block").applyInPandas(run, "a long, b long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of membership columns
    of the elements that several sets have."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    several = count[element] > 1
    column = (np.cumsum(count > 1) - 1)[element[several]]
    row = row[several]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[row[a:b], column[a:b] - first] = 1
        out += member @ member.T
    return out.astype(np.int64)


def confirm(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the classes of a candidate group (node,
    component) as their full sets (c, members) do.

    A group is compared whole. A larger one is dealt into buckets, and each
    pair of buckets is a cell; small groups share cells. A cell returns fewer
    links than it has rows.
    """
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BUCKET).alias("g"))
    many = max(1, groups.count() // BUCKET)
    dealt = groups.join(sizes, "component").select(F.col("node").alias("c"), "component", "g", F.expr("pmod(xxhash64(node), g)").alias("mine"))
    dealt = dealt.select("c", "component", "g", "mine", F.explode(F.expr("sequence(0, g - 1)")).alias("other"))
    # the cell of one bucket alone is left to those of two, if there are any
    dealt = dealt.where("g = 1 or g = 2 and other = 1 - mine or g > 2 and other <> mine")
    cell = F.when(F.col("g") == 1, F.pmod(F.xxhash64("component"), F.lit(many))).otherwise(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")))
    members = dealt.select("c", "component", cell.alias("cell")).join(sets, "c")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in pdf.groupby("component"):
            c = group["c"].to_numpy()
            have = [np.frombuffer(m, np.uint64) for m in group["members"]]
            n = np.fromiter(map(len, have), np.int64, len(have))
            common = _common(have)
            i, j = np.nonzero(np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1))
            i, j = _forest(len(c), i, j)
            found.append(pd.DataFrame({"a": c[i], "b": c[j]}))
        return pd.concat(found)

    return members.groupBy("cell").applyInPandas(run, "a long, b long")


def _sets(docs: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """(c, members) of the classes need (id, c1, c2, c): one row's set each."""

    def run(rows):
        shingler = Shingler(width)
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                sets = shingler.sets(piece.column("text").to_pylist())
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                c = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["c1", "c2", "members"])

    ids = need.select("id").distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    found = docs.alias("d").join(ids.alias("i"), F.col("d.id").eqNullSafe(F.col("i.id")), "left_semi").select("text")
    found = found.mapInArrow(run, "c1 long, c2 long, members binary")
    return found.join(need.select("c1", "c2", "c"), ["c1", "c2"]).groupBy("c").agg(F.first("members").alias("members"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """Add n_shingles, component_id and kept to every row.

    Rows are linked if 100 * intersection >= percent * union of their sets of
    ``width``-word shingles; ``component_id`` is the smallest id reachable by
    links, and ``kept`` marks the rows whose id it is. Null, empty and blank
    texts have an empty set and link with nothing. Rows with equal sets are
    always linked; rows that repeat an id are all kept or none. A null id is
    never the smallest beside another and is kept only where its group has no
    other. Other columns pass through; input columns named as an added one are
    replaced. An empty table gives an empty table.
    """
    added = ("n_shingles", "component_id", "kept")
    keep = [c for c in df.columns if c.lower() not in added]
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    signed = materialize(signatures(docs, width), "forest-signed")
    classes = (signed.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("id"), F.min("sig").alias("sig"))
               .withColumn("c", F.monotonically_increasing_id()))
    classes = materialize(classes, "forest-classes")
    near = materialize(neighbours(ordered_blocks(classes), percent / 100 - SLACK), "forest-near")
    candidates = materialize(components(near), "forest-candidates")
    need = materialize(classes.select("id", "c1", "c2", "c").join(candidates.select(F.col("node").alias("c")), "c"), "forest-need")
    sets = materialize(_sets(docs, need, width), "forest-sets")
    groups = components(confirm(candidates, sets, percent))
    named = classes.select("id", "c1", "c2", "c").join(groups.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    named = named.join(least, "component").select("c1", "c2", "least")
    # back to the rows: by id, and by set where rows share an id
    rows = signed.select("id", "n", "c1", "c2").distinct().join(named, ["c1", "c2"], "left")
    return _attach(df, keep, id_col, text, rows, width)


def _attach(df: DataFrame, keep: list[str], id_col: str, text: str, rows: DataFrame, width: int) -> DataFrame:
    rid, n, least = (fresh(df, f"__{x}") for x in ("id", "n", "least"))
    per_id = rows.groupBy("id").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 1
    if per_id == 1:
        rows = rows.select(F.col("id").alias(rid), F.col("n").alias(n), F.col("least").alias(least))
        out = df.join(rows, F.col(id_col).eqNullSafe(F.col(rid)))
    else:
        # ids repeat with different texts: find each row's set again
        key, k1, k2 = (fresh(df, f"__{x}") for x in ("key", "k1", "k2"))
        sets = signatures(df.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text).alias("h")).alias("id"), F.col(text).alias("text")), width).drop("sig").distinct()
        rows = (sets.join(rows.select(F.col("id").alias("j"), "c1", "c2", "least"), (F.col("id.i").eqNullSafe(F.col("j"))) & (sets.c1 == rows.c1) & (sets.c2 == rows.c2))
                .select(F.col("id.i").alias(rid), F.col("id.h").alias(key), F.col("n").alias(n), F.col("least").alias(least)))
        out = df.join(rows, F.col(id_col).eqNullSafe(F.col(rid)) & (F.xxhash64(text) == F.col(key)))
    own = F.when(F.col(n) == 0, F.col(id_col)).otherwise(F.col(least))
    return out.select(*keep, F.col(n).alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col(id_col)).alias("kept"))
