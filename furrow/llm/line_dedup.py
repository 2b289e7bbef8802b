"""Near-duplicate lines by an exact set-similarity join (operator 9).

A line is the set of its distinct words. A line goes if an earlier line (by
document id, then place in the text) has a Jaccard similarity of ``percent`` /
100 or more with it, whether or not that earlier line stays. The join is
exact: words are ordered by rarity, only the rarest words of a set (its
prefix) are joined, the length, position and parity filters drop pairs that
cannot reach the threshold, and the rest are verified on the full sets.

DataFrame functions only. Rarity comes from a table of counters of fixed size
(words hashed into ``2 ** bits`` buckets, kept as one int each): any total
order of the words makes the prefix filter exact, so a collision costs time,
never a match. Equal sets meet once, however many lines have them. A word
whose group of sets is large is first matched against the group's earliest
set, one pair a row; only sets that this leaves unmatched are compared with
the other earlier sets of the group. The tests of pairs within a group grow
with its square; what is written and shuffled grows with the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WORD_SEP, fresh, materialize
from furrow.llm.salting import SHARE, salted_join

#: Lines with fewer distinct words are left alone. One takes every line that has
#: a word; a caller may set a higher minimum to spare short lines that repeat.
MIN_WORDS = 1
#: Similarity, as a percentage so that every bound is an exact integer.
PERCENT = 80
#: Counters of the rarity table: 2 ** BITS ints.
BITS = 20
#: Groups of one word above this size go through their earliest set first,
#: which costs their rows a second shuffle.
GROUP = 256
#: Words above which a set keeps 128 parity bits instead of 64.
LONG = 64
#: Removals, or lines to verify, are broadcast up to so many documents.
BROADCAST_ROWS = 200_000


#: A word's number has so many bits of its hash, its level of rarity above them.
HASH = 26
#: Blanks inside a line other than the space.
_ODD = r"[\t\x0B\x0C\r]"


def _words(line: Column, odd: Column) -> Column:
    """The words of a line. Where spaces alone part them (not odd) no pattern
    is needed, which takes a third of the time."""
    return F.array_remove(F.when(odd, F.split(line, WORD_SEP)).otherwise(F.split(line, " ")), "")


def _lines(docs: DataFrame) -> DataFrame:
    """docs (d, text) to (d, l, line, odd), odd if its text has blanks other
    than spaces."""
    lines = (docs.where("text is not null").select("d", "text", F.col("text").rlike(_ODD).alias("odd"))
             .select("d", "odd", F.posexplode(F.split("text", "\n")).alias("l", "line")))
    return lines.select("d", F.col("l").cast("long").alias("l"), "line", "odd")


def rarity(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row with the levels of 2 ** bits buckets of words, growing with the
    bucket's count: the lowest for at most one occurrence, then a step for
    every 50 percent, 64 levels. They are an array of ints that leave ``HASH``
    bits free, from the least int on. Blanks alone part words here: the last
    word of a line counts together with the first of the next."""
    segment = 1024
    spark = docs.sparkSession
    seen = docs.select(F.explode(F.split("text", " ")).alias("w"))
    counts = seen.groupBy(F.xxhash64("w").bitwiseAND((1 << bits) - 1).alias("b")).agg(F.count("*").alias("c"))
    every = spark.range(1 << bits).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("c"))
    level = F.when(F.col("c") < 2, 0).otherwise(F.least(F.lit(63), 1 + F.floor(F.log(F.col("c") / 2) / F.log(F.lit(1.5)))))
    packed = (counts.unionAll(every).groupBy("b").agg(F.sum("c").alias("c"))
              .groupBy((F.col("b") / segment).cast("long").alias("s"))
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("b", ((level - 32) * (1 << HASH)).cast("int").alias("v")))), lambda x: x.v).alias("vs")))
    every = F.array_sort(F.collect_list(F.struct("s", "vs")))
    return materialize(packed.agg(F.flatten(F.transform(every, lambda x: x.vs)).alias("levels")), "lines-rarity")


def _hashes(line: Column, odd: Column) -> Column:
    """The distinct words of a line as hashes of 64 bits."""
    return F.array_distinct(F.transform(_words(line, odd), lambda w: F.xxhash64(w)))


def _ordered(hashes: Column, table: Column, bits: int) -> Column:
    """Words, given by their hashes, as ints, rarest first: the level of
    rarity above ``HASH`` bits of the hash. table has the level of every
    bucket. Words that share a number count as copies of one, each with a place
    of its own: what sets have in common only seems more."""

    def number(word):
        # never null, so that the numbers are sorted as ints, not as objects
        level = F.coalesce(F.get(table, word.bitwiseAND((1 << bits) - 1).cast("int")), F.lit(0))
        return level.bitwiseOR(F.shiftright(word, 32).bitwiseAND((1 << HASH) - 1).cast("int"))

    return F.sort_array(F.transform(hashes, number))


def _prefixes(lines: DataFrame, levels: DataFrame, bits: int) -> DataFrame:
    """(d, l, s, n, parity, upper, prefix) of all lines; s names
    the set, parity counts its words in 64 classes, odd or even. Sets of more
    than ``LONG`` words have 128 classes: upper has the last 64, parity the
    first and the last folded together, so that any two sets compare. prefix has
    the numbers of its rarest words in order: a chance match is one candidate
    more."""
    # shiftleft takes the last 6 bits of the number alone
    odd = lambda one: F.aggregate("ordered", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", one(t), t)))
    lower, upper = odd(lambda t: F.lit(1).cast("long")), odd(lambda t: F.shiftright(t, 6).bitwiseAND(1).cast("long"))
    length = F.expr(f"cast(n - (n * {PERCENT} + 99) div 100 + 1 as int)")
    # the hashes pass an explode of one row each, or their expression would be
    # moved into the function over them, where finding the distinct ones takes
    # several times as long
    words = lines.select("d", "l", _hashes(F.col("line"), F.col("odd")).alias("found")).select("d", "l", F.explode(F.array("found")).alias("words"))
    # the levels are a subquery: as a literal they would stand in every plan. They
    # stand for themselves in the one expression that uses them, and in no row
    return (words.select("d", "l", "words", levels.scalar().alias("levels"))
            .select("d", "l", F.xxhash64(F.sort_array("words")).alias("s"), F.size("words").alias("n"), _ordered(F.col("words"), F.col("levels"), bits).alias("ordered"))
            .select("d", "l", "s", "n", lower.alias("parity"), F.when(F.col("n") > LONG, upper).otherwise(F.lit(0)).alias("upper"),
                    F.slice("ordered", F.lit(1), length).alias("prefix")))


#: Common words that sets of na and nb words need for the threshold.
_NEED = f"(({PERCENT} * (a.n + b.n) + {99 + PERCENT}) div {100 + PERCENT})"
#: What a pair with a common prefix word at places a.p and b.p can still reach:
#: sizes, the words left behind the places, and words in one set only: those
#: before the first common word, and one for every parity bit that differs (of
#: 128 if both sets are long). A pair is met at its first common word.
_FLIPPED = f"""if(a.n > {LONG} and b.n > {LONG}, bit_count(a.upper ^ b.upper) + bit_count(a.parity ^ a.upper ^ b.parity ^ b.upper),
    bit_count(a.parity ^ b.parity))"""
_MAY_MATCH = f"""100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
    and least(a.n - a.p, b.n - b.p) >= {_NEED}
    and a.p + b.p <= a.n + b.n - 2 * {_NEED}
    and {_FLIPPED} <= a.n + b.n - 2 * {_NEED}"""


#: Of two rows, a is the earlier line.
_EARLIER = "(a.d < b.d or a.d = b.d and a.l < b.l)"


def _pairs(a: DataFrame, b: DataFrame, extra: str) -> DataFrame:
    """(earlier set, later set) that share a prefix word and may match."""
    return (a.alias("a").join(b.alias("b"), F.expr(f"a.t = b.t and {extra} and {_MAY_MATCH}"))
            .selectExpr(f"{_EARLIER} as e", "a.d as ad", "a.l as al", "b.d as bd", "b.l as bl")
            .selectExpr("if(e, ad, bd) as d1", "if(e, al, bl) as l1", "if(e, bd, ad) as d2", "if(e, bl, al) as l2"))


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The later sets (d, l) of the pairs whose full sets reach the threshold."""
    pairs = materialize(pairs.distinct(), "lines-pairs")
    need = (pairs.selectExpr("d1 as nd", "l1 as nl").unionAll(pairs.selectExpr("d2", "l2")).distinct()
            .groupBy("nd").agg(F.collect_set("nl").alias("nls")))
    need = materialize(need, "lines-need")
    if need.count() <= BROADCAST_ROWS:
        need = F.broadcast(need)
    wanted = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("l"), x.alias("line"))), lambda x: F.array_contains("nls", x.l))
    sets = (docs.where("text is not null").join(need, F.col("d") == F.col("nd"))
            .select("d", F.inline(wanted))
            .select("d", "l", _hashes(F.col("line"), F.col("line").rlike(_ODD)).alias("tokens")))
    sets = materialize(sets, "lines-sets")
    one = sets.selectExpr("d as d1", "l as l1", "tokens as tokens1")
    two = sets.selectExpr("d as d2", "l as l2", "tokens as tokens2")
    common = F.size(F.array_intersect("tokens1", "tokens2"))
    return (pairs.join(one, ["d1", "l1"]).join(two, ["d2", "l2"])
            .where((100 + PERCENT) * common >= PERCENT * (F.size("tokens1") + F.size("tokens2")))
            .selectExpr("d2 as d", "l2 as l").distinct())


def repeated_lines(docs: DataFrame, bits: int = BITS, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, l) of the lines to remove from docs (d, text), d distinct longs."""
    # lines that take part are chosen as they are read: a filter before would
    # find the words of each line a second time
    lines = materialize(_prefixes(_lines(docs), rarity(docs, bits), bits), "lines").where(F.col("n") >= max(1, min_words))
    # all lines of a set but the first go, and the first if its set matches
    first = lines.groupBy("s").agg(F.count("*").alias("many"), F.min(F.struct("d", "l")).alias("first"))
    first = materialize(first.where("many > 1"), "lines-first")
    # a line that very many documents share is one set: its rows are salted
    shared = [r.s for r in first.where(F.col("many") > lines.count() / SHARE).collect()]
    first = first.drop("many").hint("shuffle_hash")
    sets = salted_join(lines, first, "s", shared, "left").where("first is null or struct(d, l) = first")
    columns = ("t", "d", "l", "n", "parity", "upper", "p")
    # the filter that a join on t would add, so that all uses share one shuffle
    entries = (sets.select("d", "l", "n", "parity", "upper", F.posexplode("prefix").alias("p", "t"))
               .where("t is not null").select(*columns).repartition("t"))
    # large groups; the hash over all columns is there to count in that shuffle too
    hot = (entries.groupBy("t").agg(F.count("*").alias("many"), F.max(F.xxhash64(*columns)).alias("some"))
           .where(f"many > {GROUP} or some is null").select(F.col("t").alias("hot")))
    marked = entries.join(hot.hint("shuffle_hash"), F.col("t") == F.col("hot"), "left")
    # small groups: every pair, the smaller set at one of its first places; rows of
    # large groups are written as they are, in the same job. The places are chosen
    # with hot in the condition, or they would be chosen before the shuffle
    few = F.expr(f"case when hot is null then n - p >= ({2 * PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT} else false end")
    large = marked.where("hot is not null")
    pairs = _pairs(marked.where(few).select(*columns), entries, f"(a.n < b.n or a.n = b.n and {_EARLIER})")
    both = materialize(pairs.select("*", *(F.lit(None).cast(k).alias(c) for c, k in entries.dtypes))
                       .unionAll(large.select(*(F.lit(None).cast("long").alias(c) for c in pairs.columns), *columns)), "lines-pairs")
    pairs, large = both.where("t is null").select("d1", "l1", "d2", "l2"), both.where("t is not null").select(*columns)
    if large.isEmpty():
        gone = _verify(pairs, docs)
    else:
        leads = large.groupBy("t").agg(F.min(F.struct(*columns[1:])).alias("lead")).select("t", "lead.*")
        gone = materialize(_verify(pairs.unionAll(_pairs(leads, large, _EARLIER)), docs), "lines-gone")
        # large groups again, but for pairs of which both went; one shuffle for both sides
        went = F.coalesce("went", F.lit(False))
        large = large.join(gone.withColumn("went", F.lit(True)), ["d", "l"], "left").select(*columns, went.alias("went"))
        gone = gone.unionAll(_verify(_pairs(large, large, f"{_EARLIER} and not (a.went and b.went)"), docs)).distinct()
    later = salted_join(lines.select("s", "d", "l"), first, "s", shared).where("struct(d, l) <> first").select("d", "l")
    return later.unionAll(gone)


def _numbered(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str]:
    """Give rows a number that orders them by id; the id itself where it is a
    distinct, never null integer, otherwise the place in the order of (id,
    text), equal rows sharing one."""
    number = fresh(df, "__row")
    total, ids = df.agg(F.count("*"), F.count_distinct(id_col)).first()
    if total == ids and dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn(number, F.col(id_col).cast("long")), number
    from furrow.llm.mixing import ranked
    key = fresh(df, "__text")
    keyed = df.withColumn(key, F.xxhash64(text))
    ids = keyed.select(F.col(id_col).alias("i"), F.col(key).alias("k")).distinct()
    order = ranked(ids.select(F.struct(F.col("i").isNull().alias("none"), "i", "k").alias("by")), "by")
    order = order.select(F.col("by.i").alias(number + "i"), F.col("by.k").alias(number + "k"), F.col("rank").alias(number))
    return keyed.join(order, F.col(id_col).eqNullSafe(F.col(number + "i")) & (F.col(key) == F.col(number + "k"))).drop(number + "i", number + "k", key), number


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS, min_words: int = MIN_WORDS) -> DataFrame:
    """Remove repeated lines; adds n_lines, n_removed and removed (the places
    of the lines that went, from 0), and puts the rest in ``text``.

    Lines end at "\n". Null texts stay null, with no lines; an empty text is
    one empty line. Lines of fewer than ``min_words`` distinct words stay,
    and lines without words always.
    Rows that repeat an id come in the order of their texts' hashes, and equal
    rows share their lines: none is removed for the other's sake. Null ids
    come last. Other columns pass through; input columns named as an added one
    are replaced. An empty table gives an empty table.
    """
    added = ("n_lines", "n_removed", "removed")
    keep = [c for c in df.columns if c.lower() not in added]
    rows, number = _numbered(df.select(keep), id_col, text)
    docs = rows.select(F.col(number).alias("d"), F.col(text).alias("text"))
    gone, at = fresh(rows, "__gone"), fresh(rows, "__at")
    removed = materialize(repeated_lines(docs, bits, min_words).groupBy(F.col("d").alias(at)).agg(F.array_sort(F.collect_set(F.col("l").cast("int"))).alias(gone)), "lines-removed")
    if removed.count() <= BROADCAST_ROWS:
        removed = F.broadcast(removed)
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = rows.join(removed, F.col(number) == F.col(at), "left")
    columns = [F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in keep]
    return out.select(*columns, F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                      F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(gone, F.array().cast("array<int>")).alias("removed"))


#: The same in SQL: every pair of distinct sets whose sizes allow a match.
ORACLE = f"""
WITH line AS MATERIALIZED (
  SELECT doc_id, i - 1 AS l, list_sort(list_distinct(list_filter(regexp_split_to_array(parts[i], '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(parts) + 1)) AS i FROM documents)),
sets AS MATERIALIZED (
  SELECT t, len(t) AS n, min((doc_id, l)) AS first, row_number() OVER () AS k FROM line WHERE len(t) >= {MIN_WORDS} GROUP BY t),
word AS MATERIALIZED (SELECT k, n, first, unnest(t) AS w FROM sets),
freq AS MATERIALIZED (SELECT w, count(*) AS c FROM word GROUP BY w HAVING c > 1),
prefix AS MATERIALIZED (
  SELECT k, n, first, w FROM (SELECT k, n, first, w, row_number() OVER (PARTITION BY k ORDER BY coalesce(c, 1), w) AS p FROM word LEFT JOIN freq USING (w))
  WHERE p <= n - (n * {PERCENT} + 99) // 100 + 1),
pair AS MATERIALIZED (
  SELECT DISTINCT a.k AS k1, b.k AS k2 FROM prefix a JOIN prefix b ON a.w = b.w AND a.first < b.first
  AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
hit AS (
  SELECT DISTINCT k2 AS k FROM pair JOIN sets a ON a.k = k1 JOIN sets b ON b.k = k2
  WHERE {100 + PERCENT} * len(list_intersect(a.t, b.t)) >= {PERCENT} * (a.n + b.n)),
gone AS (
  SELECT doc_id, list(l ORDER BY l) AS ls FROM line JOIN sets USING (t) WHERE (doc_id, l) <> first OR k IN (SELECT k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN ls IS NULL THEN text ELSE coalesce(list_aggregate([p[1] FOR p IN list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))) IF NOT list_contains(ls, p[2])], 'string_agg', chr(10)), '') END AS text,
  coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(len(ls), 0) AS n_removed
FROM documents d LEFT JOIN gone USING (doc_id)
"""
