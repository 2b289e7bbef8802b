"""A training-data pipeline over the documents table.

Quality filter, line dedup, near-duplicate removal, mixing to source weights,
and encoding. Each stage reads the table that the one before has written, so a
lost executor repeats a part of one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import quality_fm
from furrow.llm.common import fresh, materialize, table, words
from furrow.llm.line_dedup import dedup_lines
from furrow.llm.minhash_forest import near_duplicates
from furrow.llm.mixing import mix, ranked
from furrow.llm.queries import training_rows, vocabulary
from furrow.llm.sentencepiece_codec import encode_and_decode

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def _with_own(docs: DataFrame, added: tuple[str, ...], use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply an operator that adds columns, to rows that may have columns of
    those names: they step aside and come back. ``use`` gets the rows and may
    filter them; the result has the columns of ``docs``."""
    aside = {c: fresh(docs, f"__own_{c}") for c in docs.columns if c.lower() in added}
    out = use(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. It is fitted on
    labelled documents of this table; without any, all score 0.5 and stay.
    Null and empty texts are scored like others; repeated rows fare alike."""
    machine = quality_fm.fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return _with_own(docs, ("score",), lambda d: quality_fm.score(d, machine).where(F.col("score") >= 0.5))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line nearly equals, with
    ``n_chars`` to match. Every document stays, also if no line does."""

    def use(d: DataFrame) -> DataFrame:
        d = dedup_lines(d)
        if "n_chars" in d.columns:
            d = d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(d.schema["n_chars"].dataType))
        return d

    return _with_own(docs, ("n_lines", "n_removed", "removed"), use)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies,
    also where rows repeat an id or have none: rows are numbered in the order
    of id (null last) and text for this stage, equal rows sharing a number, and
    one row of a number stays. Texts without words are in no group and stay."""
    number, own = fresh(docs, "__row"), fresh(docs, "__id")
    rows, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == distinct:
        return _with_own(docs, ("n_shingles", "component_id", "kept"), lambda d: near_duplicates(d, width=SHINGLE).where("kept"))
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    keys = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), hashed.alias("h")).alias("by")).distinct()
    keys = ranked(keys, "by").select(F.col("by.i").alias(number + "i"), F.col("by.h").alias(number + "h"), F.col("rank").alias(number))
    numbered = docs.join(keys, F.col("doc_id").eqNullSafe(F.col(number + "i")) & (hashed == F.col(number + "h"))).drop(number + "i", number + "h")
    blank = F.size(words(F.col("text"))) == 0
    once = numbered.where(~blank).dropDuplicates([number]).unionByName(numbered.where(blank)).withColumnsRenamed({"doc_id": own}).withColumnRenamed(number, "doc_id")
    kept = _with_own(once, ("n_shingles", "component_id", "kept"), lambda d: near_duplicates(d, width=SHINGLE).where("kept"))
    return kept.drop("doc_id").withColumnRenamed(own, "doc_id").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times; documents
    without words are never taken."""
    copy = fresh(docs, "__copy")
    return _with_own(docs, ("size", "source_size", "target", "copies"),
                     lambda d: mix(d).where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text with the end id, and digests
    of the ids and of the text that they decode to."""
    vocab = vocabulary()
    coded = encode_and_decode(docs.select("doc_id", "text"), vocab)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near), ("mixing", mixing), ("sentencepiece", encoding)]

#: Fitted scores and random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
