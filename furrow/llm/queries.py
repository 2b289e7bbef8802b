"""One registered query per operator: the operator with its production
parameters over the whole table, then the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.bpe import Vocabulary
from furrow.llm.common import table
from furrow.llm import fill_middle, filter_audit, url_filter
from furrow.llm.hilbert_ann import nearest
from furrow.llm.html_text import extract
from furrow.llm.line_dedup import ORACLE as LINE_SQL
from furrow.llm.line_dedup import dedup_lines
from furrow.llm.lm_scoring import score_texts
from furrow.llm.minhash_forest import near_duplicates
from furrow.llm.mixing import mix
from furrow.llm import quality_fm
from furrow.llm.sentencepiece_codec import encode_and_decode
from furrow.llm.topk import top_k
from furrow.llm.token_counts import count_tokens

PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def vocabulary(path: str | None = None) -> Vocabulary:
    """The piece vocabulary; its file's path is a parameter."""
    return Vocabulary.read(path or public_tokenizers.path(PIECES))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_and_decode(docs, vocab).drop("text")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return score_texts(docs, vocabulary(), ~F.col("held_out"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 5, F.col("vec_id") % 50 == 0)


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op7_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 20, lambda vec_id: vec_id % 20 == 0)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, text, label) of the labelled rows to learn from."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0))
    label = labels.where("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    return (docs.where(fold != 1).select("doc_id", "text").join(label, "doc_id")
            .select(F.col("doc_id").alias("key"), "text", "label"))


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality_fm.fit(training_rows(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = quality_fm.score(docs, machine).select("doc_id", held.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return (count_tokens(docs, vocabulary())
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fill_middle.store(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    made = fill_middle.digests(fill_middle.fill_in_middle(stored))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cells = filter_audit.document_cells(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return filter_audit.interactions(cells, filter_audit.LETTERS)


def op13_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_mix_sources, op3_lattice_lm, op4_html_text, op5_exact_topk, op6_minhash_forest, op7_hilbert_ann, op8_quality_fm, op9_line_dedup, op10_token_counts,
                                op11_fill_in_middle, op12_filter_audit, op13_link_trust)}
ORACLE_SQL: dict[str, str] = {"op9_line_dedup": LINE_SQL, "op11_fill_in_middle": fill_middle.ORACLE,
                              "op12_filter_audit": filter_audit.ORACLE}
