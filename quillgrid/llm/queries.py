"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillgrid.llm.common import table
from quillgrid.llm.decontamination import decontaminate
from quillgrid.llm.embedding_dedup import VECTOR_SQL, embedding_components
from quillgrid.llm.fill_middle import MIDDLE_SQL, fill_in_middle, restore_middle
from quillgrid.llm.language_id import fit_language_model, identify_languages
from quillgrid.llm.licenses import license_sql, scan_licenses
from quillgrid.llm.mixing import MIX_SQL, mix_sources
from quillgrid.llm.nearest import nearest_neighbours
from quillgrid.llm.quality import score_quality
from quillgrid.llm.secrets import scan_secrets
from quillgrid.llm.simhash import simhash_components
from quillgrid.llm.substring_dedup import REPEATS_SQL, remove_repeats
from quillgrid.llm.token_counts import count_tokens
from quillgrid.llm.whitening import whiten


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for a document's host, source and language for its path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path"))
    return score_quality(docs, table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: directories by thousands and hundreds of ids in their source, every hundredth a licence file."""
    path = "concat(coalesce(source, 'unknown'), '/', doc_id div 1000, '/', doc_id div 100, '/', if(doc_id % 100 = 0, 'LICENSE', concat(doc_id, '.txt')))"
    files = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{path} path", "text")
    return scan_licenses(files).withColumn("similarity", F.round("similarity", 6))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    most = lambda part: F.coalesce(F.array_max(F.transform("matches", lambda m: m[part])), F.lit(0.0)).alias(part)
    item_ids = F.array_join(F.transform("matches", lambda m: m["item_id"].cast("string")), ",")
    return found.select(
        "doc_id",
        "contaminated",
        F.size("matches").cast("long").alias("n_items"),
        item_ids.alias("item_ids"),
        most("overlap"),
        most("question_overlap"),
        most("answer_overlap"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_guess")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out()))
    return identify_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore_middle(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where(F.pmod("vec_id", F.lit(20)) == 0))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_licenses, op3_token_counts, op4_decontamination, op5_substring_dedup, op6_secrets, op7_embedding_dedup,
        op8_mixing, op9_simhash, op10_language_id, op11_fill_in_middle, op12_nearest, op13_whitening, pipeline,
    )
}
ORACLES: dict[str, str] = {"op2_licenses": license_sql(), "op5_substring_dedup": REPEATS_SQL, "op7_embedding_dedup": VECTOR_SQL, "op8_mixing": MIX_SQL.format(docs="documents"), "op11_fill_in_middle": MIDDLE_SQL}
