"""The registered queries of this package: (spark, sf_dir) -> DataFrame, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.collocations import mine_collocations
from lexiflow.llm.decontamination import contamination_digest, find_contamination
from lexiflow.llm.exact_dedup import exact_dedup
from lexiflow.llm.filter_audit import audit_filters
from lexiflow.llm.fingerprints import fingerprint_edits
from lexiflow.llm.html_blocks import extract_main_text
from lexiflow.llm.jaccard_join import jaccard_join
from lexiflow.llm.language_id import language_id
from lexiflow.llm.line_dedup import line_dedup
from lexiflow.llm.mixing import mix
from lexiflow.llm.packing import pack
from lexiflow.llm.quality import THRESHOLD, score_quality
from lexiflow.llm.substring_dedup import repeated_passages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), ["doc_id"]).withColumn("kept", F.col("quality_score") >= THRESHOLD)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_quality_classifier, op3_exact_dedup, op4_line_dedup, op5_html_extraction,
        op6_fingerprints, op7_packing, op8_language_id, op9_mixing, op10_jaccard_join,
        op11_collocations, op12_filter_audit, op13_decontamination,
    )
}
