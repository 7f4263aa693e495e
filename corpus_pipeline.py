"""The corpus pipeline: five stages over ``documents``, each one of the llm operators.

Every stage takes all rows that its predecessor kept and returns the columns of its
input; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.jaccard_join import jaccard_join
from lexiflow.llm.line_dedup import line_dedup
from lexiflow.llm.mixing import mix
from lexiflow.llm.packing import pack
from lexiflow.llm.quality import THRESHOLD, score_quality
from lexiflow.llm.queries import tokenizer_path
from lexiflow.sources.tables import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below the threshold go."""
    names = docs.columns
    whole = docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in names]).alias("_row"))
    scored = score_quality(whole, ["_row"])
    return scored.where(F.col("quality_score") >= THRESHOLD).select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; documents stay, ``n_chars`` counts what is left."""
    cleaned = line_dedup(docs.select("doc_id", "text", "source", F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row")))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return cleaned.select(*[new.get(c, F.col(f"_row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard_join(docs, keep=[f"`{c}`" for c in docs.columns]).where("kept").select("kept_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: none, once, or up to three times."""
    mixed = mix(docs, keep=[f"`{c}`" for c in docs.columns])
    return mixed.where("copies > 0").select("kept_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("kept_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, one row each."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: the classifier and the tokenizer can't be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
