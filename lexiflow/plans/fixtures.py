"""Fixture views over the driver tables (documents, labels).

The reference ingests review JSON files with a sentiment label; the driver
tables hold invented documents and quality/toxicity labels.  These views map
one onto the other so every operator runs on data Spark derives from the
given tables (and grows with them).  ``plans/oracles.py`` holds the same
views in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed layout parameters of the synthetic file tree: a file holds the
# documents of one (folder, source, language) and one block of doc ids.
FILE_BLOCK = 512
SNS_FROM_SOURCE = 10  # sources src10.. live under the 'sns' folder
WIDE_SPACE = "\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage-1 contract table: one row per review, label as text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    src_no = F.substring(F.col("source"), 4, 10).cast("int")
    top = F.when(src_no < SNS_FROM_SOURCE, F.lit("shop")).otherwise(F.lit("sns"))
    block = F.lpad(F.floor(F.col("doc_id") / FILE_BLOCK).cast("bigint").cast("string"), 5, "0")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("review_index"),
        F.col("text").alias("raw_text"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("sns")).otherwise(F.lit("shop")).alias("source"),
        F.col("lang").alias("domain"),
        F.col("source").alias("main_category"),
        F.concat(F.lit("item-"), F.col("lang"), F.lit("-"), F.col("source")).alias("product_name"),
        (F.col("quality") - F.col("toxic")).cast("string").alias("polarity"),
        F.concat(top, F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/part-"), block, F.lit(".json")).alias(
            "file_path"
        ),
        top.alias("top_folder"),
        F.col("doc_id").alias("pos"),
    )


def reviews_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reviews`` with blank/null/odd-space text, junk labels, null Domain, repeated Index."""
    r = reviews(spark, sf_dir)
    pos = F.col("pos")
    odd_ws = F.concat(F.col("raw_text"), F.lit("\u001c "), F.lit("\U0001F600"), F.lit(" "), F.lit("x"))
    return r.select(
        F.when(pos % 71 == 0, F.lit(None).cast("string")).otherwise((pos % 7).cast("string")).alias("review_index"),
        F.when(pos % 97 == 0, F.lit("   "))
        .when(pos % 101 == 0, F.lit(None).cast("string"))
        .when(pos % 5 == 0, F.concat(F.lit("  "), F.col("raw_text"), F.lit(WIDE_SPACE + "\n ")))
        .when(pos % 13 == 0, odd_ws)
        .otherwise(F.col("raw_text"))
        .alias("raw_text"),
        "source",
        F.when(pos % 89 == 0, F.lit(None).cast("string")).otherwise(F.col("domain")).alias("domain"),
        "main_category",
        "product_name",
        F.when(pos % 53 == 0, F.lit("x"))
        .when(pos % 59 == 0, F.lit("7"))
        .when(pos % 61 == 0, F.lit("1.5"))
        .otherwise(F.col("polarity"))
        .alias("polarity"),
        "file_path",
        "top_folder",
        "pos",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic scores and two prediction rules over the labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    n = F.col("n_chars")
    return d.join(lab, "doc_id").select(
        "doc_id",
        (F.col("quality") - F.col("toxic") + 1).alias("label"),
        F.when(n < 600, 0).when(n < 1200, 1).otherwise(2).alias("pred_a"),
        F.when(n < 300, 1).otherwise(2).alias("pred_b"),
        ((F.lit(1200) - n).cast("double") / 1000.0).alias("s0"),
        F.lit(0.5).alias("s1"),
        ((n - F.lit(1800)).cast("double") / 1000.0).alias("s2"),
    )


def predictions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (run, document): run 'a' = pred_a, run 'b' = pred_b."""
    p = predictions(spark, sf_dir)
    return p.unpivot(["doc_id", "label"], ["pred_a", "pred_b"], "run", "pred").select(
        F.regexp_replace("run", "^pred_", "").alias("run"), "doc_id", "label", "pred"
    )


def payloads(spark: SparkSession, sf_dir: str, root: str = "/data/reviews") -> DataFrame:
    """One JSON document per file path, in four shapes chosen by source number % 4.

    0: plain array; 1: object whose first list value holds the rows (after a
    string that looks like a list and before a second list); 2: array with a
    trailing scalar element; 3: the whole array without its closing bracket
    (corrupt).  The label field is
    text in shop files and a number in sns files.  Files are bounded by
    construction (one doc-id block of one source and language), so
    ``collect_list`` never gathers an unbounded group.
    """
    r = reviews(spark, sf_dir)
    src_no = F.substring(F.col("main_category"), 4, 10).cast("int")
    fields = [
        F.col("review_index").alias("Index"),
        F.col("raw_text").alias("RawText"),
        F.col("source").alias("Source"),
        F.col("domain").alias("Domain"),
        F.col("main_category").alias("MainCategory"),
        F.col("product_name").alias("ProductName"),
    ]
    as_number = F.to_json(F.struct(*fields, F.col("polarity").cast("int").alias("GeneralPolarity")))
    as_text = F.to_json(F.struct(*fields, F.col("polarity").alias("GeneralPolarity")))
    row_json = F.when(F.col("top_folder") == "sns", as_number).otherwise(as_text)
    files = r.groupBy("file_path", (src_no % 4).alias("kind_no")).agg(
        F.sort_array(F.collect_list(F.struct("pos", row_json.alias("j")))).alias("rows")
    )
    body = F.array_join(F.transform("rows", lambda x: x["j"]), ",")
    arr = F.concat(F.lit("["), body, F.lit("]"))
    k = F.col("kind_no")
    payload = (
        F.when(k == 0, arr)
        .when(k == 1, F.concat(F.lit('{"meta":"[x","rows":'), arr, F.lit(',"other":[{"Index":"no"}]}')))
        .when(k == 2, F.concat(F.lit("["), body, F.lit(",5]")))
        .otherwise(F.concat(F.lit("["), body))  # every review, but the closing bracket is missing
    )
    return files.select(F.concat(F.lit(root.rstrip("/") + "/"), F.col("file_path")).alias("path"), payload.alias("payload"))
