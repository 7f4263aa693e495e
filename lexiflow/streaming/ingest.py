"""Incremental ingest of newly arriving review files (Structured Streaming).

The batch ingest operators are per-row expressions, so they run unchanged
on a file stream: each micro-batch reads the new ``*.json`` files, explodes
and projects them to the contract, parses labels and cleans text.  Nothing
here is stateful (de-duplication "first row per uid in file order" needs
the whole history in file order and stays a batch step); the checkpoint
folder records which files were already taken, so a restarted query
continues where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiflow.functions.labels import parse_label
from lexiflow.functions.text import clean_text
from lexiflow.sources import json_ingest


def read_raw_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (path, payload) rows for new ``*.json`` files under ``root``."""
    r = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
    )
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def contract_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Contract rows plus cleaned ``text``; rows without a label are kept (the
    batch prep step drops them, as it also de-duplicates)."""
    raw = read_raw_stream(spark, root, max_files_per_trigger)
    c = json_ingest.project_contract(json_ingest.with_provenance(json_ingest.explode_payloads(raw), root))
    return c.withColumn("text", clean_text("raw_text")).withColumn(
        "label_int", F.coalesce(F.col("label_int"), parse_label(F.col("polarity")))
    )


def start_ingest(stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the stream to a Parquet table; ``available_now`` drains what exists and stops."""
    w = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(out_path)
