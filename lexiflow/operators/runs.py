"""Run records and side-by-side comparison of runs.

A run record is one row: method, configuration, sizes, timings and scores.
``compare_runs`` unpivots two runs to (metric, value), joins them on the
metric name and adds difference, ratio, percent reduction and size factor.
Any number of runs can be stored; the comparison picks two by tag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The metrics of the reference comparison table, in its order.
COMPARE_METRICS = (
    "test_accuracy",
    "test_f1_macro",
    "train_time_sec",
    "model_size_mb",
    "trainable_params",
    "trainable_ratio_pct",
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_tag", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("domain_filter", T.ArrayType(T.StringType())),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("num_features", T.IntegerType()),
        T.StructField("reg_param", T.DoubleType()),
        # epochs or iterations; the last two are of trainers that work in batches
        T.StructField("num_epochs", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("total_params", T.LongType()),
        T.StructField("trainable_params", T.LongType()),
        T.StructField("trainable_ratio_pct", T.DoubleType()),
        T.StructField("train_time_sec", T.DoubleType()),
        T.StructField("model_size_mb", T.DoubleType()),
        T.StructField("test_accuracy", T.DoubleType()),
        T.StructField("test_f1_macro", T.DoubleType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("n_valid", T.LongType()),
        T.StructField("n_test", T.LongType()),
    ]
)


def run_record(spark: SparkSession, **fields) -> DataFrame:
    """One-row run record with the fixed schema; missing fields are null."""
    row = tuple(fields.get(f.name) for f in RUN_SCHEMA.fields)
    unknown = set(fields) - set(RUN_SCHEMA.fieldNames())
    if unknown:
        raise ValueError(f"unknown run fields: {sorted(unknown)}")
    return spark.createDataFrame([row], RUN_SCHEMA)


def resolve_tag(runs: DataFrame, name: str, tag: str = "run_tag") -> str:
    """The tag ``name`` itself if a run has it, else the latest of the tags ``name-...-<start time>``."""
    own = F.col(tag) == name
    latest = F.max_by(tag, F.substring_index(tag, "-", -1))
    row = runs.filter(own | F.col(tag).startswith(f"{name}-")).agg(F.bool_or(own).alias("own"), latest.alias("latest")).first()
    if row is None or row["latest"] is None:
        raise ValueError(f"no run is tagged {name!r}")
    return name if row["own"] else row["latest"]


def half_even(col: Column, digits: int) -> Column:
    """Rounding to even on ties, as numbers are shown in reports (operators round half up, to 6 digits)."""
    return F.bround(col, digits)


def minutes(seconds: Column) -> Column:
    return seconds / 60.0


def present(comparison: DataFrame) -> DataFrame:
    """``compare_runs`` as it is shown: times in minutes (metric ``train_time_min``), ratios with 4 digits, ties to even."""
    time = F.col("metric") == "train_time_sec"

    def shown(c: str) -> Column:
        return half_even(F.when(time, minutes(F.col(c))).otherwise(F.col(c)), 4).alias(c)

    return comparison.select(
        F.when(time, "train_time_min").otherwise(F.col("metric")).alias("metric"), *[shown(c) for c in ("run_a", "run_b", "diff")],
        *[half_even(F.col(c), 4).alias(c) for c in ("ratio", "pct_reduction", "factor")],
    )


def compare_runs(runs: DataFrame, a: str, b: str, metrics: Sequence[str] = COMPARE_METRICS, tag: str = "run_tag") -> DataFrame:
    """metric, run_a, run_b, diff (b - a), ratio (b / a), pct_reduction ((1 - b/a) * 100), factor (a / b).

    Both runs are unpivoted to (run, metric, value) and aligned by metric with
    one pivot on the run tag (no self-join); a metric is reported when both
    runs have a record.  A tag with more than one record raises."""
    present = [m for m in metrics if m in runs.columns]
    long = runs.select(tag, *[F.col(m).cast("double").alias(m) for m in present]).unpivot([tag], present, "metric", "value")
    wide = (
        long.filter(F.col(tag).isin(a, b))
        .groupBy("metric")
        .pivot(tag, [a, b])
        .agg(F.first("value").alias("v"), F.count(F.lit(1)).alias("c"))
    )
    wide = wide.filter((F.col(f"`{a}_c`") > 0) & (F.col(f"`{b}_c`") > 0))
    twice = F.raise_error(F.lit(f"more than one record is tagged {a} or {b}")).cast("boolean")
    wide = wide.filter(F.when((F.col(f"`{a}_c`") > 1) | (F.col(f"`{b}_c`") > 1), twice).otherwise(F.lit(True)))
    ra, rb = F.col(f"`{a}_v`"), F.col(f"`{b}_v`")
    ratio = F.try_divide(rb, ra)
    return wide.select(
        "metric",
        F.round(ra, 6).alias("run_a"),
        F.round(rb, 6).alias("run_b"),
        F.round(rb - ra, 6).alias("diff"),
        F.round(ratio, 6).alias("ratio"),
        F.round((F.lit(1.0) - ratio) * 100.0, 6).alias("pct_reduction"),
        F.round(F.try_divide(ra, rb), 6).alias("factor"),
    )
