"""The reference's seven stages as Spark jobs that read and write tables.

    python -m lexiflow.plans.stages profile  --root DIR --out OUT
    python -m lexiflow.plans.stages prepare  --out OUT [--strict]
    python -m lexiflow.plans.stages lengths  --out OUT
    python -m lexiflow.plans.stages tokens   --out OUT [--candidates 64,96,...]
    python -m lexiflow.plans.stages train    --out OUT [--domains a,b]
    python -m lexiflow.plans.stages compare  --out OUT --a TAG --b TAG   (or wide, compact: the latest run)

Tables are Parquet under ``OUT`` (``combined``, ``splits`` partitioned by
``split``, ``train_tokens``), reports are small JSON-lines folders under
``OUT/reports/<name>``, run records under ``OUT/runs``.  Every stage reads
the previous stage's table, so each can be rerun on its own.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.text import text_len
from lexiflow.operators import metrics, model, prep, profile, runs, split, tokens
from lexiflow.sources import json_ingest, tables


#: reports that grow with the corpus: a row a category or label text, or a file
UNBOUNDED = ("quarantine", "invalid_label_values", "unmapped_labels", "box_by_category", "length_stats_by_category", "categories_by_median")


def _write_reports(out: str, reports: dict[str, DataFrame]) -> dict[str, DataFrame]:
    for name, df in reports.items():
        # one file per report, but for lists that grow with the corpus
        tables.write_record(df if name in UNBOUNDED else df.coalesce(1), f"{out}/reports/{name}")
    return reports


def stage_profile(spark: SparkSession, roots: Sequence[str], out: str) -> dict[str, DataFrame]:
    """Stage 1: ingest every JSON file under the roots, write ``combined``, profile it."""
    # parse every document once: elements and empty documents in one written table
    ex = None
    with json_ingest.last_of_repeated_keys(spark):
        for root in roots:
            part = json_ingest.with_provenance(json_ingest.explode_root(spark, root), root)
            ex = part if ex is None else ex.unionByName(part)
        ex = tables.materialize(ex, "ingest")
    status = json_ingest.status_from_exploded(ex, "file_path").withColumn(
        "top_folder", F.substring_index("file_path", "/", 1)
    )
    combined = json_ingest.project_contract(ex.filter("_is_object")).withColumn("text_len", text_len("raw_text"))
    tables.write_table(combined, f"{out}/combined")
    c = spark.read.parquet(f"{out}/combined")
    reports = {
        "files_by_kind": status.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows")),
        "quarantine": status.filter(F.col("kind").isin("corrupt", "scalar")),
        "null_profile": profile.null_profile(c, json_ingest.CONTRACT_COLUMNS),
        "missing_text_label": profile.missing_text_label(c),
        "invalid_label_values": profile.invalid_label_values(c),
        "label_counts": profile.value_counts(c, "label_int", dropna=False),
        "label_share_by_source": profile.crosstab(c, "source", "label_int", normalize="index"),
        "label_share_by_domain": profile.crosstab(c, "domain", "label_int", normalize="index"),
        "folder_by_source": profile.crosstab(c, "top_folder", "source"),
        "domain_counts": profile.value_counts(c, "domain"),
        "top_categories": profile.top_values(c, "main_category", 20),
        "source_counts": profile.value_counts(c, "source"),
        "length_describe": profile.describe(c, "text_len"),
        "length_quantiles": profile.quantiles(c, "text_len"),
        "duplicates": profile.duplicate_counts(
            c, {"n_dup_text": profile.text_key("raw_text"), "n_dup_index": F.struct("review_index")}
        ),
    }
    return _write_reports(out, reports)


def stage_prepare(spark: SparkSession, out: str, ratios=(8, 1, 1), seed: int = 42, strict: bool = False) -> dict[str, DataFrame]:
    """Stage 2: clean, de-duplicate, remap, split; write ``splits`` (partitioned) and the label map.

    ``strict`` stops at the first label that is no integer or has no class, instead of listing them."""
    c = spark.read.parquet(f"{out}/combined")
    funnel = prep.ObservedFunnel(c, strict=strict)
    prepared = tables.materialize(funnel.rows, "prepared")
    s = split.stratified_split(split.stratify_key(prepared), ratios=ratios, seed=seed)
    tables.write_table(s, f"{out}/splits", partition_by="split")
    tables.write_record(tables.label_map_record(spark), f"{out}/label_map")
    s = spark.read.parquet(f"{out}/splits")
    reports = {
        "prep_funnel": funnel.counts(),
        "unmapped_labels": prep.unmapped_rows(c).groupBy("polarity").agg(F.count(F.lit(1)).alias("n")),
        "split_sizes": split.split_sizes(s),
        "split_label_share": split.split_label_share(s),
        "split_invariants": split.split_invariants(s, prepared),
    }
    return _write_reports(out, reports)


def stage_lengths(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Stage 3: character-length box plots, histograms and group statistics (chart data)."""
    c = spark.read.parquet(f"{out}/combined").filter(F.col("raw_text").isNotNull())
    reports = {
        "box_by_domain": profile.box_stats(c, "domain", "text_len"),
        "box_by_category": profile.box_stats(c, "main_category", "text_len"),
        "box_by_source": profile.box_stats(c, "source", "text_len"),
        "domains_by_median": profile.groups_by_median(c, "domain", "text_len"),
        "histogram_by_domain": profile.histogram(c, "domain", "text_len"),
        "length_stats_by_domain": profile.group_stats(c, "domain", "text_len"),
        "length_stats_by_category": profile.group_stats(c, "main_category", "text_len"),
        "categories_by_median": profile.groups_by_median(c, "main_category", "text_len"),
    }
    return _write_reports(out, reports)


def stage_tokens(spark: SparkSession, out: str, candidates: Sequence[int] = tokens.CANDIDATE_MAX_LENGTHS, domains=None) -> dict[str, DataFrame]:
    """Stage 4: token lengths of the train split, truncation tables, recommended max length."""
    train = prep.filter_values(spark.read.parquet(f"{out}/splits").filter(F.col("split") == "train"), "domain", domains)
    tokens.with_token_len(train).write.mode("overwrite").parquet(f"{out}/train_tokens")
    t = spark.read.parquet(f"{out}/train_tokens")
    reports = {
        "token_describe": profile.describe(t, "token_len"),
        "token_quantiles": profile.quantiles(t, "token_len"),
        "token_stats_by_domain": profile.group_stats(t, "domain", "token_len", qs=(0.9, 0.95)),
        "truncation_overall": tokens.truncation_overall(t, candidates),
        "truncation_by_domain": tokens.truncation_by(t, "domain", candidates),
        "recommend_max_length": tokens.recommend_max_length(t, candidates),
    }
    return _write_reports(out, reports)


def stage_train(spark: SparkSession, out: str, domains=None, max_length: int = tokens.MAX_LENGTH) -> DataFrame:
    """Stages 5-6: two runs differing in one factor; run records appended under ``OUT/runs``,
    scores, class report and confusion matrix of the test split under ``OUT/reports/test/<tag>``.

    A tag names the run: configuration, domains, maximum length and start time."""
    s = spark.read.parquet(f"{out}/splits")
    started = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    what = "-".join(["+".join(domains) if domains else "all", str(max_length), started])
    configs = [{**c, "run_tag": f"{c['run_tag']}-{what}"} for c in model.RUN_CONFIGS]

    def report(tag: str, predictions: DataFrame) -> None:
        for name, df in evaluate(spark, predictions).items():
            tables.write_record(df.drop("run").coalesce(1), f"{out}/reports/test/{tag}/{name}")  # k rows

    recs = model.train_compare(s, configs, domain_filter=domains, max_length=max_length, model_dir=f"{out}/models", on_test=report)
    tables.write_record(recs, f"{out}/runs", mode="append")
    return recs


def stage_compare(spark: SparkSession, out: str, a: str, b: str) -> DataFrame:
    """Stage 7: side-by-side comparison of two stored runs, given by tag or by the
    configuration's name, which means its latest run."""
    recs = spark.read.schema(runs.RUN_SCHEMA).json(f"{out}/runs")
    a, b = runs.resolve_tag(recs, a), runs.resolve_tag(recs, b)
    cmp = runs.compare_runs(recs, a, b)
    tables.write_table(runs.present(cmp).coalesce(1), f"{out}/comparison", fmt="csv", bom=True)
    return cmp


def evaluate(spark: SparkSession, predictions: DataFrame) -> dict[str, DataFrame]:
    """Scores of one prediction table (label, pred): accuracy, macro-F1, report, matrix."""
    p = predictions.withColumn("run", F.lit("run"))
    return {
        "accuracy": metrics.accuracy(p),
        "f1_macro": metrics.f1_macro(p),
        "classification_report": metrics.classification_report(p),
        "confusion_matrix": metrics.confusion_matrix(p),
    }


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="lexiflow.plans.stages")
    ap.add_argument("stage", choices=["profile", "prepare", "lengths", "tokens", "train", "compare"])
    ap.add_argument("--root", action="append", default=[])
    ap.add_argument("--out", required=True)
    ap.add_argument("--candidates", default="")
    ap.add_argument("--domains", default="")
    ap.add_argument("--strict", action="store_true")
    ap.add_argument("--a", default="wide")
    ap.add_argument("--b", default="compact")
    args = ap.parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("lexiflow-stages").getOrCreate()
    domains = [d for d in args.domains.split(",") if d] or None
    if args.stage == "profile":
        stage_profile(spark, args.root, args.out)
    elif args.stage == "prepare":
        stage_prepare(spark, args.out, strict=args.strict)
    elif args.stage == "lengths":
        stage_lengths(spark, args.out)
    elif args.stage == "tokens":
        cands = tuple(int(x) for x in args.candidates.split(",") if x) or tokens.CANDIDATE_MAX_LENGTHS
        stage_tokens(spark, args.out, cands, domains)
    elif args.stage == "train":
        stage_train(spark, args.out, domains)
    else:
        stage_compare(spark, args.out, args.a, args.b)


if __name__ == "__main__":
    main()
