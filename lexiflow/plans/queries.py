"""Registry of query keys: ``key -> fn(spark, sf_dir) -> DataFrame``.

Every key reads the driver tables through the fixture views and runs the
operators over whole tables.  Column names equal those of the matching SQL
in ``plans/oracles.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.labels import label_name
from lexiflow.functions.text import clean_text, text_len
from lexiflow.operators import metrics, model, prep, profile, runs, split, tokens
from lexiflow.plans import fixtures as fx
from lexiflow.sources import json_ingest, json_ranges, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn

    return deco


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lab(spark, sf):
    return prep.with_label_int(fx.reviews(spark, sf))


def _lens(spark, sf):
    r = fx.reviews(spark, sf)
    return r.filter(F.col("raw_text").isNotNull()).withColumn("text_len", text_len("raw_text"))


# ---- profile over reviews -------------------------------------------------
@query("label_counts")
def q_label_counts(spark, sf):
    return profile.value_counts(_lab(spark, sf), "label_int", dropna=False)


@query("domain_counts")
def q_domain_counts(spark, sf):
    return profile.value_counts(fx.reviews(spark, sf), "domain")


@query("source_counts")
def q_source_counts(spark, sf):
    return profile.value_counts(fx.reviews(spark, sf), "source")


@query("crosstab_folder_source")
def q_crosstab_folder_source(spark, sf):
    return profile.crosstab_wide(fx.reviews(spark, sf), "top_folder", "source", ["shop", "sns"])


@query("label_share_by_source")
def q_label_share_by_source(spark, sf):
    return profile.crosstab(_lab(spark, sf), "source", "label_int", normalize="index")


@query("label_share_by_domain")
def q_label_share_by_domain(spark, sf):
    return profile.crosstab(_lab(spark, sf), "domain", "label_int", normalize="index")


@query("length_describe")
def q_length_describe(spark, sf):
    return profile.describe(_lens(spark, sf), "text_len")


@query("length_quantiles")
def q_length_quantiles(spark, sf):
    return profile.quantiles(_lens(spark, sf), "text_len")


@query("length_stats_by_domain")
def q_length_stats_by_domain(spark, sf):
    return profile.group_stats(_lens(spark, sf), "domain", "text_len", qs=(0.75, 0.9))


@query("length_stats_by_category")
def q_length_stats_by_category(spark, sf):
    return profile.group_stats(_lens(spark, sf), "main_category", "text_len", qs=(0.75, 0.9))


@query("box_by_domain")
def q_box_by_domain(spark, sf):
    return profile.box_stats(_lens(spark, sf), "domain", "text_len")


@query("box_by_category")
def q_box_by_category(spark, sf):
    return profile.box_stats(_lens(spark, sf), "main_category", "text_len")


@query("box_by_source")
def q_box_by_source(spark, sf):
    return profile.box_stats(_lens(spark, sf), "source", "text_len")


@query("length_histogram")
def q_length_histogram(spark, sf):
    return profile.histogram(_lens(spark, sf), "domain", "text_len", bins=50, clip_q=0.99)


@query("distinct_groups")
def q_distinct_groups(spark, sf):
    return profile.distinct_groups(fx.reviews(spark, sf), ["domain", "main_category", "source"])


@query("top_categories")
def q_top_categories(spark, sf):
    return profile.top_values(fx.reviews(spark, sf), "main_category", 20).withColumn("rank", F.col("rank").cast("int"))


@query("domains_by_median")
def q_domains_by_median(spark, sf):
    return profile.groups_by_median(_lens(spark, sf), "domain", "text_len").withColumn("rank", F.col("rank").cast("int"))


@query("groups_by_median")
def q_groups_by_median(spark, sf):
    return profile.groups_by_median(_lens(spark, sf), "main_category", "text_len").withColumn("rank", F.col("rank").cast("int"))


# ---- stage-2 steps over reviews_dirty -------------------------------------
@query("text_len")
def q_text_len(spark, sf):
    d = fx.reviews_dirty(spark, sf)
    return d.select("pos", text_len("raw_text").alias("text_len"), F.length(clean_text("raw_text")).alias("clean_len"))


@query("null_profile")
def q_null_profile(spark, sf):
    d = fx.reviews_dirty(spark, sf)
    return profile.null_profile(d, [c for c in d.columns if c != "pos"])


@query("missing_text_label")
def q_missing_text_label(spark, sf):
    return profile.missing_text_label(fx.reviews_dirty(spark, sf))


@query("invalid_label_values")
def q_invalid_label_values(spark, sf):
    return profile.invalid_label_values(prep.with_label_int(fx.reviews_dirty(spark, sf)))


@query("unmapped_labels")
def q_unmapped_labels(spark, sf):
    return prep.unmapped_rows(fx.reviews_dirty(spark, sf)).groupBy("polarity").agg(F.count(F.lit(1)).alias("n"))


@query("parse_label")
def q_parse_label(spark, sf):
    return prep.with_label_int(fx.reviews_dirty(spark, sf)).select("pos", "polarity", "label_int")


@query("clean_text")
def q_clean_text(spark, sf):
    d = prep.with_clean_text(fx.reviews_dirty(spark, sf))
    return d.select("pos", "text", F.length("text").alias("text_len"))


@query("uid_key")
def q_uid_key(spark, sf):
    return prep.with_uid(fx.reviews_dirty(spark, sf)).select("pos", "uid")


@query("dedup_keep_first")
def q_dedup_keep_first(spark, sf):
    return prep.dedup_keep_first(prep.with_uid(fx.reviews_dirty(spark, sf))).select("uid", "pos")


@query("duplicate_profile")
def q_duplicate_profile(spark, sf):
    d = prep.with_uid(fx.reviews_dirty(spark, sf))
    # text and Index over all rows (nulls equal), uid over labelled rows only
    return profile.duplicate_counts(
        d,
        {
            "n_dup_text": profile.text_key("raw_text"),
            "n_dup_index": F.struct("review_index"),
            "n_dup_uid": F.when(F.col("polarity").isNotNull(), F.struct("uid")),
        },
    )


@query("drop_missing_label")
def q_drop_missing_label(spark, sf):
    return prep.drop_missing_label(fx.reviews_dirty(spark, sf)).select("pos", "polarity")


@query("drop_empty_text")
def q_drop_empty_text(spark, sf):
    return prep.drop_empty_report(prep.staged(fx.reviews_dirty(spark, sf)))


@query("prep_funnel")
def q_prep_funnel(spark, sf):
    return prep.prep_funnel(fx.reviews_dirty(spark, sf))


# ---- prepared rows, split -------------------------------------------------
def _prepared(spark, sf):
    return prep.prepare(fx.reviews(spark, sf))


def _prepared_table(spark, sf):
    """Prepared rows written once to the shared checkpoint folder (lineage cut;
    later steps read only the columns they need)."""
    return tables.materialize(_prepared(spark, sf), "prepared")


def _prepared_keys(spark, sf):
    """What a split is decided by, without the text."""
    return tables.materialize(_prepared(spark, sf).select("uid", "label", "domain"), "prepared-keys")


def _splits(spark, sf):
    return split.stratified_split(split.stratify_key(_prepared_keys(spark, sf)))


def _text_splits(spark, sf):
    return split.stratified_split(split.stratify_key(_prepared_table(spark, sf)))


def _tok(spark, sf):
    return tokens.with_token_len(_prepared(spark, sf))


@query("label_remap")
def q_label_remap(spark, sf):
    return _prepared(spark, sf).groupBy("polarity", "label").agg(F.count(F.lit(1)).alias("n"))


@query("label_names")
def q_label_names(spark, sf):
    g = _prepared(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return g.select("label", label_name(F.col("label")).alias("label_name"), "n")


@query("stratify_keys")
def q_stratify_keys(spark, sf):
    return split.stratify_key(_prepared_keys(spark, sf)).select("uid", "stratify_key")


@query("stratified_split")
def q_stratified_split(spark, sf):
    return _splits(spark, sf).select("uid", "split")


@query("split_sizes")
def q_split_sizes(spark, sf):
    return split.split_sizes(_splits(spark, sf))


@query("split_label_share")
def q_split_label_share(spark, sf):
    return split.split_label_share(_splits(spark, sf))


@query("split_invariants")
def q_split_invariants(spark, sf):
    p = _prepared_keys(spark, sf)
    return split.split_invariants(split.stratified_split(split.stratify_key(p)), p)


# Domains kept by the domain filter of the training runs (one excluded).
DOMAIN_FILTER = ["de", "en", "fr"]


@query("domain_filter")
def q_domain_filter(spark, sf):
    return prep.filter_values(_splits(spark, sf), "domain", DOMAIN_FILTER).select("uid", "split", "domain", "label")


@query("class_weights")
def q_class_weights(spark, sf):
    train = _splits(spark, sf).filter(F.col("split") == "train")
    return metrics.class_weights(train).withColumn("weight", F.round("weight", 6))


# ---- tokens ---------------------------------------------------------------
@query("token_len")
def q_token_len(spark, sf):
    return _tok(spark, sf).select("uid", "token_len")


@query("token_describe")
def q_token_describe(spark, sf):
    return profile.describe(_tok(spark, sf), "token_len")


@query("token_quantiles")
def q_token_quantiles(spark, sf):
    return profile.quantiles(_tok(spark, sf), "token_len")


@query("token_stats_by_domain")
def q_token_stats_by_domain(spark, sf):
    return profile.group_stats(_tok(spark, sf), "domain", "token_len", qs=(0.9, 0.95))


@query("truncation_overall")
def q_truncation_overall(spark, sf):
    return tokens.truncation_overall(_tok(spark, sf))


@query("truncation_curve")
def q_truncation_curve(spark, sf):
    return tokens.truncation_curve(_tok(spark, sf), spark.range(4096).select(F.col("id").alias("max_length")))


# what the reference's token stage reads: the train split
def _train_tok(spark, sf):
    train = _text_splits(spark, sf).filter(F.col("split") == "train")
    return tables.materialize(tokens.with_token_len(train).select("uid", "domain", "token_len"), "train-tokens")


@query("train_token_stats")
def q_train_token_stats(spark, sf):
    t = _train_tok(spark, sf)
    whole = profile.group_stats(t.withColumn("domain", F.lit("(all)")), "domain", "token_len", qs=(0.9, 0.95, 0.99))
    return whole.unionByName(profile.group_stats(t, "domain", "token_len", qs=(0.9, 0.95, 0.99)))


@query("train_truncation")
def q_train_truncation(spark, sf):
    t = _train_tok(spark, sf)
    whole = tokens.truncation_by(t.withColumn("domain", F.lit("(all)")), "domain")
    return whole.unionByName(tokens.truncation_by(t, "domain"))


@query("train_recommend_max_length")
def q_train_recommend_max_length(spark, sf):
    return tokens.recommend_max_length(_train_tok(spark, sf), RECOMMEND_CANDIDATES)


@query("truncation_by_domain")
def q_truncation_by_domain(spark, sf):
    return tokens.truncation_by(_tok(spark, sf), "domain")


# the reference candidates, extended so that the "<= 5 %" branch is reachable on long texts
RECOMMEND_CANDIDATES = tokens.CANDIDATE_MAX_LENGTHS + (512, 768, 1024, 1536, 2048, 3072, 4096)


@query("recommend_max_length")
def q_recommend_max_length(spark, sf):
    return tokens.recommend_max_length(_tok(spark, sf), RECOMMEND_CANDIDATES)


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    d = tokens.with_truncated(_prepared(spark, sf), tokens.MAX_LENGTH)
    return d.select("uid", F.size("input_tokens").alias("kept_len"), F.array_join("input_tokens", " ").alias("truncated"))


@query("padding_share")
def q_padding_share(spark, sf):
    return tokens.padding_share(_tok(spark, sf), tokens.MAX_LENGTH)


@query("vocab_top")
def q_vocab_top(spark, sf):
    return tokens.build_vocab(_prepared(spark, sf), 50)


@query("wordpiece_len")
def q_wordpiece_len(spark, sf):
    p = _prepared_table(spark, sf)
    vocab = tokens.wordpiece_vocab(p)
    return tokens.wordpiece_len(p, vocab).select("uid", "wp_len")


@query("subword_len")
def q_subword_len(spark, sf):
    return tokens.subword_ids(_prepared(spark, sf), tokenizer_path(), tokens.MAX_LENGTH).select("uid", "subword_len", F.size("input_ids").alias("kept_len"))


# ---- metrics over fixture predictions ------------------------------------
@query("accuracy")
def q_accuracy(spark, sf):
    return metrics.accuracy(fx.predictions_long(spark, sf))


@query("f1_macro")
def q_f1_macro(spark, sf):
    return metrics.f1_macro(fx.predictions_long(spark, sf))


@query("classification_report")
def q_classification_report(spark, sf):
    return metrics.classification_report(fx.predictions_long(spark, sf))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(fx.predictions_long(spark, sf))


@query("argmax_prediction")
def q_argmax_prediction(spark, sf):
    p = fx.predictions(spark, sf).withColumn("scores", F.array("s0", "s1", "s2"))
    return metrics.argmax_prediction(p, "scores").select("doc_id", "pred")


@query("weighted_log_loss")
def q_weighted_log_loss(spark, sf):
    p = fx.predictions(spark, sf).withColumn("scores", F.array("s0", "s1", "s2"))
    return metrics.weighted_log_loss(p, "scores", "label", balanced=True)


@query("select_best")
def q_select_best(spark, sf):
    return metrics.select_best(fx.predictions_long(spark, sf))


def _fixture_runs(spark, sf):
    pl = fx.predictions_long(spark, sf)
    acc = metrics.accuracy(pl)
    f1 = metrics.f1_macro(pl)
    return acc.join(f1, "run").select(
        F.col("run").alias("run_tag"),
        F.col("accuracy").alias("test_accuracy"),
        F.col("f1_macro").alias("test_f1_macro"),
        F.col("n").alias("n_test"),
    )


@query("compare_runs")
def q_compare_runs(spark, sf):
    return runs.compare_runs(_fixture_runs(spark, sf), "a", "b", ("test_accuracy", "test_f1_macro", "n_test"))


# ---- ingest over fixture payload documents --------------------------------
PAYLOAD_ROOT = "/data/reviews"


def _exploded(spark, sf):
    raw = fx.payloads(spark, sf, PAYLOAD_ROOT)
    return json_ingest.with_provenance(json_ingest.explode_payloads(raw), PAYLOAD_ROOT)


@query("ingest_payload_rows")
def q_ingest_payload_rows(spark, sf):
    d = _exploded(spark, sf)
    return d.select(
        "file_path",
        "_pos",
        F.try_variant_get("_row", "$.Index", "string").alias("review_index"),
        F.try_variant_get("_row", "$.RawText", "string").alias("raw_text"),
    )


@query("ingest_payload_status")
def q_ingest_payload_status(spark, sf):
    st = json_ingest.payload_status(fx.payloads(spark, sf, PAYLOAD_ROOT))
    return json_ingest.with_provenance(st, PAYLOAD_ROOT).select("file_path", "kind", "n_rows", "n_skipped")


@query("ingest_ranged_rows")
def q_ingest_ranged_rows(spark, sf):
    """The payload documents as files, read in ranges of 64 KB."""
    raw = fx.payloads(spark, sf, PAYLOAD_ROOT)
    out = tables.scratch_path(spark, "lexiflow-payloads")
    tables.write_texts(raw.withColumn("file", F.hex(F.encode("path", "UTF-8"))), out, "file", "payload")
    tables.delete_on_exit(spark, out)
    rows = json_ranges.explode_ranges(spark, out, range_bytes=1 << 16, pattern="*.txt")
    named = rows.withColumn("path", F.decode(F.unhex(F.regexp_extract("path", "/file=([0-9A-F]+)[/-]", 1)), "UTF-8"))
    d = json_ingest.with_provenance(named, PAYLOAD_ROOT)
    texts = [F.try_variant_get("_row", f"$.{c}", "string") for c in ("Index", "RawText")]
    return d.select("file_path", F.col("_kind").alias("kind"), "_pos", "_is_object", texts[0].alias("review_index"), texts[1].alias("raw_text"))


@query("ingest_provenance")
def q_ingest_provenance(spark, sf):
    return _exploded(spark, sf).groupBy("file_path", "top_folder").agg(F.count(F.lit(1)).alias("n_rows"))


@query("ingest_contract_projection")
def q_ingest_contract_projection(spark, sf):
    return json_ingest.project_contract(_exploded(spark, sf))


@query("union_by_name_sources")
def q_union_by_name_sources(spark, sf):
    r = fx.reviews(spark, sf)
    shop = r.filter(F.col("top_folder") == "shop").select("review_index", "source", "domain", "top_folder", "pos")
    sns = r.filter(F.col("top_folder") == "sns").select("review_index", "domain", "main_category", "top_folder", "pos")
    return shop.unionByName(sns, allowMissingColumns=True)


# ---- tables written, read back and measured --------------------------------
CSV_SCHEMA = "pos bigint, review_index string, raw_text string, domain string, polarity string"


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    out = tables.scratch_path(spark, "lexiflow-csv")
    tables.write_table(fx.reviews_dirty(spark, sf).select("pos", "review_index", "raw_text", "domain", "polarity"), out, fmt="csv", bom=True)
    tables.delete_on_exit(spark, out)
    return tables.read_table(spark, out, "csv", CSV_SCHEMA)


@query("csv_quarantine")
def q_csv_quarantine(spark, sf):
    """CSV lines of which some have a field too few, one too many or no number where one belongs."""
    out = tables.scratch_path(spark, "lexiflow-csv")
    r, pos = fx.reviews(spark, sf), F.col("pos")
    line = F.when(pos % 7 == 0, F.concat_ws(",", pos, "domain")).when(pos % 11 == 0, F.concat_ws(",", pos, "domain", "main_category", F.lit("more")))
    line = line.when(pos % 13 == 0, F.concat_ws(",", F.concat(F.lit("no"), pos), "domain", "main_category")).otherwise(F.concat_ws(",", pos, "domain", "main_category"))
    r.select(line.alias("pos,domain,main_category")).write.option("header", True).option("quote", "\u0000").option("sep", "\u0001").csv(out)
    tables.delete_on_exit(spark, out)
    good, bad = tables.read_csv_checked(spark, out, "pos bigint, domain string, main_category string")
    return good.select("pos", "domain", "main_category", F.lit(None).cast("string").alias("record")).unionByName(bad.select("record"), allowMissingColumns=True)


@query("label_map_roundtrip")
def q_label_map_roundtrip(spark, sf):
    """Rows of each label of the prepared table, named by a label map that was written and read back."""
    out = tables.scratch_path(spark, "lexiflow-label-map")
    tables.write_record(tables.label_map_record(spark), out)
    tables.delete_on_exit(spark, out)
    counts = _prepared(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(tables.read_label_map(spark, out)), "label").select("label", "label_name", "n")  # a row a class


@query("dir_size")
def q_dir_size(spark, sf):
    """Bytes of the cleaned texts, written a line each into folders by domain."""
    out = tables.scratch_path(spark, "lexiflow-texts")
    d = prep.with_clean_text(fx.reviews_dirty(spark, sf)).select(F.coalesce("domain", F.lit("none")).alias("domain"), "text")
    d.write.partitionBy("domain").text(out)
    tables.delete_on_exit(spark, out)
    return tables.dir_size_mb(spark, out).select("n_bytes", F.round("size_mb", 6).alias("size_mb"))


# ---- training (pyspark.ml): what SQL can check of it ------------------------
@query("train_predict")
def q_train_predict(spark, sf):
    p = model.train_predict(_text_splits(spark, sf), max_length=tokens.MAX_LENGTH)
    return p.select("uid", "label", F.col("pred").between(0, 2).alias("predicted"))


@query("train_compare")
def q_train_compare(spark, sf):
    recs = model.train_compare(_text_splits(spark, sf), max_length=tokens.MAX_LENGTH)
    scored = F.col("test_accuracy").between(0, 1) & F.col("test_f1_macro").between(0, 1) & (F.col("trainable_params") <= F.col("total_params")) & (F.col("model_size_mb") > 0)
    return recs.select("run_tag", "n_train", "n_valid", "n_test", "total_params", scored.alias("scored"))
