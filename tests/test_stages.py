"""End to end: JSON files on disk -> the six stages -> tables and reports."""

import os

import pytest
from pyspark.sql import functions as F

from lexiflow.plans import fixtures as fx
from lexiflow.plans import stages

from .conftest import SF_SMALL


def _write_payload_files(spark, root):
    base = "/data/reviews"
    for r in fx.payloads(spark, SF_SMALL, base).collect():
        p = os.path.join(root, r.path[len(base) + 1 :])
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as f:
            f.write(r.payload)


def test_all_stages(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "json")
    out = os.path.join(tmpdir_path, "out")
    _write_payload_files(spark, root)

    rep = stages.stage_profile(spark, [root], out)
    combined = spark.read.parquet(f"{out}/combined")
    reviews = fx.reviews(spark, SF_SMALL)
    kept = reviews.filter(F.substring("main_category", 4, 10).cast("int") % 4 != 3)
    assert combined.count() == kept.count()
    kinds = {r.kind: r.n_files for r in rep["files_by_kind"].collect()}
    assert set(kinds) == {"array", "object", "corrupt"}
    assert os.path.isdir(f"{out}/reports/null_profile")

    rep = stages.stage_prepare(spark, out)
    inv = {r.check: r.n for r in rep["split_invariants"].collect()}
    assert set(inv.values()) == {0}
    splits = spark.read.parquet(f"{out}/splits")
    labelled = combined.filter(F.col("polarity").isNotNull()).count()
    assert 0 < splits.count() <= labelled
    assert {r.split for r in splits.select("split").distinct().collect()} == {"train", "valid", "test"}

    rep = stages.stage_lengths(spark, out)
    assert rep["box_by_domain"].count() == combined.select("domain").distinct().count()

    rep = stages.stage_tokens(spark, out, candidates=(64, 4096))
    assert rep["recommend_max_length"].first().recommended_max_length in (64, 4096)

    recs = stages.stage_train(spark, out)
    got = {r.run_tag: r for r in recs.collect()}
    assert sorted(t.split("-")[:3] for t in got) == [["compact", "all", "192"], ["wide", "all", "192"]]
    for tag, r in got.items():
        files = [os.path.join(d, f) for d, _, fs in os.walk(f"{out}/models/{tag}") for f in fs if not f.startswith(("_", "."))]
        assert files and abs(r.model_size_mb - sum(map(os.path.getsize, files)) / 2**20) < 1e-9
        assert 0 < r.trainable_params <= r.total_params and r.max_length == 192
    cmp = {r.metric: r for r in stages.stage_compare(spark, out, "wide", "compact").collect()}
    assert set(cmp) >= {"test_accuracy", "test_f1_macro", "trainable_params"}
    assert os.path.isdir(f"{out}/comparison")


def test_a_name_means_its_latest_run(spark):
    from lexiflow.operators import runs

    tags = ["wide-all-192-20250101T000000000001", "wide-en-256-20250301T000000000001", "wide-all-192-20250201T000000000001", "compact"]
    recs = spark.createDataFrame([(t,) for t in tags], "run_tag string")
    assert runs.resolve_tag(recs, "wide") == tags[1]
    assert runs.resolve_tag(recs, tags[0]) == tags[0] and runs.resolve_tag(recs, "compact") == "compact"
    with pytest.raises(ValueError):
        runs.resolve_tag(recs, "other")


def test_training_sees_texts_up_to_max_length(spark):
    from lexiflow.operators import model

    df = spark.createDataFrame([("a b c d e",), ("a b",), ("",)], "text string")
    feats = model.feature_pipeline(64, max_length=4).fit(df)
    assert [r._tokens for r in feats.transform(df).collect()] == [["a", "b"], ["a", "b"], []]
    assert [len(r._tokens) for r in model.feature_pipeline(64).fit(df).transform(df).collect()] == [5, 2, 0]
