"""Narrow keep-first, observed funnel, distributed rank, threshold table, CSV quarantine, one-scan loss, fit at its optimum, strict labels."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.functions.arrays import nll
from lexiflow.operators import metrics, model, prep, profile, runs, tokens
from lexiflow.plans import fixtures as fx
from lexiflow.plans import stages
from lexiflow.plans.inspect import formatted_plan, plan_facts
from lexiflow.sources import json_ingest as ji
from lexiflow.sources import tables

SF = "/root/testdata/sf0.001"


def brute_first(rows):
    best = {}
    for r in rows:
        place = (1 << 63) - 1 if r["pos"] is None else r["pos"]
        if r["uid"] not in best or (place, r["text"] or "") < best[r["uid"]][0]:
            best[r["uid"]] = ((place, r["text"] or ""), r)
    return sorted((r["uid"], r["pos"], r["text"]) for _, r in best.values())


def test_keep_first_with_hot_repeated_and_null_positions(spark):
    rng = random.Random(3)
    rows = [{"uid": "hot", "pos": i, "text": f"t{i}"} for i in range(3000, 0, -1)]
    rows += [{"uid": f"u{rng.randint(0, 300)}", "pos": 10_000 + i, "text": "x"} for i in range(1000)]
    rows += [{"uid": "twice", "pos": 5, "text": t} for t in ("b", "a", "a")] + [{"uid": "twice", "pos": 7, "text": "0"}]
    rows += [{"uid": "null", "pos": None, "text": "n"}, {"uid": "null", "pos": 3, "text": "m"}]
    df = spark.createDataFrame([(r["uid"], r["pos"], r["text"]) for r in rows], "uid string, pos long, text string")
    got = sorted(tuple(r) for r in prep.dedup_keep_first(df).select("uid", "pos", "text").collect())
    assert got == brute_first(rows)
    assert prep.dedup_keep_first(df.limit(0)).count() == 0


def test_no_text_is_shuffled_or_sorted_by_keep_first(spark):
    f = plan_facts(prep.prepare(fx.reviews_dirty(spark, SF)))
    assert f.count("SortAggregate") == 0 and f.count("Sort") == 0 and f.count("BroadcastHashJoin") >= 1
    assert f.exchanges_carrying("raw_text") == 0 and f.exchanges_carrying("text") == 0


def test_observed_funnel_equals_counted_funnel(spark):
    c = fx.reviews_dirty(spark, SF)
    funnel = prep.ObservedFunnel(c)
    written = tables.materialize(funnel.rows, "observed")
    want = sorted(tuple(r) for r in prep.prep_funnel(c).collect())
    assert sorted(tuple(r) for r in funnel.counts().collect()) == want
    assert written.count() == want[-1][2]
    assert sorted(written.select("uid", "text").collect()) == sorted(prep.prepare(c).select("uid", "text").collect())


def test_strict_labels_name_the_row(spark):
    rows = [("a.json", 0, "1", "good", "i0"), ("a.json", 1, " -1 ", "bad", "i1"), ("b.json", 7, "1.5", "odd", "i2")]
    df = spark.createDataFrame([(*r, "s", "d", "c", "p", "t") for r in rows], "file_path string, pos int, polarity string, raw_text string, review_index string, source string, domain string, main_category string, product_name string, top_folder string")
    assert prep.prepare(df).count() == 2
    with pytest.raises(Exception, match="label 1.5 is no integer: b.json row 7"):
        prep.prepare(df, strict=True).count()
    assert prep.prepare(df.where("pos < 7"), strict=True).count() == 2
    with pytest.raises(Exception, match="unmapped label"):
        prep.prepare(df.withColumn("polarity", F.lit("5")), strict=True).count()


def test_rank_of_many_groups_is_distributed(spark):
    rng = random.Random(8)
    rows = [(f"g{i}", rng.randint(0, 40)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(16)
    ranked = profile.distributed_rank(df, [F.desc("v"), F.asc("g")])
    assert "SinglePartition" not in formatted_plan(ranked)
    got = {r.g: r["rank"] for r in ranked.collect()}
    assert [g for g, _ in sorted(got.items(), key=lambda x: x[1])] == [g for g, v in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(got.values()) == list(range(1, 5001))
    assert profile.distributed_rank(df.limit(0), [F.desc("v"), F.asc("g")]).count() == 0


def test_truncation_curve_of_any_thresholds(spark):
    rng = random.Random(5)
    lengths = [rng.choice([0, 1, 7, 4095, 4096, 4097, 9000, 100_000]) for _ in range(500)] + [None]
    asked = [0, 1, 6, 7, 8, 4095, 4096, 4097, 8191, 99_999, 100_000, 2**31 - 1, -1, None, 7]
    df = spark.createDataFrame([(x,) for x in lengths], "token_len int")
    got = {r.max_length: (r.n_over, r.truncated_pct) for r in tokens.truncation_curve(df, spark.createDataFrame([(x,) for x in asked], "max_length int")).collect()}
    known = [x for x in lengths if x is not None]
    assert set(got) == {x for x in asked if x is not None}
    for t, (n, pct) in got.items():
        assert n == sum(x > t for x in known) and math.isclose(pct, round(n * 100 / len(known), 6), abs_tol=1e-6)


def test_subword_ids_equal_the_published_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["Hello world, hello!", "", None, "naïve 語 <|endoftext|>", "x" * 5000]
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in tokens.subword_ids(df, public.path("byte_bpe_50k.json"), 16).collect():
        ids = None if r.text is None else tok.encode(r.text, add_special_tokens=False).ids
        assert (r.input_ids, r.subword_len) == ((None, None) if ids is None else (ids[:16], len(ids)))


def test_csv_quarantine_keeps_records_whole(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w", encoding="utf-8") as f:
        f.write('﻿id,text\n1,"two\nlines, ""quoted"""\nx,no number\n2\n3,a,b\n4,\n')
    good, bad = tables.read_csv_checked(spark, f"{tmpdir_path}/a.csv", "id int, text string")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 'two\nlines, "quoted"'), (4, None)]
    assert sorted(r.record for r in bad.collect()) == ["2", "3,a,b", "x,no number"] and good.count() == 2
    with open(f"{tmpdir_path}/b.csv", "w", encoding="utf-8") as f:
        f.write("text,id\na,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv_checked(spark, f"{tmpdir_path}/b.csv", "id int, text string")[0].count()


def test_loss_reads_the_rows_once(spark):
    p = fx.predictions(spark, SF).withColumn("scores", F.array("s0", "s1", "s2"))
    once = metrics.weighted_log_loss(p, balanced=True)
    assert plan_facts(once).count("Scan parquet") == plan_facts(p).count("Scan parquet") > 0
    assert once.first() == metrics.weighted_log_loss(p, weights=metrics.class_weights(p)).first()
    plain = metrics.weighted_log_loss(p).first()
    want = p.agg(F.round(F.avg(nll(F.col("scores"), F.col("label"))), 6)).first()[0]
    assert plain["weighted_log_loss"] == plain["log_loss"] == want


def test_gradient_vanishes_at_the_fit(spark):
    rng = random.Random(2)
    words = [["good", "fine"], ["so", "meh"], ["bad", "poor"]]
    rows = [(y := rng.choice([0, 0, 0, 1, 2]), " ".join(rng.choice([*words[y], "the", "a", "so"]) for _ in range(12))) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, text string")
    w = model._weighted(df, metrics.class_weights(df), "label")
    feats = model.feature_pipeline(64).fit(w)
    f = feats.transform(w).persist()
    fitted, early = model.classifier(0.01, 200).fit(f), model.classifier(0.01, 1).fit(f)
    at_end, before = np.abs(model.loss_gradient(fitted, f)).max(), np.abs(model.loss_gradient(early, f)).max()
    assert at_end < 1e-3 and at_end < before / 20
    f.unpersist()


def test_shown_comparison_rounds_to_even_and_in_minutes(spark):
    assert [spark.range(1).select(runs.half_even(F.lit(x).cast("double"), 1)).first()[0] for x in (0.25, 0.35, 0.75)] == [0.2, 0.4, 0.8]
    cmp = spark.createDataFrame([("train_time_sec", 90.0, 45.0, -45.0, 0.5, 50.0, 2.0)], "metric string, run_a double, run_b double, diff double, ratio double, pct_reduction double, factor double")
    assert tuple(runs.present(cmp).first()) == ("train_time_min", 1.5, 0.75, -0.75, 0.5, 50.0, 2.0)


def test_records_of_other_trainers_keep_their_fields(spark, tmpdir_path):
    with open(f"{tmpdir_path}/r.json", "w") as f:
        json.dump({"run_tag": "x", "num_epochs": 5, "batch_size": 16, "learning_rate": 2e-5}, f, indent=2)
    r = tables.read_records(spark, f"{tmpdir_path}/r.json", runs.RUN_SCHEMA).first()
    assert (r.num_epochs, r.batch_size, r.learning_rate) == (5, 16, 2e-5)


def test_text_after_the_end_and_the_sessions_own_rule(spark):
    name = "spark.sql.variant.allowDuplicateKeys"
    spark.conf.set(name, "false")
    docs = ['[{"x":1}],"z":1', '{"r":[{"x":1}]},"z":1', '[{"x":1}],"q":[1]', '{"a":1},"a":1', '[{"x":1}]\n', "5 x", '[{"a":1,"a":2}]']
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "path string, payload string")
    kinds = {r.path: r.kind for r in ji.payload_status(df).collect()}
    assert [kinds[str(i)] for i in range(len(docs))] == ["corrupt"] * 4 + ["array", "corrupt", "corrupt"]
    with ji.last_of_repeated_keys(spark):
        assert {r.path: r.kind for r in ji.payload_status(df).collect()}["6"] == "array"
    assert spark.conf.get(name) == "false"
    spark.conf.set(name, "true")


def test_a_trained_run_is_reported(spark, tmpdir_path):
    rng = random.Random(1)
    rows = [(f"u{i}", " ".join(rng.choice([["good", "nice"], ["so", "hm"], ["bad", "awful"]][i % 3]) for _ in range(5)), i % 3, "d", ["train", "train", "valid", "test"][i % 4]) for i in range(120)]
    spark.createDataFrame(rows, "uid string, text string, label int, domain string, split string").write.partitionBy("split").parquet(f"{tmpdir_path}/splits")
    recs = stages.stage_train(spark, tmpdir_path)
    for tag in [r.run_tag for r in recs.collect()]:
        report = spark.read.json(f"{tmpdir_path}/reports/test/{tag}/classification_report").collect()
        assert {r.row for r in report} >= {"accuracy", "macro avg"} and spark.read.json(f"{tmpdir_path}/reports/test/{tag}/confusion_matrix").count() == 3


def test_encodings_of_a_batch_are_held_in_parts(spark):
    public = pytest.importorskip("public_tokenizers")
    words = " ".join(f"word{i % 97} of{i}" for i in range(700))
    df = spark.range(5000).repartition(1).select("id", F.when(F.col("id") % 50 == 3, None).when(F.col("id") % 50 == 4, "").otherwise(F.lit(words)).alias("text"))
    got = tokens.subword_ids(df, public.path("word_bpe_49k.json"), 4)

    @F.udf("double")
    def used(n):
        """MB that a Python worker of this Spark session has held at most."""
        import os

        top, parent = 0, f"PPid:\t{os.getppid()}\n"
        for pid in filter(str.isdigit, os.listdir("/proc")):
            try:
                with open(f"/proc/{pid}/status") as f:
                    state = f.read()
            except OSError:
                continue
            if parent in state:
                top = max(top, int(state.split("VmHWM:")[1].split()[0]) / 1024)
        return top

    top = got.withColumn("mb", used("subword_len")).agg(F.max("mb"), F.count("mb"), F.count_if(F.col("subword_len").isNull()), F.count_if(F.col("subword_len") == 0), F.max(F.size("input_ids"))).first()
    assert top[1:] == (5000, 100, 100, 4) and top[0] < 600


def test_odd_texts_in_parts_keep_their_rows(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    texts = [None, "", "one two three", None, "x y " * 40, "", "last", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    whole = tokens.subword_ids(df, public.path("word_bpe_49k.json")).collect()
    monkeypatch.setattr(tokens, "ENCODE_CHARS", 5)
    assert tokens.subword_ids(df, public.path("word_bpe_49k.json")).collect() == whole
    nothing = df.select("i", F.lit(None).cast("string").alias("text"))
    assert [r.input_ids for r in tokens.subword_ids(nothing, public.path("word_bpe_49k.json")).collect()] == [None] * 8
