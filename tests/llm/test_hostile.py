"""Rare languages, other tokenizers, spaceless texts and hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiflow.llm import packing as pk
from lexiflow.llm.fingerprints import fingerprint_edits, with_next
from lexiflow.llm.language_id import MIN_COUNT, language_id, least_count
from lexiflow.llm.quality import expectation_maximisation, fit_scorer, pattern, score_quality
from lexiflow.llm.queries import tokenizer_path


def test_a_language_of_four_short_texts_is_learned(spark):
    rng = random.Random(41)
    english = "the story was told to all who came and sat by the fire in winter".split()
    own = [chr(0x10A0 + i) for i in range(30)]
    rows = [(i, " ".join(rng.choice(english) for _ in range(40)), "en") for i in range(2000)]
    rows += [(5000 + i, " ".join("".join(own[(i + j + k) % 30] for k in range(4)) for j in range(12)), "xx") for i in range(8)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got if r.doc_id >= 5000} == {"xx"} and {r.lang_pred for r in got if r.doc_id < 5000} == {"en"}
    assert least_count(4, 20_000) == 1 and least_count(10**9, 20_000) == MIN_COUNT


def test_other_tokenizers_give_their_own_ids():
    text = "The  quick Brown fox,\nit's 42 " + "naïve 工作 " * 50
    for name, composed in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        w = pk.WordIds(tokenizer_path(name))
        assert w.composed is composed
        assert w.ids(text) == w.encoded(text) == w.ids(text)
        assert w.tok.encode(text, add_special_tokens=False).ids == Tokenizer.from_file(tokenizer_path(name)).encode(text, add_special_tokens=False).ids


def test_long_parts_are_not_remembered():
    w = pk.WordIds(tokenizer_path())
    before = len(w), len(w.words)
    for i in range(30):
        part = ("a" * 700 + str(i)) * 20
        assert w.ids(part) == w.encoded(part)
    assert max(map(len, w)) <= pk.KEPT_CHARS and max(map(len, w.words)) <= pk.KEPT_CHARS
    assert len(w) == before[0]


@pytest.mark.parametrize("buckets", [1, 7, None])
def test_next_document_of_null_and_repeated_ids(spark, tmp_path, buckets):
    low = -(1 << 63)
    rows = [(None, f"null {i}") for i in range(90)] + [(7, f"seven {i}") for i in range(40)] + [(9, "same text")] * 60 + [(i, None) for i in range(20, 40)]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    src = spark.read.parquet(f"{tmp_path}/d").select(F.coalesce("doc_id", F.lit(low)).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [(r.id, r.text) for r in src.orderBy(F.col("id").desc(), F.xxhash64("text")).collect()]
    got = with_next(src, buckets).where("not ghost").collect()
    assert sorted((r.id, r.text, r.next_text) for r in got) == sorted((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order))
    if buckets == 7:
        assert max(sum(r.bucket == b for r in got) for b in range(7)) < 60  # neither the null id nor the repeated row is one bucket
    out = fingerprint_edits(spark.read.parquet(f"{tmp_path}/d")).collect()
    assert sorted((r.doc_id or 0) for r in out) == sorted((r[0] or 0) for r in rows)


def test_fingerprints_of_one_row(spark):
    one = fingerprint_edits(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(3, 7, 1.0)]


def test_expectation_maximisation_equals_row_by_row_version():
    rng = random.Random(5)
    truth = [rng.random() < 0.7 for _ in range(400)]
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    votes = [[2 if rng.random() < 0.3 else int(t) if rng.random() < r else int(not t) for r in right] for t in truth]
    post = [min(max((v.count(1) + 0.5) / (v.count(0) + v.count(1) + 1), 0.05), 0.95) for v in votes]
    for _ in range(200):
        p = {(c, i, x): 1.0 for c in (0, 1) for i in range(5) for x in (0, 1)}
        for v, q in zip(votes, post, strict=True):
            for i, x in enumerate(v):
                if x != 2:
                    p[0, i, x] += 1 - q
                    p[1, i, x] += q
        share = sum(post) / len(post)
        like = lambda v, c: np.prod([p[c, i, x] / (p[c, i, 0] + p[c, i, 1]) for i, x in enumerate(v) if x != 2])  # noqa: B023, E731
        post = [share * like(v, 1) / (share * like(v, 1) + (1 - share) * like(v, 0)) for v in votes]
    patterns, counts = np.unique(pattern(np.array(votes)), return_counts=True)
    got, probs, estimated = expectation_maximisation(patterns, counts, labellers=5)
    known = dict(zip(patterns.tolist(), got.tolist(), strict=True))
    assert max(abs(known[k] - q) for k, q in zip(pattern(np.array(votes)).tolist(), post, strict=True)) < 1e-6
    assert abs(estimated - 0.7) < 0.05 and all(abs(probs[1, i, 1] - r) < 0.08 for i, r in enumerate(right))


def test_scorer_equals_newton_steps():
    rng = np.random.default_rng(6)
    x = np.sqrt(rng.dirichlet(np.ones(6), 80)).astype(np.float32)
    y = 1 / (1 + np.exp(-(x @ np.array([3, -3, 2, 0, -1, 1]) + rng.normal(0, 0.3, 80))))
    w, b = fit_scorer(x, y.astype(np.float32), rounds=4000, ridge=1e-2)
    z, t = np.hstack([x, np.ones((80, 1))]).astype(float), np.zeros(7)
    pen = np.diag([1e-2] * 6 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ t))
        t -= np.linalg.solve((z.T * (p * (1 - p))) @ z / 80 + pen, z.T @ (p - y) / 80 + pen @ t)
    assert np.abs(np.append(w, b) - t).max() < 1e-2


def test_quality_of_repeated_texts_and_a_column_named_text(spark):
    good = ["The people of the town went to the river, and they talked of the old days. " * 3 + f"Then it was day {i}." for i in range(60)]
    bad = [f"BUY $$$ NOW!!! #{i} %%% CLICK | HERE | " * 8 for i in range(60)]
    rows = [(None, t, "x") for t in good + bad] + [(None, bad[0], "y")] * 500 + [(1, None, "z"), (2, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string")
    out = score_quality(df, ["text", "_text"], sample_rows=30).collect()
    assert out[0].__fields__ == ["text", "_text", "weak_label", "quality_score"] and len(out) == len(rows)
    assert {r._text for r in out} == {"x", "y", "z"}
    score = {r.text: r.quality_score for r in out}
    assert min(score[t] for t in good) > 0.5 > max(score[t] for t in bad) and score[None] == score[""] == 0


def test_marks_and_runs_of_marks_keep_their_ids():
    w = pk.WordIds(tokenizer_path())
    rng = random.Random(8)
    bits = ["word", "Word", "É", "ñandú", "42", "...", "..", ",", ".", "!,", "_", "_,", "a_.", "́,", "工作.", "ΟΔΟΣ,", "İ.", "<|endoftext|>", "<|ENDOFTEXT|>.", "\x1c", "\x7f", "\x00x", "\t", "'s,", "l'été.", " ", "  ", "\n"]
    for _ in range(400):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", ", ", ". ", "\n"]) for _ in range(12))
        assert w.ids(text) == w.encoded(text), text
    # a part with its comma is no entry of its own
    w.ids("Alpha, alpha. Alpha alpha ")
    assert "alpha" in w and not {"Alpha", "Alpha,", "alpha,", "alpha."} & set(w)
