"""Token lengths, truncation tables, recommendation, WordPiece."""

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import tokens


def test_truncation_and_recommend(spark):
    lens = [10] * 90 + [100] * 6 + [1000] * 4
    df = spark.createDataFrame([(i, n, "d" + str(i % 2)) for i, n in enumerate(lens)], "i int, token_len int, domain string")
    tr = {r.max_length: r.truncated_pct for r in tokens.truncation_overall(df, (8, 64, 128, 2048)).collect()}
    assert tr == {8: 100.0, 64: 10.0, 128: 4.0, 2048: 0.0}
    rec = tokens.recommend_max_length(df, (8, 64, 128, 2048)).first()
    assert rec.recommended_max_length == 128 and rec.truncated_pct == 4.0
    # exactly 5 % counts as "<= 5 %"
    df5 = spark.createDataFrame([(n,) for n in [1] * 95 + [50] * 5], "token_len int")
    assert tokens.recommend_max_length(df5, (10, 100)).first().recommended_max_length == 10
    # nothing under the limit -> the last candidate
    assert tokens.recommend_max_length(df, (8, 9)).first().recommended_max_length == 9
    by = tokens.truncation_by(df, "domain", (64,)).collect()
    assert sum(r["count"] for r in by) == 100


def test_padding_share(spark):
    df = spark.createDataFrame([(3,), (10,)], "token_len int")
    r = tokens.padding_share(df, 8).first()
    assert (r.real_tokens, r.pad_tokens) == (11, 5) and abs(r.padding_pct - 5 * 100 / 16) < 1e-9
    feats = tokens.pad_features(spark.createDataFrame([("a b",)], "text string"), 6).first()
    assert feats.input_tokens == ["[CLS]", "a", "b", "[SEP]", "[PAD]", "[PAD]"]
    assert feats.attention_mask == [1, 1, 1, 1, 0, 0]


def test_wordpiece_greedy(spark):
    vocab = spark.createDataFrame([(p,) for p in ["un", "##aff", "##able", "hello", "a", "##b"]], "piece string")
    df = spark.createDataFrame([(1, "unaffable hello"), (2, "ab zz"), (3, None)], "id int, text string")
    got = {r.id: r.wp_len for r in tokens.wordpiece_len(df, vocab).collect()}
    # un ##aff ##able | hello -> 4 pieces; ab -> a ##b, zz -> [UNK]
    assert got == {1: 4 + 2, 2: 3 + 2, 3: None}


def test_build_vocab_rank(spark):
    df = spark.createDataFrame([("b a b c b a",)], "text string")
    v = [(r.rank, r.token, r.n) for r in tokens.build_vocab(df, 2).orderBy("rank").collect()]
    assert v == [(1, "b", 3), (2, "a", 2)]
    wv = {r.piece for r in tokens.wordpiece_vocab(df, 1, 2).collect()}
    assert wv == {"b", "a", "##b", "##a"}


def test_wordpiece_udf_is_self_contained(spark, tmpdir_path):
    # executors need not have this package on their path: the pickled UDF is
    # loaded and run in a fresh interpreter that cannot import it
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lexiflow.operators.tokens import wordpiece_udf

    blob = os.path.join(tmpdir_path, "udf.pkl")
    with open(blob, "wb") as f:
        f.write(cloudpickle.dumps(wordpiece_udf(frozenset({"a", "##b"})).func))
    code = (
        "import pickle, sys, pandas as pd\n"
        "assert not any('repo' in p for p in sys.path)\n"
        f"fn = pickle.load(open({blob!r}, 'rb'))\n"
        "print([int(x) for x in fn(pd.Series(['ab a', 'zz']))])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmpdir_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip() == "[5, 3]"  # (a ##b) + a + 2 specials; [UNK] + 2 specials


def test_python_and_java_tokenizers_agree(spark):
    # with every token in the vocabulary each word is one piece, so the
    # Python-side count must equal the JVM regexp_count on every row
    from lexiflow.operators.prep import prepare
    from lexiflow.plans import fixtures as fx

    from .conftest import SF_SMALL

    p = tokens.with_token_len(prepare(fx.reviews(spark, SF_SMALL)))
    vocab = tokens.token_counts(p).select(F.col("token").alias("piece"))
    rows = tokens.wordpiece_len(p, vocab, max_chars=10_000).select("token_len", "wp_len").collect()
    assert len(rows) > 50 and all(r.token_len == r.wp_len for r in rows)


def test_wordpiece_bounds(spark, monkeypatch):
    df = spark.createDataFrame([("abababab",)], "text string")
    vocab = spark.createDataFrame([("a",), ("##b",), ("##a",)], "piece string")
    assert tokens.wordpiece_len(df, vocab, max_chars=4).first().wp_len == 3
    assert tokens.wordpiece_len(df, vocab, max_chars=None).first().wp_len == 10
    monkeypatch.setattr(tokens, "MAX_PIECES", 2)
    with pytest.raises(ValueError, match="more than 2 pieces"):
        tokens.wordpiece_len(df, vocab)
