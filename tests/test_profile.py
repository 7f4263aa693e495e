"""Profiles against numpy / pandas on the same rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexiflow.operators import profile
from lexiflow.plans import fixtures as fx

from .conftest import SF_MID


def _lens(spark):
    r = fx.reviews(spark, SF_MID)
    return r.withColumn("text_len", F.length("raw_text"))


def test_describe_and_quantiles(spark):
    d = _lens(spark)
    pdf = d.select("text_len").toPandas()["text_len"]
    desc = profile.describe(d, "text_len").first()
    ref = pdf.describe()
    assert desc["count"] == ref["count"]
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
        assert abs(desc[ours] - ref[theirs]) < 1e-6
    q = profile.quantiles(d, "text_len").first()
    assert abs(q.p99 - pdf.quantile(0.99)) < 1e-6


def test_box_stats_matplotlib_rule(spark):
    d = _lens(spark)
    pdf = d.select("domain", "text_len").toPandas()
    got = {r.domain: r for r in profile.box_stats(d, "domain", "text_len").collect()}
    for dom, g in pdf.groupby("domain"):
        x = g["text_len"].to_numpy()
        q1, med, q3 = np.percentile(x, [25, 50, 75])
        iqr = q3 - q1
        hi = x[x <= q3 + 1.5 * iqr]
        lo = x[x >= q1 - 1.5 * iqr]
        whishi = q3 if len(hi) == 0 or hi.max() < q3 else hi.max()
        whislo = q1 if len(lo) == 0 or lo.min() > q1 else lo.min()
        r = got[dom]
        assert abs(r.q1 - q1) < 1e-6 and abs(r.median - med) < 1e-6 and abs(r.q3 - q3) < 1e-6
        assert r.whislo == whislo and r.whishi == whishi


def test_histogram_matches_numpy(spark):
    d = _lens(spark)
    pdf = d.select("domain", "text_len").toPandas()
    p99 = pdf["text_len"].quantile(0.99)
    h = profile.histogram(d, "domain", "text_len").toPandas()
    for dom, g in pdf.groupby("domain"):
        sub = g["text_len"]
        clipped = sub[sub <= p99]
        counts, _ = np.histogram(clipped, bins=50)
        ours = h[h.domain == dom].sort_values("bin")
        assert list(ours.n) == list(counts)
        assert set(ours.n_total) == {len(sub)}


def test_histogram_equal_bounds(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("b", 1), ("b", 9)], "g string, v int")
    h = profile.histogram(df, "g", "v", clip_q=None).filter("n > 0").collect()
    bins = {(r.g, r.bin): r.n for r in h}
    assert bins[("a", 25)] == 2 and bins[("b", 0)] == 1 and bins[("b", 49)] == 1


def test_value_counts_nulls_and_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    kept = {r.k: r.n for r in profile.value_counts(df, "k", dropna=False).collect()}
    dropped = {r.k: r.n for r in profile.value_counts(df, "k").collect()}
    assert kept == {"a": 2, None: 2, "b": 1} and dropped == {"a": 2, "b": 1}
    assert profile.duplicate_count(df, ["k"]).first().n_dup == int(pd.Series(["a", "a", None, None, "b"]).duplicated().sum())


def test_top_values_and_median_rank(spark):
    df = spark.createDataFrame([("x", 1), ("y", 5), ("y", 7), ("z", 5), ("z", 5)], "g string, v int")
    top = [(r.g, r.rank) for r in profile.top_values(df, "g", 2).orderBy("rank").collect()]
    assert top == [("y", 1), ("z", 2)]
    med = [(r.rank, r.g) for r in profile.groups_by_median(df, "g", "v").orderBy("rank").collect()]
    assert med == [(1, "y"), (2, "z"), (3, "x")]


def test_duplicate_counts_one_scan_matches_pandas(spark):
    import random

    from lexiflow.plans.inspect import plan_facts

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", None, "y", "z"]), rng.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(rows, "k1 string, k2 string, keep boolean")
    out = profile.duplicate_counts(
        df, {"d1": F.struct("k1"), "d2": F.struct("k2"), "d3": F.when(F.col("keep"), F.struct("k1", "k2"))}
    )
    got = out.first()
    pdf = pd.DataFrame(rows, columns=["k1", "k2", "keep"])
    assert got.d1 == int(pdf.duplicated(subset=["k1"]).sum())
    assert got.d2 == int(pdf.duplicated(subset=["k2"]).sum())
    assert got.d3 == int(pdf[pdf.keep].duplicated(subset=["k1", "k2"]).sum())
    f = plan_facts(out)
    assert f.count("Expand") == 1 and f.count("Exchange") == 2  # grouping-sets shuffle + final single-row agg
