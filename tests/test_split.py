"""Stratified split: exact quotas, equal to brute force, invariants."""

import hashlib
from collections import Counter

import pytest

from lexiflow.operators import split
from lexiflow.operators.prep import prepare
from lexiflow.plans import fixtures as fx

from .conftest import SF_MID


def largest_remainder(counts: dict, target: int) -> dict:
    total = sum(counts.values())
    fl = {k: (c * target) // total if total else 0 for k, c in counts.items()}
    rem = {k: (c * target) % total if total else 0 for k, c in counts.items()}
    left = target - sum(fl.values())
    for k in sorted(counts, key=lambda k: (-rem[k], k))[:left]:
        fl[k] += 1
    return fl


def brute_split(rows, seed=42):
    """rows: list of (uid, key) -> {uid: split}."""
    sizes = Counter(k for _, k in rows)
    n = sum(sizes.values())
    n_temp = -(-n * 2 // 10)
    train_q = largest_remainder(sizes, n - n_temp)
    temp_q = {k: sizes[k] - train_q[k] for k in sizes}
    n_test = -(-n_temp // 2)
    valid_q = largest_remainder(temp_q, n_temp - n_test)
    out = {}
    for k in sizes:
        members = sorted((hashlib.md5(f"{seed}|{u}".encode()).hexdigest(), u) for u, kk in rows if kk == k)
        t = temp_q[k] - valid_q[k]
        for i, (_, u) in enumerate(members, start=1):
            out[u] = "test" if i <= t else ("valid" if i <= t + valid_q[k] else "train")
    return out


@pytest.fixture(scope="module")
def keyed(spark):
    return split.stratify_key(prepare(fx.reviews(spark, SF_MID))).cache()


def test_split_matches_brute_force(spark, keyed):
    rows = [(r.uid, r.stratify_key) for r in keyed.select("uid", "stratify_key").collect()]
    expect = brute_split(rows)
    got = {r.uid: r.split for r in split.stratified_split(keyed).select("uid", "split").collect()}
    assert got == expect
    assert Counter(got.values()) == Counter({"train": 319, "valid": 40, "test": 40})


@pytest.mark.parametrize(("digits", "levels"), [(1, 1), (1, 3), (2, 1), (2, 2)])
def test_levels_do_not_change_the_split(spark, keyed, digits, levels):
    base = {r.uid: r.split for r in split.stratified_split(keyed).collect()}
    assert {r.uid: r.split for r in split.stratified_split(keyed, digits=digits, levels=levels).collect()} == base


def test_repeated_uids_and_nulls(spark):
    # a hot uid shares one split; null keys and uids keep their rows; an empty table stays empty
    rows = [("hot", "k")] * 300 + [(f"u{i}", "k") for i in range(600)] + [(f"n{i}", None) for i in range(50)] + [(None, "k")]
    df = spark.createDataFrame(rows, "uid string, stratify_key string")
    got = split.stratified_split(df, digits=1, levels=1).collect()
    assert len(got) == len(rows) and {r.split for r in got if r.uid == "hot"} in ({"train"}, {"valid"}, {"test"})
    assert sum(r.split != "train" for r in got if r.stratify_key is None) in (9, 10, 11)
    empty = split.stratified_split(df.limit(0))
    assert empty.columns == ["uid", "stratify_key", "split"] and empty.count() == 0


def test_rare_keys_fall_back_to_label(spark):
    data = [(f"u{i}", 2, "big") for i in range(20)] + [("r1", 0, "tiny"), ("r2", 0, "tiny"), ("s1", 1, "one")]
    df = spark.createDataFrame(data, "uid string, label int, domain string")
    keys = {r.uid: r.stratify_key for r in split.stratify_key(df).collect()}
    assert keys["u0"] == "2_big" and keys["r1"] == "0" and keys["s1"] == "1"
    s = split.stratified_split(split.stratify_key(df))
    got = Counter(r.split for r in s.collect())
    assert sum(got.values()) == 23 and got["valid"] + got["test"] == 5


def test_invariants_zero(spark, keyed):
    s = split.stratified_split(keyed)
    inv = {r.check: r.n for r in split.split_invariants(s, keyed).collect()}
    assert set(inv.values()) == {0}


def test_quota_totals(spark):
    sizes = spark.createDataFrame([(f"k{i}", c) for i, c in enumerate([1, 2, 3, 5, 8, 13, 21, 34])], "stratify_key string, c long")
    q = split.stratum_quotas(sizes).collect()
    n = sum(r.c for r in q)
    assert sum(r.valid_q + r.test_q for r in q) == -(-n * 2 // 10)
    assert sum(r.test_q for r in q) == -(-(-(-n * 2 // 10)) // 2)
    assert all(r.train_q + r.valid_q + r.test_q == r.c and min(r.train_q, r.valid_q, r.test_q) >= 0 for r in q)


def test_invariants_match_setops(spark, keyed):
    sel = split.stratified_split(keyed)
    # a deliberately broken split: one train uid also listed as valid
    broken = sel.filter("split = 'train'").limit(1).withColumn("split", split.F.lit("valid")).unionByName(sel)
    inv = {r.check: r.n for r in split.split_invariants(broken, keyed).collect()}
    ids = {s: broken.filter(split.F.col("split") == s).select("uid") for s in split.SPLITS}
    assert inv["train_valid_overlap"] == ids["train"].intersectAll(ids["valid"]).count() == 1
    assert inv["extra_in_splits"] == broken.select("uid").exceptAll(keyed.select("uid")).count() == 1
    assert inv["missing_from_splits"] == keyed.select("uid").exceptAll(broken.select("uid")).count() == 0


def test_hot_stratum_matches_brute_force(spark):
    # one stratum holds ~90 % of the rows
    rows = [(f"h{i}", 2, "big") for i in range(9000)] + [(f"s{i}", i % 2, "small") for i in range(1000)]
    df = spark.createDataFrame(rows, "uid string, label int, domain string")
    keyed = split.stratify_key(df)
    got = {r.uid: r.split for r in split.stratified_split(keyed, digits=1).collect()}
    expect = brute_split([(r.uid, r.stratify_key) for r in keyed.collect()])
    assert got == expect
