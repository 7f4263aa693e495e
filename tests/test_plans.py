"""Scale regressions read from physical plans (shuffles, broadcasts, Python)."""

import pytest

from lexiflow.operators import prep, profile, split
from lexiflow.plans import fixtures as fx
from lexiflow.plans import queries as Q
from lexiflow.plans.inspect import plan_facts
from lexiflow.sources import tables

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def prepared_table(spark):
    return tables.materialize(prep.prepare(fx.reviews(spark, SF_SMALL)), "prepared-test")


def test_prepare_shuffles_nothing(spark):
    f = plan_facts(prep.prepare(fx.reviews(spark, SF_SMALL)))
    # the losing keys of the de-duplication are a written, narrow table and broadcast,
    # like the label table of the fixture
    assert f.count("Exchange") == 0 and f.count("SortAggregate") == 0
    assert f.count("SortMergeJoin") == 0


def test_split_moves_no_text(spark, prepared_table):
    s = split.stratified_split(split.stratify_key(prepared_table))
    f = plan_facts(s)
    # one scan, one comparison with broadcast cut points: no shuffle, no window, no second branch
    assert f.count("Exchange") == 0 and f.count("Window") == 0 and f.count("Union") == 0
    narrow = plan_facts(s.select("uid", "split"))
    assert narrow.exchanges_carrying("text") == 0
    assert f.count("SortMergeJoin") == 0
    assert f.count("BroadcastHashJoin") >= 2


def test_box_stats_broadcasts_group_table(spark):
    r = fx.reviews(spark, SF_SMALL).selectExpr("domain", "length(raw_text) as n")
    f = plan_facts(profile.box_stats(r, "domain", "n"))
    assert f.count("SortMergeJoin") == 0 and f.count("BroadcastHashJoin") >= 1


def test_no_row_at_a_time_python(spark):
    for key, fn in Q.QUERIES.items():
        if key in ("train_predict", "train_compare"):
            continue  # fitted models; their plans are pyspark.ml transforms
        f = plan_facts(fn(spark, SF_SMALL))
        assert f.count("BatchEvalPython") == 0, key
        if key not in ("wordpiece_len", "subword_len"):
            assert f.count("ArrowEvalPython") == 0, key


def test_hot_uid_dedup_combines_map_side(spark):
    # a third or more of the rows share one uid (rows without Index in one file)
    rows = [("big.json", None, f"t{i}", "1", i, "d", "c", "shop") for i in range(3000)]
    rows += [(f"f{i}.json", str(i), f"u{i}", "0", i, "d", "c", "shop") for i in range(3000)]
    df = spark.createDataFrame(rows, "file_path string, review_index string, raw_text string, polarity string, pos int, domain string, main_category string, source string").repartition(8)
    kept = prep.dedup_keep_first(prep.with_uid(df))
    hot = kept.filter("uid = 'big.json::nan'").collect()
    assert len(hot) == 1 and hot[0].pos == 0 and hot[0].raw_text == "t0"
    assert kept.count() == 3001
    f = plan_facts(kept)
    # rows meet the written losing keys where they are; the one shuffle is this test's own
    assert f.count("Exchange") == 1 and f.count("BroadcastHashJoin") == 1
