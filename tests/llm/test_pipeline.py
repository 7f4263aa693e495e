"""The pipeline stage by stage, and the SQL of the queries."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
import corpus_pipeline
from lexiflow.llm.oracles import ORACLES
from lexiflow.sources.tables import materialize

SF = "/root/testdata/sf0.001"


def test_registered():
    names = entry_mod.queries()
    assert [n for n in range(1, 11) if any(k.startswith(f"op{n}_") for k in names)] == list(range(1, 11))
    assert "pipeline" in names


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[key]).df()
    got = entry_mod.queries()[key](spark, SF).toPandas()[list(want.columns)]
    by = lambda d: sorted(map(tuple, d.astype(str).values.tolist()))
    assert by(got) == by(want)


def test_stages_keep_columns_and_pass_on_rows(spark):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = {"score": "1", "kept_row": "2", "row": "x", "a.b": "4", "gone": "5"}
    docs = docs.selectExpr("*", *[f"'{v}' as `{k}`" for k, v in extra.items()])
    columns, counts = docs.dtypes, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
        counts.append(docs.count())
        if name != "packing":
            assert docs.dtypes == columns
    junk, same, near, _, pieces = counts[1:]
    assert first.count() > junk == same >= near > 0
    assert pieces >= counts[4]


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "t")
        assert docs.count() == 0
