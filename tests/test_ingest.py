"""Ingest of review JSON files written into a fresh temporary folder."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexiflow.sources import json_ingest as ji
from lexiflow.sources import tables


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)


def rev(i, text="good", pol="1", **extra):
    d = {"Index": i, "RawText": text, "Source": "shop", "Domain": "d1", "MainCategory": "c1", "GeneralPolarity": pol}
    d.update(extra)
    return d


@pytest.fixture()
def tree(tmpdir_path):
    root = tmpdir_path
    _write(root, "a/b/array.json", json.dumps([rev("1"), rev("2", pol=-1), rev("3", pol=1.5)]))
    _write(root, "c/object_with_list.json", json.dumps({"meta": "[x", "rows": [rev("4"), rev("5")], "other": [rev("99")]}))
    _write(root, "c/single_object.json", json.dumps(rev("6", pol="x")))
    _write(root, "c/scalar.json", "42")
    _write(root, "c/corrupt.json", '[{"Index": "7", "RawText": "cut')
    _write(root, "c/empty_array.json", "[]")
    _write(root, "c/mixed_elements.json", json.dumps([rev("8"), 5, "s", rev("9", pol=None)]))
    _write(root, "c/duplicate_keys.json", '{"Index": "10", "Index": "11", "RawText": "dup"}')
    _write(root, "_skipped/x.json", json.dumps([rev("12")]))
    _write(root, "c/notes.txt", "not json")
    return root


def test_shapes_and_status(spark, tree):
    raw = ji.read_raw(spark, tree)
    st = {os.path.basename(r.file_path): r for r in ji.with_provenance(ji.payload_status(raw), tree).collect()}
    assert st["array.json"].kind == "array" and st["array.json"].n_rows == 3
    assert st["object_with_list.json"].kind == "object" and st["object_with_list.json"].n_rows == 2
    assert st["single_object.json"].kind == "object" and st["single_object.json"].n_rows == 1
    assert st["scalar.json"].kind == "scalar" and st["scalar.json"].n_rows == 0
    assert st["corrupt.json"].kind == "corrupt" and st["corrupt.json"].n_rows == 0
    assert st["empty_array.json"].kind == "array" and st["empty_array.json"].n_rows == 0
    assert st["mixed_elements.json"].n_rows == 2 and st["mixed_elements.json"].n_skipped == 2
    # of a repeated key the last value counts
    assert st["duplicate_keys.json"].kind == "object" and st["duplicate_keys.json"].n_rows == 1
    assert "x.json" not in st  # '_' folders are skipped by Spark's file index


def test_contract_rows(spark, tree):
    rows = ji.load_reviews(spark, tree).collect()
    by_idx = {r.review_index: r for r in rows}
    assert set(by_idx) == {"1", "2", "3", "4", "5", "6", "8", "9", "11"}
    assert by_idx["1"].file_path == "a/b/array.json" and by_idx["1"].top_folder == "a"
    assert by_idx["5"].pos == 1 and by_idx["5"].top_folder == "c"
    # label rule: text must be an integer, numbers truncate
    assert by_idx["1"].label_int == 1
    assert by_idx["2"].label_int == -1 and by_idx["2"].polarity == "-1"
    assert by_idx["3"].label_int == 1
    assert by_idx["6"].label_int is None
    assert by_idx["9"].polarity is None and by_idx["9"].label_int is None
    assert by_idx["1"].product_name is None  # absent field -> null


def test_object_rule_row(spark, tree):
    raw = ji.read_raw(spark, tree)
    rows = ji.explode_payloads(raw, object_rule="row").filter(F.col("path").endswith("object_with_list.json")).collect()
    assert len(rows) == 1


def test_empty_root_raises(spark, tmpdir_path):
    _write(tmpdir_path, "x/readme.txt", "nothing")
    with pytest.raises(FileNotFoundError):
        ji.read_raw(spark, tmpdir_path)


def test_union_of_roots(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "shop")
    b = os.path.join(tmpdir_path, "sns")
    _write(a, "f.json", json.dumps([{"Index": "1", "RawText": "x", "Source": "shop"}]))
    _write(b, "g.json", json.dumps([{"Index": "2", "RawText": "y", "MainCategory": "m"}]))
    df = ji.load_many(spark, [a, b])
    rows = sorted(df.collect(), key=lambda r: r.review_index)
    assert rows[0].source == "shop" and rows[0].main_category is None
    assert rows[1].source is None and rows[1].main_category == "m"


def test_csv_roundtrip_with_bom(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w", encoding="utf-8-sig", newline="") as f:
        f.write('uid,text,label\nf::1,"line one\nline ""two""",2\n')
    df = tables.read_table(spark, p, fmt="csv", schema=None)
    assert df.columns == ["uid", "text", "label"]
    r = df.collect()[0]
    assert r.text == 'line one\nline "two"'
    out = os.path.join(tmpdir_path, "out")
    tables.write_table(df, out, fmt="parquet")
    assert tables.read_table(spark, out).count() == 1


def test_records_and_dir_size(spark, tmpdir_path):
    from lexiflow.operators.runs import RUN_SCHEMA, compare_runs, run_record

    for tag, acc in (("full", 0.91), ("adapter", 0.90)):
        rec = {"run_tag": tag, "method": tag, "test_accuracy": acc, "test_f1_macro": acc - 0.03, "train_time_sec": 100.0 if tag == "full" else 60.0}
        with open(os.path.join(tmpdir_path, f"{tag}_results.json"), "w") as f:
            json.dump(rec, f, indent=2)
    runs = tables.read_records(spark, os.path.join(tmpdir_path, "*_results.json"), RUN_SCHEMA)
    assert runs.count() == 2
    cmp = {r.metric: r for r in compare_runs(runs, "full", "adapter").collect()}
    assert cmp["train_time_sec"].pct_reduction == 40.0
    assert abs(cmp["test_accuracy"].diff - (-0.01)) < 1e-9
    rec = run_record(spark, run_tag="x", test_accuracy=0.5)
    out = os.path.join(tmpdir_path, "rec")
    tables.write_record(rec, out)
    size = tables.dir_size_mb(spark, out).first()
    on_disk = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(out) for f in fs if not f.startswith((".", "_")))
    assert size.n_bytes == on_disk
    lm = tables.label_map_record(spark).first()
    assert lm.id2label["0"] and lm.label2id[lm.id2label["2"]] == 2


def test_streaming_ingest(spark, tree, tmpdir_path):
    from lexiflow.streaming.ingest import contract_stream, start_ingest

    out = os.path.join(tmpdir_path, "out")
    q = start_ingest(contract_stream(spark, tree), out, os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    batch = ji.load_reviews(spark, tree).select("review_index").collect()
    streamed = spark.read.parquet(out).select("review_index", "text").collect()
    assert sorted(r.review_index for r in streamed) == sorted(r.review_index for r in batch)


def test_csv_bom_export_and_label_map(spark, tmpdir_path):
    df = spark.createDataFrame([("f::1", 'a, "b"\nc', 2)], "uid string, text string, label int")
    out = os.path.join(tmpdir_path, "csv")
    tables.write_table(df, out, fmt="csv", bom=True)
    part = [f for f in os.listdir(out) if f.endswith(".csv")][0]
    with open(os.path.join(out, part), "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"
    back = tables.read_table(spark, out, fmt="csv")
    assert back.columns == ["uid", "text", "label"] and back.first().text == 'a, "b"\nc'
    lm = os.path.join(tmpdir_path, "label_map")
    tables.write_record(tables.label_map_record(spark), lm)
    rows = {r.label: r.label_name for r in tables.read_label_map(spark, lm).collect()}
    assert sorted(rows) == [0, 1, 2]


def test_kind_after_long_leading_whitespace(spark):
    docs = [("a", " " * 1000 + '[{"Index": "1"}]'), ("b", "\n" * 300 + '{"Index": "2"}'), ("c", "   7")]
    df = spark.createDataFrame(docs, "path string, payload string")
    kinds = {r.path: r.kind for r in ji.payload_status(df).collect()}
    assert kinds == {"a": "array", "b": "object", "c": "scalar"}


def test_status_from_single_parse_equals_payload_status(spark, tree):
    raw = ji.read_raw(spark, tree)
    a = sorted(tuple(r) for r in ji.payload_status(raw).collect())
    b = sorted(tuple(r) for r in ji.status_from_exploded(ji.explode_all(raw)).select("path", "kind", "n_rows", "n_skipped").collect())
    assert a == b
    rows = ji.explode_all(raw).filter("_is_object").count()
    assert rows == ji.explode_payloads(raw).count()
