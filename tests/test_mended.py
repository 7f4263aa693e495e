"""Large and odd files, provenance of URIs, checks that column pruning must not remove."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from lexiflow import session
from lexiflow.operators import prep, runs
from lexiflow.sources import json_ingest as ji


def test_a_valid_file_above_the_variant_limit_keeps_all_rows(spark):
    root = tempfile.mkdtemp(prefix="lexiflow-large-")
    review = json.dumps({"Index": 1, "RawText": "x" * 1000, "GeneralPolarity": "1"})
    n = 140_000
    with open(f"{root}/large.json", "w") as f:
        f.write("[" + ",".join([review] * n) + "]")
    ex = ji.explode_payloads(ji.read_raw(spark, root))
    assert ex.count() == n


def test_a_list_above_the_variant_limit_inside_an_object_keeps_all_rows(spark):
    root = tempfile.mkdtemp(prefix="lexiflow-large-")
    review = json.dumps({"Index": 1, "RawText": "x" * 1000, "GeneralPolarity": "1"})
    n = 140_000
    with open(f"{root}/large.json", "w") as f:
        f.write('{"meta": {"v": 1}, "looks": "[1, 2]", "empty": null, "reviews": [' + ",".join([review] * n) + ", 7]}")
    raw = ji.read_raw(spark, root)
    assert ji.explode_payloads(raw).count() == n
    status = ji.payload_status(raw).first()
    assert (status["kind"], status["n_rows"], status["n_skipped"]) == ("object", n, 1)


@pytest.mark.parametrize(
    ("payload", "kind", "n"),
    [
        ('[{"a":1,"a":2},{"b":3}]', "array", 2),
        ('[{"a":NaN},{"b":3}]', "array", 2),
        ('[{"a":1}] x', "corrupt", 0),
        ('[{"a":1}]]', "corrupt", 0),
        ('[{"a":1}]}', "corrupt", 0),
        ('[{"a":1}],[{"a":1}]', "corrupt", 0),
        ('[{"a":1}', "corrupt", 0),
        ('{"a":1}', "object", 1),
        ('{"n":1,"l":[{"a":1},{"a":2},3]}', "object", 2),
        ('{"a":1}}', "corrupt", 0),
        ("7", "scalar", 0),
        ("[]", "array", 0),
        (" ", "corrupt", 0),
        (None, "corrupt", 0),
    ],
)
def test_odd_documents(spark, payload, kind, n):
    df = spark.createDataFrame([("f", payload)], "path string, payload string")
    with ji.last_of_repeated_keys(spark):
        got = ji.payload_status(df).first()
        assert (got.kind, got.n_rows) == (kind, n)
        assert ji.explode_payloads(df).count() == n


def test_the_last_value_of_a_repeated_key_counts(spark):
    df = spark.createDataFrame([("f", '[{"a":1,"a":2}]')], "path string, payload string")
    assert ji.explode_payloads(df).select(F.try_variant_get("_row", "$.a", "int")).first()[0] == 2


@pytest.mark.parametrize(
    ("root", "path", "want"),
    [
        ("/data/r", "/data/r/shop/a.json", "shop/a.json"),
        ("/data/r/", "file:///data/r/shop/a.json", "shop/a.json"),
        ("file:/data/r", "file:///data/r/shop/a.json", "shop/a.json"),
        ("s3a://bucket/r", "s3a://bucket/r/shop/a.json", "shop/a.json"),
        ("s3a://bucket", "s3a://bucket/shop/a.json", "shop/a.json"),
        ("hdfs://nn:8020/r", "hdfs://nn:8020/r/shop/a.json", "shop/a.json"),
        ("/r", "hdfs://nn:8020/r/shop/a.json", "shop/a.json"),
        ("/data/my r", "file:///data/my%20r/01%20%ED%8C%A8%EC%85%98/a+b.json", "01 패션/a+b.json"),
        ("/data/100%", "file:///data/100%25/s/a.json", "s/a.json"),
        ("r", "/home/r/shop/a.json", "shop/a.json"),
        ("/r", "/x/r/shop/a.json", "/x/r/shop/a.json"),
    ],
)
def test_relative_paths(spark, root, path, want):
    df = spark.createDataFrame([(path,)], "path string")
    got = ji.with_provenance(df, root).first()
    assert got.file_path == want
    assert got.top_folder == want.split("/")[0]


def test_strict_check_survives_column_pruning(spark):
    df = spark.createDataFrame([("u", None)], "uid string, label int")
    with pytest.raises(Exception, match="unmapped label"):
        prep.expect_total(df, strict=True).count()
    with pytest.raises(Exception, match="unmapped label"):
        prep.expect_total(df, strict=True).select("uid").collect()


def test_two_records_of_one_tag_raise(spark):
    df = spark.createDataFrame([("wide", 0.9), ("wide", 0.1), ("compact", 0.5)], "run_tag string, accuracy double")
    with pytest.raises(Exception, match="more than one record"):
        runs.compare_runs(df, "wide", "compact", ["accuracy"]).collect()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_scratch_tables_go_when_the_application_ends(spark):
    from lexiflow.sources import tables

    path = tables.materialize(spark.range(3), "scratch-test").inputFiles()[0].rsplit("/", 1)[0]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.cancelDeleteOnExit(target)
    fs.deleteOnExit(target)
