"""Tables between stages, run records and directory sizes.

Stages hand over Parquet (typed, no re-inference), split tables are
partitioned by ``split`` so a reader of one split prunes the others.  CSV
is available for export/import with an explicit schema, multi-line fields
and doubled quotes; a UTF-8 byte-order mark in the header is removed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions.labels import LABEL_TO_NAME

BOM = "\ufeff"
#: Spark's setting that removes a statement's shuffle files when it has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    if fmt == "parquet":
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.parquet(path)
    if fmt == "csv":
        r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
        if schema is not None:
            r = r.schema(schema)
        df = r.csv(path)
        first = df.columns[0]
        if first.startswith(BOM):
            df = df.withColumnRenamed(first, first[len(BOM) :])
        return df
    if fmt == "json":
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.json(path)
    raise ValueError(f"unknown format {fmt!r}")


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a CSV file or folder with a header.

    The header must name the columns of ``schema`` in order, or the read fails.  A record with
    too few or too many fields, or a value that its column's type can't hold, is malformed:
    it is listed whole, as text, in ``quarantine`` (file, record) instead of becoming nulls.
    Records are parsed once, into a written table, because a reader that leaves out columns
    would not see what is wrong with them.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "_malformed"
    whole = T.StructType([*fields.fields, T.StructField(bad, T.StringType())])
    r = spark.read.schema(whole).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    r = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("enforceSchema", False)
    parsed = materialize(r.csv(path).select("*", F.col("_metadata.file_path").alias("_file")), "csv-parsed")
    good = parsed.where(F.col(bad).isNull()).select(*fields.names)
    return good, parsed.where(F.col(bad).isNotNull()).select(F.col("_file").alias("file"), F.col(bad).alias("record"))


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: str | list[str] | None = None,
    mode: str = "overwrite",
    bom: bool = False,
    compression: str | None = None,
) -> None:
    """Write a stage table.  ``bom=True`` (CSV) starts every part file's header
    with a UTF-8 byte-order mark, as spreadsheet tools expect."""
    if fmt == "csv" and bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "parquet":
        w.parquet(path, compression=compression)
    elif fmt == "csv":
        w = w.option("header", True).option("escape", '"').option("quoteAll", False)
        w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_record(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Run records / label maps as JSON Lines (one object per row)."""
    df.write.mode(mode).json(path)


def read_records(spark: SparkSession, pattern: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Read any number of JSON record files (pretty-printed objects by default)."""
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    return r.json(pattern)


def label_map_record(spark: SparkSession, names: Mapping[int, str] = LABEL_TO_NAME) -> DataFrame:
    """One row: ``label2id`` (name -> id) and ``id2label`` (id -> name) maps."""
    id2 = F.create_map(*[x for k, v in names.items() for x in (F.lit(str(k)), F.lit(v))])
    to_id = F.create_map(*[x for k, v in names.items() for x in (F.lit(v), F.lit(int(k)))])
    return spark.range(1).select(to_id.alias("label2id"), id2.alias("id2label"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label INT, label_name) rows from a label-map record; JSON keys are text, ids come back as integers."""
    rec = spark.read.schema("label2id map<string,int>, id2label map<string,string>").json(path)
    return rec.select(F.explode("id2label").alias("k", "label_name")).select(
        F.col("k").cast("int").alias("label"), "label_name"
    )


def dir_size_mb(spark: SparkSession, path: str) -> DataFrame:
    """Total bytes of all files under ``path`` in MB (1024^2): a binary-file scan
    that reads only file lengths (``content`` is pruned), summed on the cluster."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"),
        (F.coalesce(F.sum("length"), F.lit(0)) / (1024.0 * 1024.0)).alias("size_mb"),
    )


def materialize(df: DataFrame, name: str, partition_by: str | list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared ``spark.checkpoint.dir`` and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing the
    pipeline), lets later steps read only the columns they need, and with
    ``partition_by`` lets readers of one partition value skip the others.  The shuffle
    files of the write are removed with its end instead of when the driver next collects its garbage.
    """
    path, conf = scratch_path(df.sparkSession, f"lexiflow-tables/{name}"), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        write_table(df, path, fmt="parquet", partition_by=partition_by, compression=compression)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
    delete_on_exit(df.sparkSession, path)
    return df.sparkSession.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more (else they go when the application ends)."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """One text file for every value of ``name`` and task, ``file=<value>`` in its path, with the rows of ``text`` as lines.

    As ``df.write.partitionBy(name).text(path)`` writes them. In a folder that all machines mount, Hadoop starts
    a process for every file it creates, to set its mode, so tasks write there themselves, into 256 folders, and a file
    appears under its name when it is whole.
    """
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        df.select(F.col(name).alias("file"), text).write.partitionBy("file").text(path)
        return
    folder = fs.makeQualified(target).toUri().getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        from itertools import groupby
        from zlib import crc32

        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        lines = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for now, some in groupby(lines, key=lambda x: x[0]):
            to = f"{folder}/{crc32(now.encode()) % 256:02x}"
            os.makedirs(to, exist_ok=True)
            with open(out := f"{to}/.{uuid.uuid4().hex}", "wb") as f:
                f.writelines(x[1].encode() + b"\n" for x in some)
            os.replace(out, f"{to}/file={now}-{part}.txt")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows = df.select(F.coalesce(F.col(name), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("file"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.sortWithinPartitions("file").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared ``spark.checkpoint.dir``."""
    import uuid

    from lexiflow.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """What was written to ``path`` goes when the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
