"""Cleaning, de-duplication and label remapping (stage 2 before the split).

Order of the reference pipeline: drop missing label -> uid + dedup (keep the
first row per uid in file order) -> clean text -> drop empty text -> remap
labels (must be total).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexiflow.functions.labels import POLARITY_TO_LABEL, label_remap, parse_label, strict_label, uid_key
from lexiflow.functions.text import clean_text
from lexiflow.sources.tables import materialize

def filter_values(df: DataFrame, col: str, values) -> DataFrame:
    """No-op for None, equality for one value, membership for a list (pushed to the scan)."""
    if values is None:
        return df
    if isinstance(values, (list, tuple, set, frozenset)):
        return df.filter(F.col(col).isin(list(values)))
    return df.filter(F.col(col) == values)


def with_label_int(df: DataFrame, raw: str = "polarity") -> DataFrame:
    """Add ``label_int`` from the label text unless the source already parsed it."""
    if "label_int" in df.columns:
        return df
    return df.withColumn("label_int", parse_label(F.col(raw)))


def drop_missing_label(df: DataFrame, raw: str = "polarity") -> DataFrame:
    """Drop rows whose raw label is missing (``dropna(subset=[label])``)."""
    return df.filter(F.col(raw).isNotNull())


def with_uid(df: DataFrame, null_index: str = "nan") -> DataFrame:
    return df.withColumn("uid", uid_key("file_path", "review_index", null_index=null_index, pos_col="pos"))


def losing_rows(df: DataFrame, key: str = "uid", pos: str = "pos") -> DataFrame:
    """Written table (key, pos, repeats) of the rows that do not come first in their key.

    Only ``key`` and ``pos`` are read.  The least position of a key is a primitive minimum, so
    it is found by hash aggregation with partial results in every task, also for a key that
    holds a large share of the rows.  ``repeats`` marks a first position that occurs more than
    once (a file that was loaded twice).
    """
    keys = df.select(key, F.coalesce(F.col(pos).cast("long"), F.lit((1 << 63) - 1)).alias("_pos"))
    many = keys.groupBy(key).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    places = keys.join(many, key).groupBy(key, "_pos", "_first").agg(F.count(F.lit(1)).alias("_n"))
    lost = places.where("_pos > _first or _n > 1").select(key, "_pos", (F.col("_pos") == F.col("_first")).alias("repeats"))
    return materialize(lost, "dedup-lost")


def without(df: DataFrame, lost: DataFrame, key: str = "uid", pos: str = "pos") -> DataFrame:
    """``df`` without the rows of :func:`losing_rows`: an anti join on narrow keys, broadcast while their written size is small.

    Of rows that repeat a first position the least one stays (in the order of their columns).
    """
    place = F.coalesce(F.col(pos).cast("long"), F.lit((1 << 63) - 1))
    on = (F.col(f"_r.{key}") == F.col(f"_l.{key}")) & (F.col("_r._pos") == F.col("_l._pos"))
    rows = df.withColumn("_pos", place).alias("_r")
    kept = rows.join(lost.alias("_l"), on, "left_anti").drop("_pos")
    twice = lost.where("repeats")
    if twice.isEmpty():
        return kept
    rest = rows.join(twice.alias("_l"), on, "left_semi").drop("_pos")
    once = rest.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("_row")).select(key, "_row.*")
    return kept.unionByName(once)


def dedup_keep_first(df: DataFrame, key: str = "uid", pos: str = "pos") -> DataFrame:
    """Keep the first row per key by position; a uid names its file, so that is the order of the files too.

    The texts of the rows are in no shuffle and no sort as long as the losing keys can be
    broadcast; only (key, position) pairs are.
    """
    return without(df, losing_rows(df, key, pos), key, pos)


def with_clean_text(df: DataFrame, raw: str = "raw_text", out: str = "text") -> DataFrame:
    return df.withColumn(out, clean_text(F.col(raw)))


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.length(F.col(text)) > 0)


def drop_empty_report(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows before / removed / after the empty-text filter, in one aggregate."""
    return df.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(F.length(F.col(text)) == 0).alias("n_removed"),
        F.count_if(F.length(F.col(text)) > 0).alias("n_after"),
    )


def with_label(df: DataFrame, mapping: Mapping[int, int] = POLARITY_TO_LABEL) -> DataFrame:
    return df.withColumn("label", label_remap(F.col("label_int"), mapping).cast("int"))


def expect_total(df: DataFrame, col: str = "label", strict: bool = False) -> DataFrame:
    """Label mapping must be total.  Strict: fail the job on the first unmapped row
    (``raise_error`` inside the plan, no driver round trip).  Otherwise the
    unmapped rows are left out here and listed by ``unmapped_rows``."""
    if strict:  # as a predicate, which column pruning can't remove
        unmapped = F.raise_error(F.lit("unmapped label; check the label values")).cast("boolean")
        return df.filter(F.when(F.col(col).isNull(), unmapped).otherwise(F.lit(True)))
    return df.filter(F.col(col).isNotNull())


def expect_integer_labels(df: DataFrame, raw: str = "polarity") -> DataFrame:
    """Strict integer parse: the job fails at the first label that is no integer, naming its file and position."""
    return df.filter(strict_label(raw, F.concat_ws(" ", F.col("file_path"), F.lit("row"), F.col("pos"))).isNotNull())


def staged(df: DataFrame, mapping: Mapping[int, int] = POLARITY_TO_LABEL, null_index: str = "nan") -> DataFrame:
    """Labelled, de-duplicated rows with cleaned text and (possibly null) label."""
    d = drop_missing_label(with_label_int(df))
    d = dedup_keep_first(with_uid(d, null_index=null_index))
    return with_label(with_clean_text(d), mapping)


PREPARED = ("uid", "text", "label", "label_int as polarity", "domain", "main_category", "source")


def prepare(df: DataFrame, mapping: Mapping[int, int] = POLARITY_TO_LABEL, strict: bool = False, null_index: str = "nan") -> DataFrame:
    """Contract table -> split input ``uid, text, label, polarity, domain, main_category, source``.

    ``strict`` fails the job on a label that is no integer or not in ``mapping``."""
    d = expect_integer_labels(drop_missing_label(df)) if strict else df
    d = expect_total(drop_empty_text(staged(d, mapping, null_index)), "label", strict)
    return d.selectExpr(*PREPARED)


FUNNEL = ("loaded", "labelled", "deduplicated", "non_empty", "mapped")


class ObservedFunnel:
    """Row counts of the steps of :func:`prepare`, taken while its result is written.

    ``rows`` is to be written by one action; ``counts`` then has what passed each step, without
    another scan.  Spark counts a task's rows again if its stage runs again after a loss, so
    counts below a shuffle may then be too high; ``prep_funnel`` counts from the table.
    """

    def __init__(self, df: DataFrame, mapping: Mapping[int, int] = POLARITY_TO_LABEL, strict: bool = False, null_index: str = "nan"):
        self._seen = {step: Observation(f"funnel-{step}") for step in FUNNEL}

        def seen(d: DataFrame, step: str) -> DataFrame:
            return d.observe(self._seen[step], F.count(F.lit(1)).alias("n"))

        def labelled(d: DataFrame) -> DataFrame:
            d = drop_missing_label(with_label_int(d))
            return expect_integer_labels(d) if strict else d

        lost = losing_rows(with_uid(labelled(df), null_index))
        d = seen(with_uid(labelled(seen(df, "loaded")), null_index), "labelled")
        d = seen(without(d, lost), "deduplicated")
        d = seen(drop_empty_text(with_label(with_clean_text(d), mapping)), "non_empty")
        self.rows = seen(expect_total(d, "label", strict).selectExpr(*PREPARED), "mapped")
        self._spark = df.sparkSession

    def counts(self) -> DataFrame:
        """(step_no, step, n_rows) after ``rows`` was written."""
        rows = [(i, step, int(self._seen[step].get["n"])) for i, step in enumerate(FUNNEL, 1)]
        return self._spark.createDataFrame(rows, "step_no int, step string, n_rows long")


def unmapped_rows(df: DataFrame, mapping: Mapping[int, int] = POLARITY_TO_LABEL) -> DataFrame:
    """Quarantine: rows that reach the remap step with a label outside the mapping."""
    d = drop_empty_text(staged(df, mapping))
    return d.filter(F.col("label").isNull())


def prep_funnel(df: DataFrame, mapping: Mapping[int, int] = POLARITY_TO_LABEL) -> DataFrame:
    """Rows kept after each step, from one scan: rows are counted per (labelled, uid) while
    the first row of the uid is found, and the steps are sums over these groups.
    Unlabelled rows share one group, which partial aggregation reduces to a row per task."""
    d = with_uid(with_label_int(df)).withColumn("_labelled", F.col("polarity").isNotNull())
    first = F.min(F.when(F.col("_labelled"), F.struct("file_path", "pos", "raw_text", "label_int"))).alias("_first")
    groups = d.groupBy("_labelled", F.when(F.col("_labelled"), F.col("uid")).alias("uid")).agg(F.count(F.lit(1)).alias("_n"), first)
    kept = groups.select("_labelled", "_n", F.col("_first.raw_text").alias("raw_text"), F.col("_first.label_int").alias("label_int"))
    kept = with_label(with_clean_text(kept), mapping)
    full = F.col("_labelled") & (F.length("text") > 0)
    wide = kept.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("loaded"),
        F.coalesce(F.sum(F.when(F.col("_labelled"), F.col("_n"))), F.lit(0)).alias("labelled"),
        F.count_if(F.col("_labelled")).alias("deduplicated"),
        F.count_if(full).alias("non_empty"),
        F.count_if(full & F.col("label").isNotNull()).alias("mapped"),
    )
    steps = ["loaded", "labelled", "deduplicated", "non_empty", "mapped"]
    order = F.array_position(F.array(*[F.lit(x) for x in steps]), F.col("step")).cast("int")
    return wide.unpivot([], steps, "step", "n_rows").select(order.alias("step_no"), "step", F.col("n_rows").cast("bigint"))
