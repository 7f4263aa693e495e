"""Classification metrics from k x k confusion counts.

Every metric starts from one grouped count per (run, label, pred): the rows
are scanned once, the rest is arithmetic on at most runs * k * k rows.
Classes follow scikit-learn: precision/recall/F1 of a class with a 0
denominator are 0; macro averages run over the classes present in labels or
predictions; the report and matrix are dense over all k known classes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.arrays import argmax, nll
from lexiflow.functions.labels import LABEL_TO_NAME, NUM_LABELS, label_name

DIGITS = 6


def _r(c):
    return F.round(c, DIGITS)


def _zero_rows(k: int, fields: Sequence[str]):
    """k structs (class id 0..k-1 with zero counts): makes a grouped table dense without a join."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.struct(c.alias("cls"), *[F.lit(0).cast("bigint").alias(f) for f in fields]))


def class_weights(df: DataFrame, label: str = "label", k: int = NUM_LABELS) -> DataFrame:
    """Balanced weights n / (k * n_c), dense over classes 0..k-1; an absent class gets +inf.

    One grouped count; the partial counts of every task carry zero rows for all
    k classes, so the result is dense without joining a class grid."""
    per_row = F.array(F.struct(F.col(label).cast("int").alias("cls"), F.lit(1).cast("bigint").alias("n_c")))
    counts = (
        df.select(F.explode(per_row).alias("r"))
        .select("r.*")
        .unionByName(df.sparkSession.range(1).select(F.explode(_zero_rows(k, ["n_c"])).alias("r")).select("r.*"))
        .groupBy("cls")
        .agg(F.sum("n_c").alias("n_c"))
    )
    total = F.sum("n_c").over(Window.partitionBy())
    w = F.when(F.col("n_c") == 0, F.lit(float("inf"))).otherwise(total / (F.lit(k) * F.col("n_c")))
    return counts.select(F.col("cls").alias(label), F.col("n_c").cast("bigint").alias("n_c"), w.alias("weight"))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ("run",)) -> DataFrame:
    return df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ("run",), k: int = NUM_LABELS) -> DataFrame:
    """Dense (run, class): tp, support, predicted, precision, recall, f1, present.

    From the k x k confusion counts, each cell emits a 'true class' row and a
    'predicted class' row, plus zero rows for all k classes; one more grouping
    over those few rows gives the dense per-class table (no joins)."""
    by = list(by)
    cc = confusion_counts(df, label, pred, by)
    cells = F.array(
        F.struct(F.col(label).alias("cls"), F.col("n").alias("support"), F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted")),
    )
    rows = cc.select(*by, F.explode(F.concat(cells, _zero_rows(k, ["support", "tp", "predicted"]))).alias("r"))
    d = rows.groupBy(*by, F.col("r.cls").cast("int").alias("cls")).agg(
        F.sum("r.tp").cast("bigint").alias("tp"),
        F.sum("r.support").cast("bigint").alias("support"),
        F.sum("r.predicted").cast("bigint").alias("predicted"),
    )
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + (F.col("predicted") - F.col("tp")) + (F.col("support") - F.col("tp")))).otherwise(0.0)
    return d.select(
        "*",
        p.alias("precision"),
        r.alias("recall"),
        f1.alias("f1"),
        ((F.col("support") > 0) | (F.col("predicted") > 0)).alias("present"),
    )


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ("run",)) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg((F.col(label) == F.col(pred)).cast("double"))).alias("accuracy")
    )


def f1_macro(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ("run",), k: int = NUM_LABELS) -> DataFrame:
    pc = per_class(df, label, pred, by, k)
    return pc.filter("present").groupBy(*by).agg(_r(F.avg("f1")).alias("f1_macro"))


def classification_report(
    df: DataFrame,
    label: str = "label",
    pred: str = "pred",
    by: Sequence[str] = ("run",),
    k: int = NUM_LABELS,
    names: Mapping[int, str] = LABEL_TO_NAME,
) -> DataFrame:
    """Rows per class (named), then 'accuracy', 'macro avg', 'weighted avg'."""
    by = list(by)
    pc = per_class(df, label, pred, by, k)
    fields = ("row", "precision", "recall", "f1", "support")

    def line(*values: Column) -> Column:
        kinds = ("string", "double", "double", "double", "bigint")
        return F.struct(*[v.cast(t).alias(c) for v, t, c in zip(values, kinds, fields, strict=True)])

    scores = [_r(F.col(c)) for c in ("precision", "recall", "f1")]
    agg = pc.groupBy(*by).agg(
        F.collect_list(line(label_name(F.col("cls"), names), *scores, F.col("support"))).alias("classes"),  # k of them
        F.sum("support").alias("n"),
        F.sum("tp").alias("tp"),
        *[F.avg(F.when(F.col("present"), F.col(c))).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[F.sum(F.col(c) * F.col("support")).alias(f"sum_{c}") for c in ("precision", "recall", "f1")],
    )
    n, none = F.col("n"), F.lit(None)
    summary = F.array(
        line(F.lit("accuracy"), none, none, _r(F.col("tp") / n), n),
        line(F.lit("macro avg"), *[_r(F.col(f"macro_{c}")) for c in ("precision", "recall", "f1")], n),
        line(F.lit("weighted avg"), *[_r(F.col(f"sum_{c}") / n) for c in ("precision", "recall", "f1")], n),
    )
    return agg.select(*by, F.inline(F.concat("classes", summary)))


def confusion_matrix(
    df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ("run",), k: int = NUM_LABELS,
    names: Mapping[int, str] = LABEL_TO_NAME,
) -> DataFrame:
    """Rows = true class (id and name), columns ``pred_0..pred_{k-1}`` = counts, dense with 0.

    The confusion counts get zero cells for every true class, then one pivot
    over those few rows (no grid join)."""
    by = list(by)
    cc = confusion_counts(df, label, pred, by)
    zeros = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.struct(c.alias("t"), F.lit(0).alias("p"), F.lit(0).cast("bigint").alias("n")))
    cell = F.array(F.struct(F.col(label).cast("int").alias("t"), F.col(pred).cast("int").alias("p"), F.col("n").alias("n")))
    rows = cc.select(*by, F.explode(F.concat(cell, zeros)).alias("r")).select(*by, "r.t", "r.p", "r.n")
    wide = rows.groupBy(*by, "t").pivot("p", list(range(k))).agg(F.sum("n"))
    return wide.select(
        *by,
        F.col("t").cast("int").alias("true_label"),
        label_name(F.col("t"), names).alias("true_name"),
        *[F.coalesce(F.col(str(i)), F.lit(0)).cast("bigint").alias(f"pred_{i}") for i in range(k)],
    )


def argmax_prediction(df: DataFrame, scores: str = "scores", out: str = "pred") -> DataFrame:
    return df.withColumn(out, argmax(F.col(scores)))


def weighted_log_loss(
    df: DataFrame, scores: str = "scores", label: str = "label", weights: DataFrame | None = None, balanced: bool = False, k: int = NUM_LABELS
) -> DataFrame:
    """Class-weighted cross-entropy, PyTorch 'mean' rule: sum(w_y * nll) / sum(w_y).

    The weight of a class factors out of its sums, so the rows are read once, for the loss and
    the number of each class, and weights are applied to these k rows: the table ``weights``
    (label, weight), or ``balanced`` ones n / (k * n_c), which need no other read.  Without
    either every weight is 1."""
    loss = nll(F.col(scores), F.col(label))
    per = df.groupBy(label).agg(F.sum(loss).alias("_s"), F.count(loss).alias("_m"), F.count(F.lit(1)).alias("_c"))
    if balanced:
        total = F.sum("_c").over(Window.partitionBy())  # one row a class
        per = per.withColumn("_w", total / (F.lit(k) * F.col("_c")))
    elif weights is not None:
        per = per.join(F.broadcast(weights.select(label, F.col("weight").alias("_w"))), label, "left")
    else:
        per = per.withColumn("_w", F.lit(1.0))
    return per.agg(
        _r(F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_c"))).alias("weighted_log_loss"),
        _r(F.sum("_s") / F.sum("_m")).alias("log_loss"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n"),
    )


def select_best(df: DataFrame, label: str = "label", pred: str = "pred", by: str = "run", k: int = NUM_LABELS) -> DataFrame:
    """Candidate with the highest macro F1 (ties: smallest candidate id); top-1 is the feature."""
    f = f1_macro(df, label, pred, [by], k)
    return f.orderBy(F.desc("f1_macro"), F.asc(by)).limit(1).select(F.col(by).alias("best"), "f1_macro")
