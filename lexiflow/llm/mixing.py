"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Sizes are summed by source and hash bucket.  A source takes whole passes over its
documents, and for the rest of its budget the documents whose hash lies below a
threshold.  The threshold is found digit by digit: the histogram of the first
digit gives the boundary bucket, only the documents in it are summed by the next
digit, and so on.  Nothing is sorted by document, and raising a budget only adds
documents (nested budgets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.sources.tables import materialize

DIGIT_BITS = 10
DIGITS = 4
CAP = 3
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Runs of characters outside ``[\\x20\\x09-\\x0D]``; null and blank texts have none."""
    parts = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(parts)).otherwise(F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target of each source from (source, source_size): shares by weight, at most cap x size.

    Sources rank by code point, null last, and weigh by rank.  Sources that the level
    ``total / weights`` lifts above their cap stop there and the rest is shared anew:
    in the order of size/weight the first ``j`` sources stop, where j is the least
    for which the level of the others stays below their caps.  One row per source,
    so the windows without a key run over sources, never over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("rank", rank).withColumn("w", w)
    order = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("size_before"),
    )
    level = (F.col("total") - cap * F.col("size_before")) / (F.col("all_w") - F.col("w_before"))
    s = s.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= cap * F.col("source_size"))
    least = F.min(F.when(F.col("free"), F.struct("size_before", "w_before", "level"))).over(everything)
    cut = F.coalesce(least["level"], F.lit(0.0))
    return s.select("source", "source_size", F.least(cut * F.col("w"), cap * F.col("source_size").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, digit_bits: int = DIGIT_BITS, digits: int = DIGITS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (and ``copies``; with ``keep`` also those columns).

    ``taken`` is size x copies, copies being 0..cap.  Rows with a null or blank text
    have size 0 and take nothing of a budget; a null source is a source of its own,
    ranked last.  The hash is of doc_id and text, so the choice does not depend on the
    partitioning and reruns agree; rows equal in both share one decision.  An empty
    table gives an empty result; extra columns are ignored.
    """
    extra = keep or []
    h = F.xxhash64(F.lit(20), F.col(id_col), F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"),
        *([F.struct(*[F.col(c) for c in extra]).alias("kept_row")] if extra else []),
    )
    rows = materialize(rows, "mix-sizes")
    narrow = rows.select("source", "size", "h")

    def digit(i: int) -> Column:
        return F.shiftrightunsigned("h", 64 - digit_bits * (i + 1)).bitwiseAND(F.lit((1 << digit_bits) - 1))

    plan = materialize(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    # one row per source: what is left of the budget inside the boundary bucket, and that bucket's prefix
    for i in range(digits):
        cells = narrow.join(plan.select(F.col("source").alias("s"), F.col("prefix").alias("p")), F.expr("source <=> s"))
        if i:
            cells = cells.where(F.shiftrightunsigned("h", 64 - digit_bits * i) == F.col("p"))
        hist = cells.groupBy("source", digit(i).alias("d")).agg(F.sum("size").alias("m"))
        upto = Window.partitionBy("source").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("below", F.coalesce(F.sum("m").over(upto), F.lit(0)))
        # the boundary bucket: the last one that begins within the budget
        edge = hist.join(plan.select(F.col("source").alias("s"), "rest"), F.expr("source <=> s")).where("below <= rest")
        edge = edge.groupBy("source").agg(F.max(F.struct("d", "below", "m")).alias("e")).select(F.col("source").alias("s"), "e")
        plan = plan.join(edge, F.expr("source <=> s"), "left").select(
            "source", "source_size", "target", "full",
            (F.col("rest") - F.coalesce("e.below", F.lit(0))).alias("rest"),
            (F.shiftleft("prefix", digit_bits) + F.coalesce("e.d", F.lit(0))).alias("prefix"),
            F.coalesce("e.m", F.lit(0)).alias("cell"),
        )
        plan = materialize(plan, f"mix-digit{i}")
    # the last cell holds one document or equal rows: take it if that comes nearer
    threshold = F.col("prefix") + F.when(F.col("rest") * 2 >= F.col("cell"), F.lit(1)).otherwise(F.lit(0))
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", "full", threshold.alias("threshold"))
    # a full budget already took all passes
    take = F.when((F.col("full") < cap) & (F.shiftrightunsigned("h", 64 - digit_bits * digits) < F.col("threshold")), F.lit(1)).otherwise(F.lit(0))
    out = rows.join(plan, F.expr("source <=> s")).withColumn("copies", (F.col("full") + take).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", *(["kept_row"] if extra else []))
