"""Profiles: null counts, value counts, crosstabs, length statistics, box and histogram data.

Null keys follow pandas: ``groupby``/``crosstab``/``value_counts`` drop null
keys (we filter them first; Spark would keep them), ``value_counts(dropna=False)``
and ``duplicated`` keep them.  Each report is one aggregate over its input;
quantiles use Spark's exact ``percentile`` (linear interpolation, as numpy),
which combines map-side.  Doubles are rounded to 6 digits at the end so that
engines agree to the last printed digit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.text import is_blank
from lexiflow.sources.tables import materialize

DIGITS = 6


def r6(c: Column) -> Column:
    return F.round(c, DIGITS)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null) for every column, from one aggregate."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_null").select("column", F.col("n_null").cast("bigint"))


def missing_text_label(df: DataFrame, text: str = "raw_text", label: str = "polarity") -> DataFrame:
    """Missing label; null, blank and null-or-blank text as separate counts."""
    t = F.col(text)
    return df.agg(
        F.count_if(F.col(label).isNull()).alias("n_missing_label"),
        F.count_if(t.isNull()).alias("n_null_text"),
        F.count_if(is_blank(t)).alias("n_blank_text"),
        F.count_if(t.isNull() | is_blank(t)).alias("n_missing_text"),
    )


def invalid_label_values(df: DataFrame, raw: str = "polarity", parsed: str = "label_int", valid=(-1, 0, 1)) -> DataFrame:
    """Parsed but outside the valid set: listing of raw values with counts."""
    bad = df.filter(F.col(parsed).isNotNull() & ~F.col(parsed).isin(list(valid)))
    return bad.groupBy(raw, parsed).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str, dropna: bool = True, normalize: bool = False) -> DataFrame:
    """(value, n[, pct]); nulls dropped unless ``dropna=False``."""
    d = df.filter(F.col(col).isNotNull()) if dropna else df
    out = d.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        # the total is a scalar subquery: no single-partition window over all values
        total = d.agg(F.count(F.lit(1))).scalar()
        out = out.withColumn("pct", r6(F.col("n") * 100.0 / total))
    return out


def crosstab(df: DataFrame, a: str, b: str, normalize: str | None = None) -> DataFrame:
    """Long-form crosstab of counts; ``normalize='index'`` adds row percentages."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    if normalize == "index":
        d = d.withColumn("pct", r6(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(a))))
    elif normalize is not None:
        raise ValueError("normalize must be None or 'index'")
    return d


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Wide crosstab over known column values, absent cells 0 (one aggregate, no extra job)."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return d.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1))).fillna(0, subset=list(values))


def describe(df: DataFrame, col: str) -> DataFrame:
    """pandas ``describe``: count, mean, sample std, min, quartiles, max (nulls ignored)."""
    c = F.col(col)
    q = F.percentile(c, [0.25, 0.5, 0.75])
    out = df.agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"),
        q.alias("_q"),
        F.max(c).cast("double").alias("max"),
    )
    return out.select(
        "count",
        r6(F.col("mean")).alias("mean"),
        r6(F.col("std")).alias("std"),
        "min",
        r6(F.col("_q")[0]).alias("p25"),
        r6(F.col("_q")[1]).alias("p50"),
        r6(F.col("_q")[2]).alias("p75"),
        "max",
    )


def quantiles(df: DataFrame, col: str, qs: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row, one column per quantile, named ``p<percent>``."""
    out = df.agg(F.percentile(F.col(col), list(qs)).alias("_q"))
    return out.select(*[r6(F.col("_q")[i]).alias(f"p{round(q * 100):d}") for i, q in enumerate(qs)])


def group_stats(df: DataFrame, by: str, col: str, qs: Sequence[float] = (0.75, 0.9), median: bool = True) -> DataFrame:
    """Per group (null group dropped): count, mean, median, the given quantiles, max."""
    c = F.col(col)
    all_q = ([0.5] if median else []) + list(qs)
    d = df.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.percentile(c, all_q).alias("_q"),
        F.max(c).alias("max"),
    )
    cols = [by, "count", r6(F.col("mean")).alias("mean")]
    for i, q in enumerate(all_q):
        name = "median" if (median and i == 0) else f"p{round(q * 100):d}"
        cols.append(r6(F.col("_q")[i]).alias(name))
    cols.append("max")
    return d.select(*cols)


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier row on ``cols`` (nulls compare equal), as one value ``n_dup``."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_dup"))


def text_key(col: str) -> Column:
    """Key of a text for ``duplicate_counts``: SHA-256 and length, so that no text is
    shuffled; no two texts of equal SHA-256 are known.  Null texts share a key."""
    return F.struct(F.sha2(F.col(col).cast("binary"), 256).alias("sha256"), F.length(col).alias("n"))


def duplicate_counts(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Several duplicate counts (rows repeating an earlier row on a key) from one scan.

    One ``GROUPING SETS`` aggregation: each input row is expanded once per key
    and combined map-side, so the input is read once and shuffled once instead
    of once per key.  A row whose key expression is null is left out of that
    key's count; wrap a nullable column in ``struct`` so that a null value still
    counts as a key (pandas ``duplicated`` treats nulls as equal)."""
    names = list(keys)
    k = len(names)
    cols = [f"_k{i}" for i in range(k)]
    d = df.select(*[keys[n].alias(c) for n, c in zip(names, cols)])
    g = d.groupingSets([[c] for c in cols], *cols).agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_gid"))
    outs = []
    for i, (name, c) in enumerate(zip(names, cols)):
        gid = (1 << k) - 1 - (1 << (k - 1 - i))  # every grouping column aggregated except this one
        in_set = (F.col("_gid") == gid) & F.col(c).isNotNull()
        outs.append(F.coalesce(F.sum(F.when(in_set, F.col("_n") - 1)), F.lit(0)).cast("bigint").alias(name))
    return g.agg(*outs)


def _value_counts(df: DataFrame, by: str, col: str) -> DataFrame:
    """(by, _v, _c): rows of each value of ``col`` in each group, counted in one scan and written once."""
    d = df.filter(F.col(col).isNotNull()).select(by, F.col(col).alias("_v"))
    return materialize(d.groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_c")), "value-counts")


def box_stats(df: DataFrame, by: str, col: str, whis: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, and whiskers at the farthest value within
    ``whis``·IQR of the box (never inside the box), as matplotlib draws them with
    fliers hidden.  The rows are read once, for the count of each (group, value);
    quartiles and whiskers follow from that written table."""
    counts = _value_counts(df.filter(F.col(by).isNotNull()), by, col)
    v = F.col("_v")
    q = counts.groupBy(by).agg(F.sum("_c").alias("_n"), F.percentile(v, [0.25, 0.5, 0.75], F.col("_c")).alias("_q"))
    q = q.select(by, "_n", F.col("_q")[0].alias("_q1"), F.col("_q")[1].alias("_q2"), F.col("_q")[2].alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    lo = F.col("_q1") - whis * iqr
    hi = F.col("_q3") + whis * iqr
    w = counts.join(q, by).groupBy(by, "_n", "_q1", "_q2", "_q3").agg(
        F.min(F.when(v >= lo, v)).alias("_lo"),
        F.max(F.when(v <= hi, v)).alias("_hi"),
    )
    return w.select(
        by,
        F.col("_n").alias("n"),
        r6(F.col("_q1")).alias("q1"),
        r6(F.col("_q2")).alias("median"),
        r6(F.col("_q3")).alias("q3"),
        r6(F.least(F.coalesce(F.col("_lo").cast("double"), F.col("_q1")), F.col("_q1"))).alias("whislo"),
        r6(F.greatest(F.coalesce(F.col("_hi").cast("double"), F.col("_q3")), F.col("_q3"))).alias("whishi"),
    )


def histogram(df: DataFrame, by: str, col: str, bins: int = 50, clip_q: float | None = 0.99) -> DataFrame:
    """Per-group histogram of an integer column after clipping at a global quantile.

    Bin ``i`` of ``bins`` equal-width bins over [min, max] of the clipped
    group, last bin closed; equal bounds put every value in the middle bin
    (numpy widens the range by 1/2).  Integer arithmetic, so edges are exact.
    ``n_total`` is the group size before clipping.  All bins are emitted,
    empty ones with 0.  The rows are read once, for the count of each (group,
    value); quantile, ranges, totals and bins follow from that written table.
    """
    counts = _value_counts(df, by, col)
    d = counts.filter(F.col(by).isNotNull())
    totals = d.groupBy(by).agg(F.sum("_c").alias("n_total"))
    if clip_q is not None:
        d = d.filter(F.col("_v") <= counts.agg(F.percentile("_v", clip_q, F.col("_c"))).scalar())
    info = d.groupBy(by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).join(totals, by)
    info = materialize(info, "histogram-ranges")
    span = F.col("hi") - F.col("lo")
    step = F.expr(f"((_v - lo) * {int(bins)}) div (hi - lo)")
    b = F.when(span == 0, F.lit(bins // 2)).otherwise(F.least(step, F.lit(bins - 1)))
    counts = d.join(info, by).groupBy(by, b.cast("int").alias("bin")).agg(F.sum("_c").alias("n"))
    # every (group, bin) gets a zero row, so empty bins appear without a grid join
    zeros = info.select(by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    dense = counts.unionByName(zeros).groupBy(by, "bin").agg(F.sum("n").alias("n"))
    width = (F.col("hi") - F.col("lo")).cast("double") / bins
    return dense.join(info, by).select(
        by,
        "bin",
        r6(F.col("lo") + F.col("bin") * width).alias("bin_start"),
        r6(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
        F.col("n_total").cast("bigint").alias("n_total"),
    )


def top_values(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Top-n values by count (ties by value), with their rank.  The limit is the
    feature: ``orderBy().limit()`` is a distributed take-ordered, and the rank
    is numbered over those n rows only."""
    vc = value_counts(df, col)
    top = vc.orderBy(F.desc("n"), F.asc(col)).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(col))))


def distributed_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with its row number in ``order`` (1 first), for any number of rows.

    Rows are dealt to ranges of the order and written with the number of their range; a row's
    rank is its place in the range plus the rows of the ranges before, so no task sorts or
    numbers more than one range.  ``order`` must not leave ties.
    """
    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = sorted(tuple(r) for r in ranges.groupBy("_range").agg(F.count(F.lit(1))).collect())  # a row a range
    offsets, total = [], 0
    for r, n in sizes:
        offsets.append((r, total))
        total += n
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _before long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_place", place).join(before, "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def groups_by_median(df: DataFrame, by: str, col: str) -> DataFrame:
    """Groups ordered by median descending (ties by key), with rank, for any number of groups."""
    m = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.percentile(F.col(col), 0.5).alias("median"))
    ranked = distributed_rank(m, [F.desc("median"), F.asc(by)])
    return ranked.select("rank", by, r6(F.col("median")).alias("median"))


def distinct_groups(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(dimension, value) for the distinct values of each column, nulls kept; one scan,
    and each task passes on one row per distinct value."""
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*pairs))).distinct()
