"""Boilerplate lines by distinct-site spread (HyperLogLog), with exact counts near the threshold.

1. Every line has a 128-bit hash; sketches of its sites merge by aggregation, first
   in the tasks that read the text, so a line that every document has leaves a task
   as one sketch.
2. Lines whose estimate is clearly above the threshold spread over many sites;
   those within the sketch's error of it get an exact distinct count of sites.
3. A line that spreads over ``min_sites`` sites or more is boilerplate.  Its first
   occurrence (smallest doc_id, then position) stays, all others go, so documents
   copied from site to site keep one full copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.sources.tables import materialize

MIN_SITES = 10
LG_K = 11
#: relative standard error of a sketch of 2^11 registers is 2.3 %; lines within 6 of them count as near
NEAR = 0.14
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(docs: DataFrame) -> DataFrame:
    """(row, site, pos, h1, h2) of every line that is not blank."""
    line = F.regexp_replace("line", TRIM, "")
    return (
        docs.select("row", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("line", line)
        .where("line <> ''")
        .select("row", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))
    )


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """Rows are told apart by doc_id; rows without one, or that repeat it, by their content too."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col, source_col).alias("rest"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2) of the lines found on ``min_sites`` sites or more."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("s"))
    est = sketched.select("h1", "h2", F.hll_sketch_estimate("s").alias("sites")).where(F.col("sites") >= min_sites * (1 - NEAR) - 1)
    est = materialize(est, "line-estimates")
    near = est.where(F.col("sites") <= min_sites * (1 + NEAR) + 1).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    sure = est.where(F.col("sites") > min_sites * (1 + NEAR) + 1).select("h1", "h2")
    return sure.unionByName(exact.select("h1", "h2"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines removed from ``text_col``, plus n_lines and n_removed.

    Lines are compared without white space at their ends; blank lines are never
    removed and lines that stay are not changed.  A null source is one site; a null
    text stays null.  A document whose lines all go keeps its row with an empty text.
    Rows equal in doc_id, text and source are one occurrence and keep the same lines.
    ``n_lines`` and ``n_removed`` replace input columns of these names.
    """
    taken = {c.lower() for c in docs.columns}
    key, gone_key, gone_at = (next(n for i in range(len(taken) + 1) if (n := f"_{i}{name}") not in taken) for name in ("row", "gone_row", "gone_at"))
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    site = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    base = docs.select(_row_key(id_col, text_col, source_col).alias("row"), site.alias("site"), F.col(text_col).cast("string").alias("text"))
    lines = _lines(base)
    spread = materialize(spread_lines(lines, min_sites, lg_k), "line-spread")
    hits = materialize(lines.join(spread, ["h1", "h2"], "left_semi").select("row", "pos", "h1", "h2"), "line-hits")
    first = hits.groupBy("h1", "h2").agg(F.min(F.struct("row", "pos")).alias("first"))
    first = materialize(first, "line-first")
    gone = hits.join(first, ["h1", "h2"]).where("row <> first.row or pos <> first.pos")
    gone = gone.groupBy("row").agg(F.collect_set("pos").alias("gone"))
    parts = F.split(text_col, "\n")
    left = F.array_join(F.filter(parts, lambda x, i: ~F.coalesce(F.array_contains(gone_at, i), F.lit(False))), "\n")
    gone = gone.select(F.col("row").alias(gone_key), F.col("gone").alias(gone_at))
    joined = docs.select(*[F.col(f"`{c}`") for c in cols]).withColumn(key, _row_key(id_col, text_col, source_col)).join(gone, F.expr(f"{key} <=> {gone_key}"), "left")
    return joined.select(
        *[(F.when(F.col(gone_at).isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`")) for c in cols],
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts)).alias("n_lines"),
        F.coalesce(F.size(gone_at), F.lit(0)).alias("n_removed"),
    )
