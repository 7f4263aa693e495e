"""Exact, reproducible stratified train/valid/test split.

Semantics kept from the reference (not its row choice, which depends on a
NumPy shuffle): stratum = label x domain, strata with fewer than
``min_count`` rows fall back to the label alone; a first split holds out
ceil(20 %) and a second halves the held-out part, each stratified.  Per
stratum sizes use the largest-remainder allocation of scikit-learn's
stratified shuffle split (the "train" side of each split is allocated
first), with ties broken by stratum key instead of at random, in exact
integer arithmetic.  Inside a stratum rows are ordered by
``md5(seed|uid)`` then uid; the first ``test_q`` rows go to test, the next
``valid_q`` to valid, the rest to train.

Scale: there are only a handful of strata, so ``row_number() over
(partition by stratum)`` would sort the corpus in a handful of tasks.
Instead the last row of test and of valid of every stratum is found by its
(hash, uid), and one comparison with these cut points assigns each row:

1. (stratum, hash, uid) of all rows are written once to the shared folder;
2. rows are counted by stratum and the first ``DIGITS`` hex digits of the
   hash (map-side combined); the cell in which a cut lies is counted again by
   the next ``DIGITS`` digits, so no count table exceeds strata x 16^DIGITS
   rows, whatever the input;
3. the few rows that share all ``LEVELS * DIGITS`` digits with a cut are
   counted by (hash, uid), which gives the cut itself;
4. rows meet the cut points of their stratum in one join of a written table
   with one row per stratum, which Catalyst broadcasts by its size.

No step moves any other column of the rows, and all steps are the same at
every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.labels import LABEL_TO_NAME, label_name
from lexiflow.sources.tables import materialize

SPLITS = ("train", "valid", "test")

#: hex digits of the hash by which one level counts, and the number of levels
DIGITS, LEVELS = 4, 2


def stratify_key(df: DataFrame, cols: Sequence[str] = ("label", "domain"), min_count: int = 3) -> DataFrame:
    """Add ``stratify_key`` = 'label_domain' (missing parts as 'nan'); rare keys fall back to the first column.

    The key map (one row per raw key) is written once, so Catalyst knows its size
    and broadcasts it while it is small; the rows are not shuffled by key then.
    """
    first = F.col(cols[0]).cast("string")
    parts = [F.coalesce(first, F.lit("nan"))]
    for c in cols[1:]:
        parts += [F.lit("_"), F.coalesce(F.col(c).cast("string"), F.lit("nan"))]
    d = df.withColumn("_raw_key", F.concat(*parts))
    counts = d.groupBy("_raw_key", F.coalesce(first, F.lit("nan")).alias("_fallback")).agg(F.count(F.lit(1)).alias("_key_n"))
    mapping = counts.select(
        "_raw_key", F.when(F.col("_key_n") < min_count, F.col("_fallback")).otherwise(F.col("_raw_key")).alias("stratify_key")
    )
    return d.join(materialize(mapping, "strata"), "_raw_key").drop("_raw_key")


def stratum_quotas(sizes: DataFrame, key: str = "stratify_key", ratios: Sequence[int] = (8, 1, 1)) -> DataFrame:
    """Per stratum (key, c): train_q, valid_q, test_q.  Input has one row per stratum."""
    r_train, r_valid, r_test = (int(x) for x in ratios)
    total_r = r_train + r_valid + r_test
    held_r = r_valid + r_test
    everything = Window.partitionBy()
    d = sizes.withColumn("_n", F.sum("c").over(everything))
    d = d.withColumn("_n_temp", F.expr(f"(_n * {held_r} + {total_r - 1}) div {total_r}"))
    d = d.withColumn("_n_train", F.col("_n") - F.col("_n_temp"))
    d = _allocate(d, key, "c", "_n_train", "_n", "train_q")
    d = d.withColumn("_temp_q", F.col("c") - F.col("train_q"))
    d = d.withColumn("_n_test", F.expr(f"(_n_temp * {r_test} + {held_r - 1}) div {held_r}") if held_r else F.lit(0))
    d = d.withColumn("_n_valid", F.col("_n_temp") - F.col("_n_test"))
    d = _allocate(d, key, "_temp_q", "_n_valid", "_n_temp", "valid_q")
    d = d.withColumn("test_q", F.col("_temp_q") - F.col("valid_q"))
    return d.select(key, "c", "train_q", "valid_q", "test_q")


def _allocate(d: DataFrame, key: str, counts: str, target: str, total: str, out: str) -> DataFrame:
    """Largest remainder: floor(c*target/total) plus one for the strata with the
    largest remainders (ties by key) until ``target`` is met.  Integers only."""
    d = d.withColumn("_fl", F.expr(f"({counts} * {target}) div greatest({total}, 1)"))
    d = d.withColumn("_rem", F.expr(f"({counts} * {target}) % greatest({total}, 1)"))
    d = d.withColumn("_left", F.col(target) - F.sum("_fl").over(Window.partitionBy()))
    d = d.withColumn("_rk", F.row_number().over(Window.orderBy(F.desc("_rem"), F.asc(key))))
    d = d.withColumn(out, (F.col("_fl") + F.when(F.col("_rk") <= F.col("_left"), 1).otherwise(0)).cast("bigint"))
    return d.drop("_fl", "_rem", "_left", "_rk")


def split_hash(uid: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), uid))


def cut_points(keys: DataFrame, quotas: DataFrame, digits: int = DIGITS, levels: int = LEVELS) -> DataFrame:
    """(_k, _test, _held): (hash, uid) of the last test row and of the last held-out row of each stratum.

    ``keys`` has one row (_k, _h, _u) per row of the corpus, ``quotas`` (_k, test_q,
    valid_q) one per stratum.  A stratum without test (held-out) rows has a null cut.
    """
    wanted = F.array(
        F.struct(F.lit("_test").alias("cut"), F.col("test_q").alias("need")),
        F.struct(F.lit("_held").alias("cut"), (F.col("test_q") + F.col("valid_q")).alias("need")),
    )
    cuts = quotas.select("_k", F.explode(wanted).alias("w")).select("_k", F.col("w.cut").alias("_cut"), F.col("w.need").alias("_need"), F.lit("").alias("_p"))
    cuts = cuts.where("_need > 0")
    for i in range(levels + 1):
        rows = keys.withColumn("_p", F.substring("_h", 1, digits * i))
        if i:
            rows = rows.join(cuts.select("_k", "_p").distinct(), ["_k", "_p"], "left_semi")
        part = [F.substring("_h", 1, digits * (i + 1)).alias("_q")] if i < levels else ["_h", "_u"]
        cells = rows.groupBy("_k", "_p", *part).agg(F.count(F.lit(1)).alias("_n"))
        order = ["_q"] if i < levels else ["_h", "_u"]
        before = Window.partitionBy("_k", "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        cuts = cuts.join(cells, ["_k", "_p"]).where("_before < _need and _need <= _before + _n")
        if i < levels:
            cuts = cuts.select("_k", "_cut", (F.col("_need") - F.col("_before")).alias("_need"), F.col("_q").alias("_p"))
            cuts = materialize(cuts, f"split-cuts{i}")
    end = F.struct("_h", "_u")
    return cuts.groupBy("_k").agg(*[F.max(F.when(F.col("_cut") == c, end)).alias(c) for c in ("_test", "_held")])


def stratified_split(
    df: DataFrame,
    key: str = "stratify_key",
    uid: str = "uid",
    ratios: Sequence[int] = (8, 1, 1),
    seed: int = 42,
    digits: int = DIGITS,
    levels: int = LEVELS,
) -> DataFrame:
    """Add ``split`` in {train, valid, test} to every row of ``df``.

    Sizes are exact where uids differ inside a stratum (:func:`prep.prepare` sees to
    it); rows of one stratum with the same uid share a split, null counts as an
    empty uid, and a null key is a stratum of its own.  An empty table gives an
    empty result.
    """
    u = F.coalesce(F.col(uid).cast("string"), F.lit(""))
    tagged = df.withColumns({"_k": F.struct(F.col(key).alias("key")), "_h": split_hash(u, seed), "_u": u})
    keys = materialize(tagged.select("_k", "_h", "_u"), "split-keys")
    sizes = keys.groupBy("_k").agg(F.count(F.lit(1)).alias("c"))
    quotas = materialize(stratum_quotas(sizes, "_k", ratios).select("_k", "valid_q", "test_q"), "split-quotas")
    cuts = materialize(cut_points(keys, quotas, digits, levels), "split-points")
    place = F.struct("_h", "_u")
    split = (
        F.when(F.coalesce(place <= F.col("_test"), F.lit(False)), F.lit("test"))
        .when(F.coalesce(place <= F.col("_held"), F.lit(False)), F.lit("valid"))
        .otherwise(F.lit("train"))
    )
    return tagged.join(cuts, "_k", "left").select(*df.columns, split.alias("split"))


def split_sizes(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_label_share(splits: DataFrame, label: str = "label", names=LABEL_TO_NAME) -> DataFrame:
    """Label share (%) per split, by label name."""
    g = splits.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))
    pct = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("split")), 6)
    return g.select("split", label, label_name(F.col(label), names).alias("label_name"), "n", pct.alias("pct"))


def split_invariants(splits: DataFrame, source: DataFrame, uid: str = "uid") -> DataFrame:
    """Checks that must all be 0, as (check, n).

    Pairwise overlaps are the sizes of ``intersectAll`` of the split uid
    lists, 'missing'/'extra' the sizes of ``exceptAll`` between the input and
    the union of the splits.  All five multiset sizes come from one grouped
    count per uid (sum of min / positive differences of the per-uid
    multiplicities) -- one narrow shuffle instead of five set operations.
    """
    tagged = splits.select(uid, F.col("split").alias("_t")).unionByName(source.select(uid, F.lit("_source").alias("_t")))
    per = tagged.groupBy(uid).agg(*[F.count_if(F.col("_t") == t).alias(f"_{t}") for t in (*SPLITS, "_source")])
    in_splits = F.col("_train") + F.col("_valid") + F.col("_test")
    checks = {
        "train_valid_overlap": F.least("_train", "_valid"),
        "train_test_overlap": F.least("_train", "_test"),
        "valid_test_overlap": F.least("_valid", "_test"),
        "missing_from_splits": F.greatest(F.col("__source") - in_splits, F.lit(0)),
        "extra_in_splits": F.greatest(in_splits - F.col("__source"), F.lit(0)),
    }
    wide = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for name, c in checks.items()])
    return wide.unpivot([], list(checks), "check", "n")
