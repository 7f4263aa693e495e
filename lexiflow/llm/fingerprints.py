"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A document is a weighted set: its words (runs outside ``[\\x20\\x09-\\x0D]``) with
their counts.  For sample ``k`` a term of weight S has, from a hash of (term, k),
r and c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln S / r + b) the sample is
the term and t of least ln a = ln c - r (t + 1 - b).  Two documents agree in a
sample with probability sum(min) / sum(max) of their weights, the generalised
Jaccard similarity.  r and ln c come from tables of 4,096 quantile midpoints of
the Gamma distribution, b has 32 bits; for equal weights any identical draw gives
exact collision rates, so the tables touch only unequal weights, slightly.

Texts are shuffled once, by buckets of the document order; counting, sampling and
comparing with the next document stay in that partitioning.  Buckets are cut by id,
hash of the text and place of reading, so equal ids and repeated rows fill as many
buckets as their texts need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.sources.tables import materialize

SAMPLES = 64
CHUNK = 2
TABLE_BITS = 12
WS = r"[\x20\x09-\x0D]+"
#: text of a bucket; on small tables at least SMALL_BYTES
BUCKET_BYTES, SMALL_BYTES, UNIT_BYTES = 128 << 20, 4 << 20, 2 << 10
_LOWEST = -(1 << 63)


def gamma_quantiles(n: int) -> list[float]:
    """Midpoint quantiles of Gamma(2, 1): solutions of 1 - (1 + x) exp(-x) = (i + 1/2) / n."""
    out, x = [], 0.0
    for i in range(n):
        u, lo, hi = (i + 0.5) / n, x, 60.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 1 - (1 + mid) * math.exp(-mid) < u else (lo, mid)
        x = lo
        out.append(hi)
    return out


def _table(values: list[float]) -> Column:
    return F.expr(f"cast(split('{','.join(map(repr, values))}', ',') as array<double>)")


def sample_minima(terms: DataFrame, keys: list[str], weights: dict[str, str], samples: int = SAMPLES, extra: dict[str, Column] | None = None) -> DataFrame:
    """Signatures of weighted sets given as rows (keys, h, weight columns).

    ``weights`` maps an output name to a weight column; a weight of 0 or null is not
    in that set.  The result has one row per key with an array of ``samples`` longs
    per name; sets without a term have -1 everywhere.  ``extra`` are aggregates over
    the rows of a key with chunk number ``g`` 0.
    """
    n = 1 << TABLE_BITS
    g = gamma_quantiles(n)
    df = terms.withColumn("_r", _table(g)).withColumn("_c", _table([math.log(x) for x in g]))
    chunks = samples // CHUNK
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.when(F.expr(" or ".join(f"{w} > 0" for w in weights.values())), F.lit(chunks - 1)).otherwise(F.lit(0)))).alias("g"))
    carried = [c for c in terms.columns]
    logs = [F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).alias(f"_l_{name}") for name, w in weights.items()]
    df = df.select(*carried, "g", "_r", "_c", *logs, *[F.xxhash64("h", F.col("g") * CHUNK + j).alias(f"x{j}") for j in range(CHUNK)])
    names = [f"_l_{name}" for name in weights]
    df = df.select(
        *carried, "g", *names, *[f"x{j}" for j in range(CHUNK)],
        *[F.expr(f"_r[cast(x{j} & {n - 1} as int)]").alias(f"r{j}") for j in range(CHUNK)],
        *[F.expr(f"_c[cast(shiftrightunsigned(x{j}, {TABLE_BITS}) & {n - 1} as int)]").alias(f"c{j}") for j in range(CHUNK)],
        *[F.expr(f"shiftrightunsigned(x{j}, 32) / 4294967296D").alias(f"b{j}") for j in range(CHUNK)],
    )
    mins = []
    for name in weights:
        for j in range(CHUNK):
            t = f"floor(_l_{name} / r{j} + b{j})"
            ln_a = f"c{j} - r{j} * ({t} + 1 - b{j})"
            # ln a as 40 bits above 24 bits that name the term and t: one long, least first
            mins.append(F.expr(f"min(shiftleft(cast(({ln_a} + 128D) * 1073741824D as bigint), 24) | ((x{j} + {t}) & 16777215))").alias(f"m_{name}_{j}"))
    part = df.groupBy(*keys, "g").agg(*mins, *[c.alias(k) for k, c in (extra or {}).items()])
    lists = [
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", F.array(*[F.coalesce(f"m_{name}_{j}", F.lit(-1)) for j in range(CHUNK)]).alias("m")))), lambda x: x["m"])).alias(f"f_{name}")
        for name in weights
    ]
    out = part.groupBy(*keys).agg(*lists, *[F.max(k).alias(k) for k in (extra or {})])
    full = {f"f_{name}": F.when(F.size(f"f_{name}") == samples, F.col(f"f_{name}")).otherwise(F.array_repeat(F.lit(-1).cast("long"), samples)) for name in weights}
    return out.withColumns(full)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples on which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def fingerprint_text(sig: Column) -> Column:
    """A signature as text: 16 bits a sample, in hexadecimal."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(65535)))), 4, "0")), "")


def order_key() -> Column:
    """id descending, hash of the text, place of reading, as text of 48 hexadecimal digits that sorts in this order.

    The place parts rows that are equal in id and text, so that no id and no group of copies is one task's work;
    which of such rows comes first changes no result.
    """
    digits = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(_LOWEST))), 16, "0")
    return F.concat(digits(F.bitwise_not("id")), digits(F.xxhash64("text")), digits(F.monotonically_increasing_id()))


def bucket_starts(docs: DataFrame, buckets: int | None = None) -> list[str]:
    """Least order key of each bucket, ascending; Spark's range partitioner cuts the narrow, written keys.

    A key counts once per UNIT_BYTES of its text, so buckets hold about equal bytes.  There are enough for BUCKET_BYTES of text each, and on
    small tables for all tasks of a shuffle, as long as they hold SMALL_BYTES each.
    """
    keys = materialize(docs.select(order_key().alias("k"), F.octet_length("text").cast("long").alias("size")), "fp-keys")
    if buckets is None:
        size = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        wide = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(1, math.ceil(size / BUCKET_BYTES), min(wide, math.ceil(size / SMALL_BYTES)))
    weighed = keys.select(F.explode(F.array_repeat("k", (1 + F.floor(F.col("size") / UNIT_BYTES)).cast("int"))).alias("k"))
    parts = weighed.repartitionByRange(buckets, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    return sorted({r["k"] for r in parts.collect()})


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, rn, ghost, id, doc_id, text, next_text) in descending doc_id order, ties by the text's hash.

    ``docs`` has id, doc_id, text.  A bucket's first row is repeated as a ghost at the
    end of the bucket before it (the very first one at the end of the last bucket),
    so every real row meets its next document inside its own bucket.  Texts are
    shuffled once, to as many tasks as there are buckets.
    """
    starts = bucket_starts(docs, buckets) or ["0" * 48]
    step = max(1, math.isqrt(len(starts)))
    listed = lambda keys: F.expr(f"split('{','.join(keys)}', ',')")
    df = docs.withColumn("k", order_key())
    # the last start not above the key, found in two short scans
    df = df.withColumn("_top", F.greatest(F.size(F.filter(listed(starts[::step]), lambda x: x <= F.col("k"))) - 1, F.lit(0)) * step)
    df = df.withColumn("bucket", F.greatest(F.col("_top") + F.size(F.filter(F.slice(listed(starts), F.col("_top") + 1, F.lit(step)), lambda x: x <= F.col("k"))) - 1, F.lit(0)))
    before = F.when(F.col("bucket") == 0, F.lit(len(starts) - 1)).otherwise(F.col("bucket") - 1)
    mine = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    is_start = F.element_at(listed(starts), F.col("bucket") + 1) == F.col("k")
    places = F.when(is_start, F.array(mine, F.struct(before.alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.array(mine))
    df = df.select("id", "doc_id", "text", "k", F.explode(places).alias("p")).select("id", "doc_id", "text", "k", "p.bucket", "p.ghost")
    w = Window.partitionBy("bucket").orderBy("ghost", "k")
    df = df.repartitionById(len(starts), F.col("bucket").cast("int"))
    return df.withColumn("rn", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w)).drop("k")


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in as many code points of the next document (descending
    doc_id, null last, ties by the text's hash) as half the text has; the last document is
    followed by the first.  Null counts as empty.  Texts without words have a
    fingerprint of their own and are alike only among themselves.  Each repeated row
    is a document; equal ones follow each other.  ``docs`` is read twice and must give its
    rows in the same order both times, as tables in files do.  An empty table
    gives an empty result; other columns are not read.
    """
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = with_next(src)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    df = df.withColumn("n", n).withColumn("edited", edited)
    df = df.withColumn("sha", F.sha2("edited", 256)).withColumn("wo", F.split("text", WS)).withColumn("we", F.split("edited", WS))
    # the columns to carry along travel as hexadecimal items behind the words
    meta = [*[F.substring("sha", 16 * i + 1, 16) for i in range(4)], F.hex(F.col("n").cast("long")), F.hex("doc_id"), F.hex(F.col("ghost").cast("long"))]
    items = F.concat("wo", "we", F.array(*meta))
    df = df.select("bucket", "rn", F.size("wo").alias("no"), (F.size("wo") + F.size("we")).alias("nw"), F.posexplode(items).alias("pos", "term"))
    df = df.where("pos >= nw or term <> ''")
    df = df.select(
        "bucket", "rn",
        F.expr("case when pos < nw then 0 else pos - nw + 1 end").alias("tag"),
        F.expr("case when pos < nw then xxhash64(term) else cast(conv(term, 16, -10) as bigint) end").alias("h"),
        F.expr("case when pos < no then 1 else 0 end").alias("o"),
        F.expr("case when pos >= no and pos < nw then 1 else 0 end").alias("e"),
    )
    terms = df.groupBy("bucket", "rn", "tag", "h").agg(F.sum("o").alias("o"), F.sum("e").alias("e"))
    extra = {f"v{i}": F.max(F.when(F.col("tag") == i, F.col("h"))) for i in range(1, 8)}
    sig = sample_minima(terms, ["bucket", "rn"], {"o": "o", "e": "e"}, samples, extra)
    nxt = F.lead("f_o").over(Window.partitionBy("bucket").orderBy("rn"))
    sig = sig.withColumn("f_next", nxt).where("v7 = 0")
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"v{i}"), 16, "0") for i in range(1, 5)]))
    return sig.select(
        F.col("v6").alias("doc_id"), F.col("v5").alias("n_chars"), sha.alias("edited_sha256"),
        fingerprint_text(F.col("f_o")).alias("fingerprint"), fingerprint_text(F.col("f_e")).alias("edited_fingerprint"),
        likeness(F.col("f_o"), F.col("f_e"), samples).alias("near_edited"), likeness(F.col("f_o"), F.col("f_next"), samples).alias("near_next"),
    )
