"""Filter interaction audit: what each order of five text filters removes.

Four filters look at one text; their failure bits come from one pass over the texts (bytes
work inside ``mapInArrow``).  The fifth, E, is an existential self-join: a row fails if an
identical text with a smaller doc_id exists.  Only rows whose hash stands in the table more
than once take part; the side that is looked for is first reduced to the least doc_id of
each (hash, text), so that the left-semi join on hash, exact text and smaller doc_id meets
one row a text however many copies there are, and the copies of a hot text are salted by
their number of bytes.

The ids that E finds are united with the failure ids of the other filters and the bits are
combined per document.  A combination of failed filters decides what happens in every
order, so the table is reduced to counts of (part, combination); the 120 orders are worked
out on these counts only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.sources.tables import materialize

FILTERS = "ABCDE"
MIN_WORDS = 200
SYMBOLS = b"#$%&*|"
#: a text is split into words in stretches of this size
STRETCH = 1 << 20
#: text of one hot group of copies that one task takes
SALT_BYTES = 64 << 20
#: greatest size of the bitmap, as a power of two of bits (32 MB)
BITMAP_POWER = 28

_CAPITALS = bytes(range(0x41, 0x5B))
_FOLLOWING = bytes(range(0x80, 0xC0))
_BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def word_counts(text: bytes, stretch: int = STRETCH) -> tuple[int, int]:
    """Words and distinct words; a long text is cut at blanks, so only its distinct words are held at once."""
    if len(text) <= stretch:
        words = text.split()
        return len(words), len(set(words))
    total, seen, start = 0, set(), 0
    while start < len(text):
        cut = min(start + stretch, len(text))
        ends = [e for b in _BLANKS if (e := text.find(b, cut, cut + stretch)) >= 0] if cut < len(text) else []
        while cut < len(text) and not ends:  # a word longer than a stretch
            cut += stretch
            ends = [e for b in _BLANKS if (e := text.find(b, cut, cut + stretch)) >= 0]
        cut = min(ends) if ends else len(text)
        words = text[start:cut].split()
        total += len(words)
        seen.update(words)
        start = cut
    return total, len(seen)


def failure_bits(text: bytes) -> int:
    """Bits 1, 2, 4, 8 of the filters A to D that a UTF-8 text fails."""
    words, distinct = word_counts(text)
    points = len(text.translate(None, _FOLLOWING))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (words < MIN_WORDS)
        | (100 * distinct < 50 * words) << 1
        | (100 * capitals > 2 * points) << 2
        | any(c in text for c in SYMBOLS) << 3
    )


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, hashes, sizes, keys = [], [], [], []
        for value in batch.column("_text").cast(pa.binary()):
            text = value.as_py() or b""
            bits.append(failure_bits(text))
            hashes.append(hashlib.sha256(text).digest())
            keys.append(_key(hashes[-1]))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(bits, pa.int32()), pa.array(hashes, pa.binary()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())],
            names=["doc_id", "part", "bits", "hash", "key", "size"],
        )


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:7], "little")


def _marked(bc):
    """Rows with an id whose hash is in the bitmap, with text and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bc.value
        last = 64 * len(bitmap) - 1
        for batch in batches:
            rows, hashes = [], []
            for i, value in enumerate(batch.column("text").cast(pa.binary())):
                digest = hashlib.sha256(value.as_py() or b"").digest()
                at = _key(digest) & last
                if int(bitmap[at >> 6]) >> (at & 63) & 1:
                    rows.append(i)
                    hashes.append(digest)
            some = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(hashes, pa.binary())], names=["doc_id", "part", "text", "hash"])

    return run


def _rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))


def failing_rows(docs: DataFrame) -> DataFrame:
    """Written table: doc_id, part, hash (and its first bytes as key), size and the failure bits A to D of every row."""
    source = _rows_of(docs).withColumnRenamed("text", "_text")
    return materialize(source.mapInArrow(_bits, "doc_id long, part string, bits int, hash binary, key long, size long"), "audit-rows")


def identical_to_smaller(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, hash, part) of the rows that fail E, distinct."""
    many = rows.groupBy("hash", "key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where("n > 1")
    many = materialize(many.select("hash", "key", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("size") / SALT_BYTES)).cast("int").alias("salts")), "audit-many")
    power = min(BITMAP_POWER, max(6, math.ceil(math.log2(many.count() * 16 + 1))))
    at = F.col("key").bitwiseAND(F.lit((1 << power) - 1))
    marks = many.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((key & {(1 << power) - 1}L) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (power - 6), np.uint64)
    bitmap[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    bc = docs.sparkSession.sparkContext.broadcast(bitmap)
    texts = _rows_of(docs).where("doc_id is not null").select("doc_id", "part", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.mapInArrow(_marked(bc), "doc_id long, part string, text string, hash binary")
    copies = materialize(texts.join(many.drop("key"), "hash"), "audit-copies")
    least = copies.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("least"))
    s = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("s")
    c = copies.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).alias("c")
    same = (F.col("c.hash") == F.col("s.hash")) & (F.col("c.salt") == F.col("s.salt")) & (F.col("c.text") == F.col("s.text"))
    return c.join(s, same & (F.col("s.least") < F.col("c.doc_id")), "left_semi").select("doc_id", "hash", "part").distinct()


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): rows of each part by combination of failed filters, and how many of them have each label."""
    rows = failing_rows(docs)
    failed = rows.select("doc_id", "hash", "part", "bits", F.lit(1).alias("row")).unionByName(
        identical_to_smaller(docs, rows).select("doc_id", "hash", "part", F.lit(16).alias("bits"), F.lit(0).alias("row"))
    )
    # rows of one id, text and part fail the same filters; null ids meet no label and spread by a second key
    failed = failed.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("hash"), F.lit(4096)) + 1).otherwise(0))
    each = failed.groupBy("doc_id", "spread", "hash", "part").agg(F.bit_or("bits").alias("bits"), F.sum("row").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("spread")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    marked = each.join(marks, ["doc_id", "spread"], "left")
    return marked.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def _steps() -> list[tuple[int, int]]:
    """(bits of the filters before, bit of the filter): the 80 different steps that all orders are made of."""
    bits = [1 << i for i in range(len(FILTERS))]
    return [(sum(before), bit) for bit in bits for k in range(len(bits)) for before in combinations([b for b in bits if b != bit], k)]


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits before, bit) of all 120 orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        out += [(name, k + 1, sum(1 << i for i in order[:k]), 1 << order[k]) for k in range(len(order))]
    return out


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters A to E as in the module's constants: under 200 words, under half of the words
    distinct, over 2 % capitals A-Z, one of ``# $ % & * |``, text identical to that of a smaller
    doc_id anywhere in the table.  A part is a value of ``source`` (null: empty string); every
    part has all 600 rows.  Null texts are empty (so they fail A and, repeated, E).  A null
    doc_id is neither smaller nor larger than another and has no label; rows that repeat one
    doc_id count singly and are no copies of each other.  A label counts if any row of ``labels``
    with that doc_id says so.  An empty table gives no rows; other columns are not read.
    """
    counts = failure_counts(docs, labels)
    steps = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("bit")) for a, b in _steps()])
    each = counts.select("part", "bits", "n", "good", "toxic", F.explode(steps).alias("s")).select("*", "s.before", "s.bit").drop("s")
    fails, early = F.col("bits").bitwiseAND(F.col("bit")) > 0, F.col("bits").bitwiseAND(F.col("before")) > 0

    def total(rows, column: str = "n"):
        return F.sum(F.when(rows, F.col(column)).otherwise(0)).cast("long")

    per_step = each.groupBy("part", "before", "bit").agg(
        total(~fails & ~early).alias("kept"), total(fails & ~early).alias("removed"), total(fails & early).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"), total(fails & ~early, "good").alias("good_lost"), total(fails & ~early, "toxic").alias("toxic_lost"),
        # in the 120 orders a row that fails k filters is removed by each of them 120 / k times
        F.sum(F.when(fails, F.col("n") * F.expr("120 div bit_count(bits)")).otherwise(0)).cast("long").alias("shapley"),
    )
    orders = docs.sparkSession.createDataFrame(_orders(), "filter_order string, step int, before int, bit int")  # 600 rows
    return per_step.join(F.broadcast(orders), ["before", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
