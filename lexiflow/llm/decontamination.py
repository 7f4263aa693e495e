"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z), every other byte than a word byte becomes a space and runs of
spaces one, so that a window of words is one byte string with a space at both ends.  The
windows of all benchmark items are the patterns.  They are grouped by length; in a group
only the first ``m`` bytes of a pattern take part in the search:

1. a block of ``b`` bytes at the end of the search window is looked up in the shift table,
   which says how far the window can move without missing a pattern; in clean text that is
   nearly ``m`` bytes, so most positions are never looked at;
2. where the shift is 0 the block selects a bucket, the patterns that have it as the end of
   their first ``m`` bytes;
3. the text's next words are compared directly with the strings of the bucket.

The search runs over thousands of stretches of one buffer in step (numpy), inside
``mapInArrow``; documents aren't shuffled.  The patterns go to the tasks in blocks of a
bounded number of bytes, one broadcast and one pass over the documents a block, whatever
the size of the benchmark.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.textops import slices
from lexiflow.sources.tables import materialize

#: words of a window
WINDOW = 10
#: bytes of patterns and item ids that one pass broadcasts
BLOCK_BYTES = 32 << 20
#: text that is searched at once, and a stretch of it
SLICE = 4 << 20
STRETCH = 1024
#: least pattern lengths of the groups
GROUPS = (64, 32, 16, 8, 3)

SPACE, BREAK = 32, 10
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _fold() -> bytes:
    """Word bytes (digits, letters in lower case, all of non-ASCII characters) stay, others become spaces."""
    table = bytearray(b" " * 256)
    for c in range(256):
        if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80:
            table[c] = c
        elif 0x41 <= c <= 0x5A:
            table[c] = c + 32
    return bytes(table)


FOLD = _fold()


def windows_of(text: str | None, width: int = WINDOW) -> list[bytes]:
    """Distinct windows of one item: ``width`` words in a row, or all words of a shorter item."""
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return []
    k = min(width, len(words))
    return list(dict.fromkeys(b" " + b" ".join(words[i : i + k]) + b" " for i in range(len(words) - k + 1)))


class Group:
    """Shift table and buckets of patterns of at least ``m`` bytes."""

    def __init__(self, patterns: list[tuple[bytes, int, int]], m: int):
        self.m, self.b = m, min(8, m // 2 + 1)
        self.mask = np.uint64((1 << (8 * self.b)) - 1)
        steps = m - self.b + 1
        heads = np.frombuffer(b"".join(p[:m] for p, _, _ in patterns), dtype=np.uint8).reshape(-1, m)
        heads = np.concatenate((heads, np.zeros((len(heads), 8), np.uint8)), axis=1)
        bits = min(24, max(12, math.ceil(math.log2(len(patterns) * steps)) + 2))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, steps, dtype=np.int8)
        for at in range(steps):  # the largest shift first, the least one is written last and stays
            block = np.ascontiguousarray(heads[:, at : at + 8]).view("<u8").ravel() & self.mask
            self.shift[(block * _MULT) >> self.down] = steps - 1 - at
        self.buckets: dict[int, dict[bytes, int]] = defaultdict(dict)
        for (p, _, number), last in zip(patterns, block.tolist(), strict=True):
            self.buckets[last][p] = number
        self.buckets = dict(self.buckets)
        self.words = sorted({k for _, k, _ in patterns})

    def candidates(self, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``text`` (``n`` bytes and 8 of padding) whose shift is 0, and their blocks."""
        load = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=text, strides=(1,))
        pos = np.arange(0, n - self.m + 1, STRETCH)
        end = np.minimum(pos + STRETCH, n - self.m + 1)
        found, blocks = [], []
        while len(pos):
            block = load[pos + (self.m - self.b)] & self.mask
            step = self.shift[(block * _MULT) >> self.down]
            hit = np.flatnonzero((step == 0) & (text[pos] == SPACE))
            if len(hit):
                found.append(pos[hit])
                blocks.append(block[hit])
            pos = pos + np.maximum(step, 1)
            on = pos < end
            pos, end = pos[on], end[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(found), np.concatenate(blocks)


class Matcher:
    """All groups of one block of patterns; ``items[i]`` are the item ids of pattern ``i``."""

    def __init__(self, patterns: dict[bytes, list[str]]):
        self.items = [sorted(v) for v in patterns.values()]
        rest = [(p, p.count(b" ") - 1, i) for i, p in enumerate(patterns)]
        self.groups = []
        for m in GROUPS:
            mine = [x for x in rest if len(x[0]) >= m]
            rest = [x for x in rest if len(x[0]) < m]
            if mine:
                self.groups.append(Group(mine, m))

    def search(self, pieces: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Words of each folded piece, and (piece, first word, words, pattern) of every occurrence."""
        raw = b" " + b" \n ".join(pieces) + b" "
        a = np.frombuffer(raw, dtype=np.uint8)
        blank = a == SPACE
        keep = ~blank
        keep[0] = True
        keep[1:] |= ~blank[:-1]
        a = a[keep]
        n = len(a)
        text = np.concatenate((a, np.zeros(16, np.uint8)))
        raw = a.tobytes()
        space = np.flatnonzero(a == SPACE)
        first = np.concatenate(([0], np.searchsorted(space, np.flatnonzero(a == BREAK)), [len(space)]))
        hits = []
        for g in self.groups:
            pos, block = g.candidates(text, n)
            if not len(pos):
                continue
            at = np.searchsorted(space, pos)
            piece = np.searchsorted(first, at, side="right") - 1
            for k in g.words:
                inside = np.flatnonzero(at + k < len(space))
                ends = space[at[inside] + k]
                for p, e, b, q, w in zip(pos[inside].tolist(), ends.tolist(), block[inside].tolist(), piece[inside].tolist(), at[inside].tolist(), strict=True):
                    bucket = g.buckets.get(b)
                    if bucket is not None:
                        number = bucket.get(raw[p : e + 1])
                        if number is not None:
                            hits.append((q, w - int(first[q]), k, number))
        return np.diff(first) - 1, hits


def _pieces(text: bytes, limit: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(words before, words repeated, piece): a long folded text in pieces that overlap by ``width - 1`` words."""
    if len(text) <= limit:
        yield 0, 0, text
        return
    start, done, tail = 0, 0, []
    while start < len(text):
        cut = text.find(b" ", min(start + limit, len(text)))
        cut = len(text) if cut < 0 else cut
        part = text[start:cut]
        yield done - len(tail), len(tail), b" ".join((*tail, part))
        done += _count(part)
        tail = (tail + part.rsplit(None, width - 1)[-(width - 1) :])[-(width - 1) :] if width > 1 else []
        start = cut


def _count(part: bytes) -> int:
    """Words of a folded text, without a list of them."""
    a = np.frombuffer(part, dtype=np.uint8) != SPACE
    return int(a[0]) + int(np.count_nonzero(a[1:] & ~a[:-1])) if len(a) else 0


def _spans(found: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Union of (first word, words), as disjoint spans in order."""
    out: list[list[int]] = []
    for start, k in sorted(found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + k)
        else:
            out.append([start, start + k])
    return [{"start": a, "length": b - a} for a, b in out]


def _union(spans: Column) -> Column:
    """Union of a sorted array of spans, as disjoint spans."""

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        end = F.greatest(last["start"] + last["length"], s["start"] + s["length"])
        longer = F.named_struct(F.lit("start"), last["start"], F.lit("length"), end - last["start"])
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when(last["start"] + last["length"] >= s["start"], grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _searcher(bc, width: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = bc.value
        for whole in batches:
            for batch in slices(whole, "_text", limit):
                rows = batch.num_rows
                count = np.zeros(rows, np.int64)
                spans: dict[int, set[tuple[int, int]]] = defaultdict(set)
                items: dict[int, set[str]] = defaultdict(set)
                todo: list[tuple[int, int, int, bytes]] = []

                def search(todo=todo, count=count, spans=spans, items=items) -> None:
                    words, hits = matcher.search([p for _, _, _, p in todo])
                    for (row, _, again, _), n in zip(todo, words.tolist(), strict=True):
                        count[row] += n - again
                    for q, w, k, number in hits:
                        row, before = todo[q][:2]
                        spans[row].add((before + w, k))
                        items[row].update(matcher.items[number])
                    todo.clear()

                size = 0
                for row, text in enumerate(batch.column("_text").cast(pa.binary()).to_pylist()):
                    for before, again, piece in _pieces((text or b"").translate(FOLD), limit, width):
                        todo.append((row, before, again, piece))
                        size += len(piece)
                        if size >= limit:
                            search()
                            size = 0
                if todo:
                    search()
                columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
                names = [n for n in batch.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *columns,
                        pa.array(count),
                        pa.array([_spans(list(spans[r])) if r in spans else [] for r in range(rows)], type=_SPANS),
                        pa.array([sorted(items[r]) if r in items else [] for r in range(rows)], type=pa.list_(pa.string())),
                    ],
                    names=[*names, "n_words", "spans", "item_ids"],
                )

    return run


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            # an item at a time: a window repeats its words up to ``width`` times
            found = windows_of(text, width)
            for i in range(0, len(found), 10_000):
                part = found[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], names=["item", "pattern"])


def pattern_blocks(benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Written table (block, item, pattern) of distinct windows, and its number of blocks.

    A row's block comes from its hash, so that each holds about ``block_bytes`` at most,
    also where one window stands in very many items.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    made = items.mapInArrow(lambda it: _windows(it, width), "item string, pattern binary")
    rows = materialize(made.distinct(), "dc-patterns")
    size = rows.agg(F.sum(F.octet_length("pattern") + F.octet_length("item") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    return rows.select(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)).cast("int").alias("block"), "item", "pattern"), blocks


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | tuple[str, ...] = ("doc_id",), text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE
) -> DataFrame:
    """Every document with its benchmark passages.

    ``docs`` needs the columns ``text`` and ``keep``, ``benchmark`` item_id and text; other
    columns don't matter.  Returns ``keep``, n_words, spans (disjoint runs of hit words: start,
    length, in words) and item_ids (as strings, distinct, in order of their bytes), one row per
    row of ``docs``.

    A window is ``width`` words in a row of one item; an item with fewer words, but not none,
    is one window.  Null texts have no words.  An item without id has the id ''; repeated items
    count once.  Null and repeated document ids are rows like any other.  Very long texts are
    searched in pieces that overlap by ``width - 1`` words.  An empty benchmark hits nothing.
    """
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("_text"))
    kept = T.StructType([source.schema[n] for n in names])
    patterns, blocks = pattern_blocks(benchmark, width, block_bytes)
    spark = docs.sparkSession

    def one(block: int, rows: DataFrame, columns: T.StructType) -> DataFrame:
        mine: dict[bytes, list[str]] = defaultdict(list)
        for r in patterns.where(F.col("block") == block).select("item", "pattern").collect():  # at most block_bytes
            mine[bytes(r.pattern)].append(r.item)
        bc = spark.sparkContext.broadcast(Matcher(mine))
        return rows.mapInArrow(_searcher(bc, width, slice_bytes), T.StructType([*columns.fields, *FOUND.fields]))

    back: list[Column] = [F.col(n).alias(c) for c, n in zip(keep, names, strict=True)]
    if blocks == 1:
        return one(0, source, kept).select(*back, "n_words", "spans", "item_ids")
    # rows of equal kept columns and text have equal results: they are merged and counted, then repeated
    source = source.withColumn("_hash", F.sha2(F.coalesce(F.col("_text"), F.lit("")), 256))
    keyed = T.StructType([*kept.fields, T.StructField("_hash", T.StringType())])
    parts = []
    for block in range(blocks):
        part = one(block, source, keyed)
        if block:
            part = part.where(F.size("spans") > 0)
        parts.append(materialize(part.withColumn("_rows", F.lit(1 if block == 0 else 0)), f"dc-block-{block}"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    grouped = whole.groupBy(*names, "_hash").agg(
        F.first("n_words").alias("n_words"), F.collect_set("spans").alias("s"), F.collect_set("item_ids").alias("i"), F.sum("_rows").alias("_rows")
    )
    merged = grouped.select(
        *back, "n_words", _union(F.array_sort(F.flatten("s"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten("i"))).alias("item_ids"), F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_n"),
    )
    return merged.drop("_n")


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of :func:`find_contamination`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
