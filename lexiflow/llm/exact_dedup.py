"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their normalised content; a bucket is
partitioned further into spill files until what is left fits an open-addressing
table, and the table compares complete content, so two different texts are
never merged.

1. Every task over the input deduplicates what it reads (one table, spill files
   when it is full) and keeps one full text per distinct content, with the size
   of the group and its best row: a group that holds a third of all rows leaves
   a task as one record.
2. These records are shuffled by content hash and deduplicated again.
3. The result (narrow: record number, row that stays, group size) joins the rows.

Texts are written once to the shared folder, so a lost executor re-reads them.
Spill files live in the task's own temporary folder and end with the task.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.textops import WS, row_numbers
from lexiflow.sources.tables import materialize

#: bytes of distinct text a table holds before further texts go to spill files
TABLE_BYTES = 48 << 20
FANOUT = 16
#: spill record: digest, rows, best row (code points, doc_id, row, doc_id is null), bytes of text, tag
_HEAD = "<32sqqqq?Iq"
_HEAD_BYTES = struct.calcsize(_HEAD)


class Group:
    """One distinct content: members, and the best row (most code points, smallest doc_id, first row)."""

    __slots__ = ("digest", "text", "n", "best", "tags")

    def __init__(self, digest: bytes, text: bytes):
        self.digest, self.text, self.n, self.best, self.tags = digest, text, 0, None, array("q")

    def add(self, n: int, best: tuple, tag: int) -> None:
        self.n += n
        self.best = best if self.best is None else min(self.best, best)
        self.tags.append(tag)


class OpenTable:
    """Open addressing with linear probing; a hit needs equal digest and equal content."""

    def __init__(self) -> None:
        self.slots: list[Group | None] = [None] * 1024
        self.used, self.bytes = 0, 0

    def find(self, digest: bytes, text: bytes) -> tuple[int, Group | None]:
        mask = len(self.slots) - 1
        i = int.from_bytes(digest[24:], "little") & mask
        while (g := self.slots[i]) is not None:
            if g.digest == digest and g.text == text:
                return i, g
            i = (i + 1) & mask
        return i, None

    def put(self, i: int, g: Group) -> None:
        self.slots[i] = g
        self.used += 1
        self.bytes += len(g.text) + 200
        if self.used * 2 > len(self.slots):
            old, self.slots = self.slots, [None] * (2 * len(self.slots))
            for x in old:
                if x is not None:
                    self.slots[self.find(x.digest, x.text)[0]] = x

    def groups(self) -> Iterator[Group]:
        return (g for g in self.slots if g is not None)


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD_BYTES):
            digest, n, cp, doc, row, isnull, size, tag = struct.unpack(_HEAD, head)
            yield digest, f.read(size), n, (cp, isnull, doc, row), tag


def grace(records: Iterable[tuple], table_bytes: int = TABLE_BYTES, depth: int = 0, folder: str | None = None) -> Iterator[Group]:
    """Groups of ``(digest, text, n, best, tag)`` records with equal content.

    Records that meet their content in the table join it at once.  When the table
    is full, new contents go to ``FANOUT`` spill files by the next digit of their
    digest, and each file is handled the same way.
    """
    table, files = OpenTable(), {}
    with tempfile.TemporaryDirectory(prefix="grace-", dir=folder) as tmp:
        for digest, text, n, best, tag in records:
            i, g = table.find(digest, text)
            if g is None:
                if table.bytes > table_bytes and depth < 32:
                    b = digest[depth] % FANOUT
                    if b not in files:
                        files[b] = open(os.path.join(tmp, str(b)), "wb")
                    cp, isnull, doc, row = best
                    files[b].write(struct.pack(_HEAD, digest, n, cp, doc, row, isnull, len(text), tag) + text)
                    continue
                g = Group(digest, text)
                table.put(i, g)
            g.add(n, best, tag)
        for f in files.values():
            f.close()
        yield from table.groups()
        del table
        for b in sorted(files):
            path = os.path.join(tmp, str(b))
            yield from grace(_read(path), table_bytes, depth + 1, tmp)
            os.remove(path)


def _emit(rows: Iterable[tuple], schema: pa.Schema, weigh: int | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; ``weigh`` is the index of a bytes field whose size bounds a batch."""
    buf, size = [], 0
    for r in rows:
        buf.append(r)
        size += 64 + (len(r[weigh] or b"") if weigh is not None else 0)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*buf, strict=True), schema, strict=True)], schema=schema)
            buf, size = [], 0
    if buf:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*buf, strict=True), schema, strict=True)], schema=schema)


_LOCAL = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("rep", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("n", pa.int64()), ("cp", pa.int64())])
_MERGED = pa.schema([("rep", pa.int64()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _local(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ids = row_numbers(), []

        def records() -> Iterator[tuple]:
            for b in batches:
                points = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
                for doc, text, cp in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), points, strict=True):
                    body = (text.as_py() or b"").translate(None, WS)
                    at = len(ids)
                    ids.append(doc)
                    yield hashlib.sha256(body).digest(), body, 1, (-cp, doc is None, doc or 0, base + at), at

        def rows() -> Iterator[tuple]:
            for g in grace(records(), table_bytes):
                cp, _, _, rep = g.best
                sha = g.digest.hex()
                for at in g.tags:
                    mine = base + at == rep
                    yield (ids[at], base + at, rep, sha, g.text if mine else None, g.n if mine else None, -cp if mine else None)

        yield from _emit(rows(), _LOCAL, 4)

    return run


def _merge(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                for doc, rep, sha, body, n, cp in zip(*(b.column(i) for i in range(6)), strict=True):
                    doc, rep = doc.as_py(), rep.as_py()
                    yield bytes.fromhex(sha.as_py()), body.as_py(), n.as_py(), (-cp.as_py(), doc is None, doc or 0, rep), rep

        def rows() -> Iterator[tuple]:
            for g in grace(records(), table_bytes):
                _, isnull, doc, row = g.best
                for rep in g.tags:
                    yield rep, row, None if isnull else doc, g.n

        yield from _emit(rows(), _MERGED)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every character of
    ``[\\x20\\x09-\\x0D]``; null counts as empty, and all empty texts are one group.
    Of a group the row with the most code points stays, then the smallest doc_id
    (null last), then the first row read; exactly one row of a group has ``kept``,
    also when rows repeat in full.  ``keep_id`` is null only if the row that stays
    has a null doc_id.  An empty table gives an empty result; other columns are
    not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = src.mapInArrow(_local(table_bytes), "doc_id long, row long, rep long, sha string, body binary, n long, cp long")
    local = materialize(local, "exact-local")
    reps = local.where("body is not null").select("doc_id", "rep", "sha", "body", "n", "cp").repartition("sha")
    merged = reps.mapInArrow(_merge(table_bytes), "rep long, keep_row long, keep_id long, group_size long")
    return (
        local.select("doc_id", "row", "rep", "sha")
        .join(merged, "rep")
        .select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )
