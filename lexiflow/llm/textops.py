"""Vectorised word handling of Arrow string batches (numpy, inside tasks).

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  Its 64-bit hash is a
polynomial of its UTF-8 bytes, finished by a mixer; shingles combine the hashes
of ``k`` words in a row.  All of it works on whole texts: a batch is only cut
between documents, and what is computed per byte is computed ``STEP`` bytes at a
time, also inside one long text, so that the working arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WS = b" \t\n\x0b\x0c\r"
IS_WS = np.zeros(256, dtype=bool)
IS_WS[list(WS)] = True

#: bytes that are worked on at a time
STEP = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS = np.array([1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants made from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        m = np.full(max(n, 64), np.uint64(_BASE), dtype=np.uint64)
        m[0] = 1
        _POWERS = np.multiply.accumulate(m)
    return _POWERS


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and row offsets; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    _, off, data = arr.buffers()
    o = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that each part holds about ``max_bytes`` of text and at most ``max_rows`` rows."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n) // max_bytes
    cuts = sorted({0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), *range(0, len(n), max_rows), len(n)})
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """Words of the rows of one string array: byte bounds, row number and hash of each word."""

    def __init__(self, arr: pa.Array):
        data, off = flat(arr)
        self.data, self.off, self.rows = data, off, len(off) - 1
        n = len(data)
        ws = IS_WS[data]
        edge = np.empty(n + 1, dtype=bool)
        edge[0] = True
        edge[1:] = ws
        edge[off[:-1]] = True
        first = ~ws & edge[:n]
        edge[:n] = ws
        edge[n] = True
        edge[off[1:]] = True
        last = ~ws & edge[1:]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(off[1:], self.start, side="right")
        #: first word of each row, and one past the last row's last word
        self.bounds = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.count = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        length = self.end - self.start
        out, to, a = np.empty(len(length), np.uint64), np.cumsum(length), 0
        while a < len(length):
            b = int(np.searchsorted(to, (to[a - 1] if a else 0) + STEP, side="right"))
            if b > a:
                out[a:b] = self._sums(self.start[a:b], length[a:b])
            else:  # one word of more than STEP bytes
                b, out[a] = a + 1, self._long(int(self.start[a]), int(self.end[a]))
            a = b
        return mix(out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _sums(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        first = np.concatenate(([0], np.cumsum(length)))
        pos = np.arange(first[-1]) - np.repeat(first[:-1], length)
        byte = self.data[pos + np.repeat(start, length)].astype(np.uint64) + np.uint64(1)
        byte *= _powers(int(length.max()))[pos]
        return np.add.reduceat(byte, first[:-1])

    def _long(self, start: int, end: int) -> np.uint64:
        total = 0
        for lo in range(start, end, STEP):
            piece = self._sums(np.array([lo]), np.array([min(end - lo, STEP)]))
            total += int(piece[0]) * pow(_BASE, lo - start, _MASK + 1)
        return np.uint64(total & _MASK)


def row_sums(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each row have the flag; ``off`` are the rows' byte bounds."""
    out = np.zeros(len(off) - 1, np.int64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(flag, off[full], dtype=np.int64)
    return out


def shingles(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every run of ``k`` words inside a row.

    With ``short`` a row of 1 to k-1 words has one shingle made of all its words.
    """
    h, row = words.hashes(), words.row
    mult = multipliers(k, 77)
    n = len(h) - k + 1
    if n > 0:
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s += h[j : j + n] * mult[j]
        ok = row[:n] == row[k - 1 :]
        at = np.flatnonzero(ok)
        s, r = mix(s[at]), row[at]
    else:
        s, r, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short:
        few = np.flatnonzero((words.count > 0) & (words.count < k))
        if len(few):
            f = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                has = words.count[few] > j
                f[has] += h[words.bounds[few[has]] + j] * mult[j]
            f = mix(f + words.count[few].astype(np.uint64))
            s, r, at = np.concatenate((s, f)), np.concatenate((r, few)), np.concatenate((at, words.bounds[few]))
            order = np.argsort(r, kind="stable")
            s, r, at = s[order], r[order], at[order]
    return s, r, at


def row_numbers() -> int:
    """First row number of this task: numbers of different tasks never meet."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return (ctx.partitionId() if ctx else 0) << 40
