"""Packing token sequences: best-fit decreasing over a segment tree of remaining capacities.

1. Tasks over the input tokenise whole texts and cut them: every full window is a
   piece of its own, the rest of the document is one piece.  Only bounds, length
   and checksum of each piece are written.
2. Pieces are dealt evenly to groups of about ``group_pieces`` by a hash of the
   piece, whatever the number of documents, so the packing of a group is a small
   task and its last open windows cost little padding.
3. A group is packed longest piece first, each into the tightest open window; a
   segment tree over capacities 0..window finds that window in log(window) steps.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.textops import row_numbers
from lexiflow.sources.tables import materialize

WINDOW = 4096
END_ID = 2
GROUP_PIECES = 2000
#: distinct parts and words remembered by a Python worker, none above KEPT_CHARS characters, so that the memory is
#: bounded in bytes too; it changes no result
PARTS, WORDS, KEPT_CHARS = 200_000, 60_000, 64
#: texts on which a tokenizer must give the ids that :class:`WordIds` puts together, or whole texts are encoded by it
PROBES = (
    "The quick Brown fox, it's 42 days old; don't SHOUT!  Two  spaces\nand a line\tand a tab",
    " leading and trailing ", "l'été où ÇA naïve straße ñandú İstanbul ǅ", "x=1.5e-3 (a_b) [c] {d} <e> #f $g %h &i *j |k ~l `m` @n ^o \\p",
    "他们在北京工作。", "приве́т мир", "नमस्ते दुनिया", "🙂👍🏽 e\u0301 \u00a0 \u2028 \u3000 \x1c \x85 \u200b", "<|endoftext|> a<|x|>b", "'s 'T we'll I'VE",
)


#: letters whose lower case the tokenizer may see otherwise
_FOREIGN = re.compile("[İɐ-\U0010FFFF]").search
#: a mark that ends a run of marks, which must stay whole
_RUN = re.compile(r"[.,] (?<=[^\w\s][.,] |_[.,] )").search


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) of strings without white space, computed once each.

    The tokenizer lower-cases, drops white space and never merges across it, so the
    ids of a text are those of its space-separated parts in a row.  Parts of plain
    Latin letters are split by the tokenizer's own pattern and each word goes to its
    BPE model; all other parts go through the whole tokenizer.  That holds for
    tokenizers of this kind only.  So a text is lower-cased at once and its commas and full
    stops are parts of their own, which leaves fewer different parts.  ``composed`` is false if the ids put together for
    any of ``PROBES`` differ from the tokenizer's own, and then every text goes
    through the whole tokenizer at once.
    """

    def __init__(self, path: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        hidden = iter(range(256, 512))
        self.alphabet = "".join(shown.get(b) or chr(next(hidden)) for b in range(256))
        self.words: dict[str, bytes] = {}
        self.composed = True
        self.composed = all(self.ids(x) == self.encoded(x) for x in PROBES)

    def encoded(self, text: str) -> bytes:
        return _packed(self.tok.encode(text, add_special_tokens=False).ids)

    def merged(self, w: str) -> bytes:
        chars = w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(self.alphabet)
        return _packed([t.id for t in self.model.tokenize(chars)])

    def word(self, w: str) -> bytes:
        if (ids := self.words.get(w)) is None:
            ids = self.merged(w)
            if len(w) <= KEPT_CHARS:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[w] = ids
        return ids

    def __missing__(self, part: str) -> bytes:
        if not part:
            return b""
        if (part.isascii() or not _FOREIGN(part)) and "<|" not in part:
            if part.isalpha():
                ids = self.merged(part.lower())
            elif part[-1] in ",.;:!?" and part[:-1].isalpha():
                ids = self.word(part[:-1].lower()) + self.word(part[-1])
            else:
                ids = b"".join(map(self.word, self.find(part.lower())))
        else:
            ids = self.encoded(part)
        if len(part) <= KEPT_CHARS:
            if len(self) >= PARTS:
                self.clear()
            self[part] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not self.composed:
            return self.encoded(text or "")
        plain = (text or "").replace("\n", " ")
        if "<|" not in plain and (plain.isascii() or not _FOREIGN(plain)):
            plain = plain.lower()
        if not _RUN(plain):
            plain = plain.replace(", ", " , ").replace(". ", " . ")
        return b"".join(map(self.__getitem__, plain.split(" ")))


def _shared_words(path: str) -> WordIds:
    """The worker's word ids: a Python worker runs many tasks and keeps what it has looked up."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_lexiflow_words", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def _pieces(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row, tail = _shared_words(path), row_numbers(), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = memoryview(words.ids(text.as_py()) + tail)
                n = len(ids) // 4
                for s in range(0, n, window):
                    part = ids[4 * s : 4 * (s + window)]
                    out.append((doc.as_py(), row, s, len(part) // 4, zlib.crc32(part), n))
                row += 1
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Capacities:
    """Segment tree over remaining capacities: how many windows are open at each."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window_no: int) -> None:
        self.open.setdefault(capacity, []).append(window_no)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least capacity of at least ``need``, removed."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i ^ 1]):  # climb until a right sibling has windows
                i >>= 1
            if i <= 1:
                return None
            i ^= 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece (1..window long)."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, windows = Capacities(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n) if n < window else None
        if found is None:
            found, windows = (window, windows), windows + 1
        capacity, w = found
        place[i], offset[i] = w, window - capacity
        if capacity > n:
            tree.add(capacity - n, w)
    return place, offset


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone.  Repeated rows and null ids are
    documents of their own.  An empty table gives an empty result; other columns are
    not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(src.mapInArrow(_pieces(tokenizer, window, end_id), schema), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "row", "start"], ascending=[False, True, True], kind="stable")
        place, offset = best_fit_decreasing(part["length"].to_numpy(), window)
        part["sequence_id"] = place + (part["grp"].to_numpy() << 32)
        part["offset"] = offset
        return part.drop(columns=["grp", "row"])

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
