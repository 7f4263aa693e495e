"""Language identification with bit-sliced Bloom filters over byte n-grams.

One array of language bitmasks serves all languages: a lookup ANDs the masks at the
hash positions of an n-gram and so returns every language whose filter has it.  A
document's per-language popcounts, corrected for the filters' false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.textops import STEP, flat, mix, multipliers, slices
from lexiflow.sources.tables import materialize

N = 5
HASHES = 3
SLOT_BITS = 20
#: labelled rows of each language the filters are learned from, at most about so many, chosen by hash
SAMPLE_ROWS = 20_000
#: an n-gram counts for a language if it occurs once per so many learned rows of it, but at least once and at most
#: MIN_COUNT times, so that languages of a few short texts are learned too
ROWS_PER_COUNT, MIN_COUNT = 250, 4
#: an n-gram belongs to the languages whose rate is at least this share of the highest rate
RATE_SHARE = 0.3
#: languages of a mask word; a table has as many words a slot as its languages need
WORD = 64

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def padded(text: Column) -> Column:
    pad = F.lit(" " * (N // 2))
    return F.concat(pad, F.lower(F.coalesce(text.cast("string"), F.lit(""))), pad)


def ngrams(arr: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram as a number, row) of the window around every letter byte, ``STEP`` bytes at a time; other bytes count as spaces."""
    data, off = flat(arr)
    data = _LETTER[data]
    mid = N // 2
    for lo in range(0, len(data), STEP):
        at = lo + np.flatnonzero(data[lo : lo + STEP] != 32)  # rows are padded, so no window leaves its row
        code = np.zeros(len(at), np.uint64)
        for j in range(N):
            code = (code << np.uint64(8)) | data[at + (j - mid)].astype(np.uint64)
        yield code, np.searchsorted(off[1:], at, side="right")


def positions(code: np.ndarray, slot_bits: int) -> Iterator[np.ndarray]:
    for m in multipliers(HASHES, 31):
        yield (mix(code * m) >> np.uint64(64 - slot_bits)).astype(np.int64)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


class Filters:
    """Languages in order, their bitmask table (slots x words) and the false-positive rate of each filter."""

    def __init__(self, languages: list[str], table: np.ndarray, prior: int):
        self.languages, self.table, self.prior = languages, table, prior
        self.state = {"languages": languages, "table": table, "prior": prior}
        fill = np.array([((table[:, i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = np.minimum(fill**HASHES, 0.99)


def least_count(rows: int, sample_rows: int) -> int:
    """Occurrences an n-gram needs in a language of ``rows`` rows."""
    return min(max(min(rows, sample_rows) // ROWS_PER_COUNT, 1), MIN_COUNT)


def limit(sample_rows: int, rows: int) -> int:
    """The 64-bit hash up to which about ``sample_rows`` of ``rows`` rows lie; the highest if there are no more."""
    return min(max((sample_rows << 64) // rows, 1), 1 << 64) - 1 - (1 << 63)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, slot_bits: int = SLOT_BITS) -> Filters | None:
    """Filters from the text of rows with a language that are not held out; None if there is no such row.

    Each language gives about ``sample_rows`` rows, or all if it has no more, so what is
    learned of one doesn't depend on the others' sizes; rows are read in whole.  What reaches
    the driver is one table of 2^slot_bits masks for every 64 languages and one count per language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    words = -(-len(languages) // WORD)
    part = known.select(F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int").alias("lang"), "id", "text")
    limits = F.array(*[F.lit(limit(sample_rows, sizes[x])).cast("long") for x in languages])
    part = part.where(F.xxhash64(F.lit(8), "id", "text") <= F.element_at(limits, F.col("lang"))).select("lang", padded(F.col("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                of_row = b.column("lang").to_numpy(zero_copy_only=False)
                for code, row in ngrams(b.column("text")):
                    lang = of_row[row]
                    for x in np.unique(lang):
                        g, n = np.unique(code[lang == x], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), x - 1, np.int32)), pa.array(n.astype(np.int64))], names=["g", "lang", "n"])

    counts = part.mapInArrow(count, "g long, lang int, n long").groupBy("g", "lang").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "lang-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.element_at(F.array(*[F.lit(float(totals.get(i, 0) or 1)) for i in range(len(languages))]), F.col("lang") + 1)
    least = F.element_at(F.array(*[F.lit(least_count(sizes[x], sample_rows)) for x in languages]), F.col("lang") + 1)
    rated = counts.where(F.col("n") >= least).groupBy("g").agg(F.collect_list(F.struct("lang", (F.col("n") / total).alias("rate"))).alias("v"))
    top = F.array_max(F.transform("v", lambda x: x["rate"]))
    kept = F.filter("v", lambda x: x["rate"] >= top * RATE_SHARE)
    bits = lambda w: F.aggregate(F.filter(kept, lambda x: F.floor(x["lang"] / WORD) == w), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["lang"] % WORD)))
    masks = rated.select("g", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), bits)).alias("word", "mask")).where("mask <> 0")
    ranges = 64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, m, word = b.column("g").to_numpy().view(np.uint64), b.column("mask").to_numpy(), b.column("word").to_numpy()
            slot = np.concatenate(list(positions(code, slot_bits)))
            yield pa.RecordBatch.from_arrays([pa.array(slot % ranges), pa.array(np.tile(word, HASHES)), pa.array(slot), pa.array(np.tile(m, HASHES))], names=["part", "word", "slot", "mask"])

    slots = masks.mapInArrow(place, "part long, word int, slot long, mask long").groupBy("part", "word", "slot").agg(F.bit_or("mask").alias("mask"))

    def pack(pdf):  # one row per word and range of slots: at most 2^slot_bits / ranges masks
        import pandas as pd

        m = np.zeros((1 << slot_bits) // ranges, np.int64)
        m[pdf["slot"].to_numpy() // ranges] = pdf["mask"].to_numpy()
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "word": [pdf["word"].iloc[0]], "masks": [m.tobytes()]})

    table = np.zeros((1 << slot_bits, words), np.uint64)
    for r in slots.groupBy("part", "word").applyInPandas(pack, "part long, word int, masks binary").toLocalIterator():
        table[r["part"] :: ranges, r["word"]] = np.frombuffer(r["masks"], np.uint64)
    return Filters(languages, table, max(range(len(languages)), key=lambda i: sizes[languages[i]]))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(**shared.value)
        width = np.uint8 if len(f.languages) <= 8 else np.uint64
        table = [np.ascontiguousarray(w) for w in f.table.T.astype(width)]
        for batch in batches:
            for b in slices(batch, "text"):
                n = len(b)
                seen, hits = np.zeros(n, np.int64), np.zeros((n, len(f.languages)))
                for code, row in ngrams(b.column("text")):
                    slots = list(positions(code, len(f.table).bit_length() - 1))
                    seen += np.bincount(row, minlength=n)
                    for i in range(len(f.languages)):
                        if i % WORD == 0:
                            hit = np.full(len(code), np.iinfo(width).max, width)
                            for slot in slots:
                                hit &= table[i // WORD][slot]
                        hits[:, i] += np.bincount(row, weights=(hit >> width(i % WORD)) & width(1), minlength=n)
                rate = hits / np.maximum(seen, 1)[:, None]
                rate = np.clip((rate - f.false) / (1 - f.false), 0, 1)
                best, total = rate.argmax(1), rate.sum(1)
                best[total == 0] = f.prior
                score = np.where(total > 0, rate.max(1) / np.where(total > 0, total, 1), 0.0)
                lang = np.array(f.languages, dtype=object)[best]
                letters = b.column("has_letter").to_numpy(zero_copy_only=False)
                lang[~letters], score[~letters] = "und", 0.0
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Predictions depend on the text alone.  ``und`` (score 0) if the text is null or has
    no letter, or if no row has a language to learn from; a text none of whose n-grams
    is known gets the commonest language with score 0.  ``score`` is the winner's share
    of all corrected popcounts; ties go to the first language by code point.  Every
    language is learned, from about ``sample_rows`` rows at most.  An empty table gives an empty result.
    """
    filters = learn(docs, id_col, text_col, lang_col, sample_rows)
    src = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), padded(F.col(text_col)).alias("text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
    )
    if filters is None:
        return src.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(filters.state)  # 2^slot_bits masks for every 64 languages, whatever the rows
    return src.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")
