"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer.

1. Overlapping heuristics vote good, bad or abstain on each document; votes of all
   documents are counted by pattern (at most 3^labellers patterns).
2. Expectation-maximisation on these counts estimates the share of good documents and
   how often each labeller votes what on good and on bad ones; each pattern gets a
   posterior.
3. Posteriors of a bounded sample of distinct texts train a logistic scorer on hashed
   character-class n-grams, which judges every document, also those no heuristic knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.textops import STEP, Words, mix, row_sums, shingles, slices

BUCKETS = 4096
#: distinct texts whose posterior labels train the scorer, never more, those of the least hashes
SAMPLE_ROWS = 4000
THRESHOLD = 0.5
LABELLERS = 7
GOOD, BAD, ABSTAIN = 1, 0, 2

# byte classes: 0 other, 1 space, 2 lower, 3 upper, 4 digit, 5 non-ASCII letter bytes, 6.. punctuation, 15 line end
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9, 11, 12]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 5
for _c, _chars in enumerate((b".", b",;:", b"!", b"?", b"#*", b"$%&", b"|", b"'\"()-", b"_/\\<>[]{}=+~^`@"), 6):
    _CLASS[list(_chars)] = _c
_CLASS[[10, 13]] = 15
_SYMBOL = np.isin(np.arange(16), (10, 11, 12, 14))
_LETTER = np.isin(np.arange(16), (2, 3, 5))
_WORD_END = np.isin(np.arange(16), (2, 3, 5, 6, 7, 8, 9, 13))


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(known & bad, BAD, np.where(known & good, GOOD, ABSTAIN))


def _same_as_before(words: Words) -> np.ndarray:
    """Words equal to the word before them in their row."""
    h, same = words.hashes(), np.zeros(len(words.start), bool)
    same[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    return same


def votes(words: Words) -> np.ndarray:
    """Votes of the labellers on each row, one column each."""
    cls, rows = _CLASS[words.data], words.rows

    def total(flag: np.ndarray) -> np.ndarray:
        return row_sums(flag, words.off).astype(np.float64)

    n = words.count.astype(np.float64)
    some = np.maximum(n, 1)
    dense = np.maximum(total((cls != 1) & (cls != 15)), 1)
    lower, upper = total(cls == 2), total(cls == 3)
    symbols = total(_SYMBOL[cls]) / dense
    shouting = upper / np.maximum(lower + upper, 1)
    plain = np.zeros(0, bool)
    if len(words.start):
        bounds = np.stack([words.start, words.end - 1], axis=1).ravel()
        inner = np.logical_or.reduceat(~_LETTER[cls], bounds)[::2] & (words.end - words.start > 1)
        plain = ~inner & _WORD_END[cls[words.end - 1]]
    plain_share = np.bincount(words.row, weights=plain, minlength=rows) / some
    sh, row, _ = shingles(words, 5, short=False)
    order = np.lexsort((sh, row))
    again = np.zeros(len(sh), bool)
    again[1:] = (sh[order][1:] == sh[order][:-1]) & (row[order][1:] == row[order][:-1])
    grams = np.bincount(row, minlength=rows)
    repeated = np.bincount(row[order], weights=again, minlength=rows) / np.maximum(grams, 1)
    ends = np.isin(cls[words.end - 1], (6, 9)) if len(words.start) else plain
    sentence = np.bincount(words.row, weights=ends, minlength=rows) / some
    length = dense / some
    stutter = np.bincount(words.row, weights=_same_as_before(words), minlength=rows) / some
    doubled = np.zeros(len(cls), bool)
    doubled[1:] = (words.data[1:] == words.data[:-1]) & np.isin(cls[1:], (8, 10, 11, 12, 14))
    double = total(doubled) / some
    return np.stack(
        [
            _vote(symbols, symbols < 0.005, symbols > 0.03, n >= 3),
            _vote(shouting, shouting < 0.15, shouting > 0.4, lower + upper >= 15),
            _vote(plain_share, plain_share > 0.9, plain_share < 0.7, n >= 5),
            _vote(repeated, repeated < 0.05, repeated > 0.3, grams >= 20),
            _vote(sentence, sentence > 0.02, sentence < 0.008, n >= 40),
            _vote(double, (double < 0.01) & (length < 15), double > 0.1, n >= 3),
            _vote(stutter, stutter < 0.05, stutter > 0.2, n >= 10),
        ],
        axis=1,
    )


def features(words: Words, buckets: int) -> np.ndarray:
    """Square roots of the frequencies of hashed items, one row each.

    The items are class 4-grams of the text and, per word, its first and last class,
    its length and whether it repeats the word before.
    """
    kinds, off, rows = _CLASS[words.data], words.off, words.rows
    shape, out = (rows, buckets), np.zeros((rows, buckets), np.float32)

    def add(count: np.ndarray, least: int) -> None:
        f = count.reshape(shape).astype(np.float32)
        np.add(out, f / (f.sum(1, keepdims=True) + least), out=out)  # a few words are little evidence either way

    of_code = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)
    count = np.zeros(rows * buckets, np.int64)
    for lo in range(0, len(kinds) - 3, STEP):
        part = kinds[lo : lo + STEP + 3].astype(np.int64)
        n = len(part) - 3
        code = (part[:n] << 12) | (part[1 : n + 1] << 8) | (part[2 : n + 2] << 4) | part[3:]
        at = np.arange(lo, lo + n)
        row = np.searchsorted(off[1:], at, side="right")
        inside = at + 4 <= off[1:][row]
        low, high = int(row[0]), int(row[-1]) + 1
        count[low * buckets : high * buckets] += np.bincount((row[inside] - low) * buckets + of_code[code[inside]], minlength=(high - low) * buckets)
    add(count, 64)
    length = np.minimum(words.end - words.start, 15).astype(np.uint64)
    ends = (kinds[words.start].astype(np.uint64) << np.uint64(8)) | (kinds[words.end - 1].astype(np.uint64) << np.uint64(4))
    word = (_same_as_before(words).astype(np.uint64) << np.uint64(20)) | ends | length
    bucket = (mix(word | np.uint64(1 << 21)) % np.uint64(buckets)).astype(np.int64)
    add(np.bincount(words.row * buckets + bucket, minlength=rows * buckets), 12)
    return np.sqrt(out)


def pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int = LABELLERS, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, vote probabilities [class, labeller, vote], share of good).

    Labellers are taken as independent given the class and an abstention says nothing;
    the start is the majority vote, which also fixes which class is the good one.
    """
    v = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
    n = counts.astype(np.float64)
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    post = np.clip((good + 0.5) / (good + bad + 1), 0.05, 0.95)
    hot = np.stack([v == x for x in (BAD, GOOD)], axis=2).astype(np.float64)
    probs, share = np.zeros((2, labellers, 2)), 0.5
    for _ in range(rounds):
        old = post
        for c, w in ((BAD, n * (1 - post)), (GOOD, n * post)):
            cast = np.einsum("p,plx->lx", w, hot) + 1
            probs[c] = cast / cast.sum(1, keepdims=True)
        share = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
        ll = np.stack([np.einsum("plx,lx->p", hot, np.log(probs[c])) for c in (BAD, GOOD)])
        odds = ll[GOOD] - ll[BAD] + np.log(share / (1 - share))
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(post - old).max() < 1e-9:
            break
    return post, probs, share


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent, with the step that the loss's curvature allows."""
    steep = float(np.einsum("ij,ij->i", x, x).max()) + 1 if len(x) else 1.0
    rate = 1 / (steep / 4 + ridge)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    weight = np.float32(1 / max(1, len(y)))
    vw, vb, mw, mb = w.copy(), b, w.copy(), b
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30)))
        g = weight * (p - y)
        mw, mb, ow, ob = vw - rate * (x.T @ g + ridge * vw), vb - rate * float(g.sum()), mw, mb
        vw, vb = mw + i / (i + 3) * (mw - ow), mb + i / (i + 3) * (mb - ob)
    return mw, float(mb)


class Scorer:
    """Everything a task needs to judge a text."""

    def __init__(self, patterns: np.ndarray, post: np.ndarray, weights: np.ndarray, bias: float, accuracies: np.ndarray):
        self.state = (patterns, post, weights, bias, accuracies)
        self.post = dict(zip(patterns.tolist(), post.tolist(), strict=True))
        self.weights, self.bias, self.accuracies = weights, bias, accuracies


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> Scorer | None:
    """Scorer from the votes on all rows and a bounded sample of texts; None for a table without words.

    The sample is the ``sample_rows`` texts of the least 64-bit hashes, each once however often it
    is repeated; only rows below a hash bound that lets twice as many rows through are prepared.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = Words(b.column("text"))
                p, n = np.unique(pattern(votes(w))[w.count > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], names=["p", "n"])

    counted = texts.select("text").mapInArrow(patterns, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()
    if not counted:
        return None
    p, n = np.array([r["p"] for r in counted]), np.array([r["n"] for r in counted])
    post, probs, _ = expectation_maximisation(p, n)
    known = dict(zip(p.tolist(), post.tolist(), strict=True))
    bound = min((2 * sample_rows << 64) // int(n.sum()), 1 << 64) - 1 - (1 << 63)
    part = texts.select(F.xxhash64(F.lit(2), "text").alias("h"), "text").where(F.col("h") <= F.lit(bound))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20, 256):
                b = b.take(pa.array(np.unique(b.column("h").to_numpy(), return_index=True)[1]))
                w = Words(b.column("text"))
                x, q = features(w, buckets).astype(np.float16), pattern(votes(w))
                ok = np.flatnonzero(w.count > 0)
                yield pa.RecordBatch.from_arrays([b.column("h").take(pa.array(ok)), pa.array(q[ok]), pa.array([x[i].tobytes() for i in ok], pa.binary())], names=["h", "p", "x"])

    once = part.mapInArrow(sampled, "h long, p long, x binary").groupBy("h").agg(F.min("p").alias("p"), F.first("x").alias("x"))
    rows = once.orderBy("h").limit(sample_rows).collect()
    if not rows:
        return Scorer(p, post, np.zeros(buckets, np.float32), 0.0, probs)
    x = np.empty((len(rows), buckets), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r["x"], np.float16)
    y = np.array([known.get(r["p"], 0.5) for r in rows], np.float32)
    del rows
    return Scorer(p, post, *fit_scorer(x, y), probs)


def _judge(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*shared.value)
        for batch in batches:
            for b in slices(batch, text, 1 << 20, 256):
                w = Words(b.column(text))
                z = features(w, len(s.weights)) @ s.weights + s.bias
                score = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
                post = np.array([s.post.get(q, 0.5) for q in pattern(votes(w)).tolist()])
                score[w.count == 0], post[w.count == 0] = 0.0, 0.0
                keep = [c for c in b.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(post), pa.array(score)], names=[*keep, "weak_label", "quality_score"])

    return run


def score_quality(docs: DataFrame, columns: list[str], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The named columns of every row with weak_label and quality_score (both 0 to 1, 1 is good).

    A null text, or one without a word, scores 0.  A table without any word scores 0
    everywhere; an empty table gives an empty result.  Repeated rows get equal scores.
    ``weak_label`` and ``quality_score`` replace input columns of these names.
    """
    columns = [c for c in columns if c not in ("weak_label", "quality_score")]
    scorer = train(docs, text_col, sample_rows)
    own = "_text"
    while own in columns:
        own += "_"
    src = docs.select(*columns, F.col(text_col).cast("string").alias(own))
    if scorer is None:
        return src.select(*columns, F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("quality_score"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer.state)  # one weight per bucket, one posterior per pattern
    schema = src.drop(own).schema.add("weak_label", "double").add("quality_score", "double")
    return src.mapInArrow(_judge(shared, own), schema)
