"""Phrase collocations mined with weighted acyclic automata.

1. Each stretch of texts is a shard: its n-grams of one to three words, sorted, become a
   count transducer (an acyclic automaton whose arcs carry counts; the first arc is the
   language).  It is built prefix by prefix: once the sorted n-grams leave a prefix, its state
   is final and is looked up in a register, so equal states are stored once.
2. Prefixes (language and one or two words) are ordered by a fingerprint of their words.  A
   transducer is cut into ranges of that order, each range is shuffled to one group, and the
   union of its transducers sums the weights of equal paths.  Ranges hold a bounded number of
   bytes of text; a frequent first word is spread by the second.  With very many ranges the
   cut is made in two steps, so that no shard is torn into single n-grams.
3. Paths of too small a weight are pruned (a phrase is never more frequent than its parts), and
   the counts of a phrase's parts are looked up by composing the parts, in sorted order, with
   the transducer of the range they belong to.  Parts that make up more than a fixed share of
   all words, at most ``2 * HEAVY`` by that share, are broadcast instead, so no range is hot.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.textops import mix, slices
from lexiflow.sources.tables import materialize

MIN_COUNT = 10
TOP = 2000
#: a phrase goes if a longer one has this share of its occurrences, in percent
SHARE = 50
#: text of a shard, and of one prefix range
SHARD_BYTES = 3 << 20
RANGE_BYTES = 4 << 20
#: ranges that a transducer is cut into at once
FANOUT = 1024
#: parts with at least 1 / HEAVY of all words are broadcast
HEAVY = 100_000

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _fold() -> bytes:
    """Lower-case A-Z; ends of pieces become line feeds, tabs spaces."""
    table = bytearray(range(256))
    for c in range(0x41, 0x5B):
        table[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = 10
    table[9] = 32
    return bytes(table)


FOLD = _fold()


def _sums(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of counts of each, and the place of every key among them."""
    if not len(key):
        return key, count, np.zeros(0, np.int64)
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return k[at], np.add.reduceat(count[order], at), place


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the runs ``start, start + 1, ...`` of the given lengths."""
    first = np.concatenate(([0], np.cumsum(length)))
    return np.arange(first[-1]) + np.repeat(start - first[:-1], length)


def _binary(data: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in order of their bytes, and the number of each word."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def _least(a: np.ndarray) -> np.ndarray:
    """The same values in the smallest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


class Transducer:
    """Counts of paths language, word (``u``), word (``p``), word (``a``).

    ``u`` has columns lang, word, count; ``p`` lang, word, word, count; ``a`` pair (a row of
    ``p``), word, count.  Words are numbers of ``words``, which is sorted, and so are the rows.
    """

    def __init__(self, langs: list[str], words: pa.Array, u: tuple, p: tuple, a: tuple):
        """Sum the weights of equal paths; ``p`` and ``a`` may repeat, ``a`` names rows of ``p`` as given."""
        self.langs, self.words = langs, words
        v = max(1, len(words))
        key, n, _ = _sums(u[0] * v + u[1], u[2])
        self.u = (key // v, key % v, n)
        first, _, place = _sums(p[0] * v + p[1], p[3])
        key, n, pair = _sums(place * v + p[2], p[3])
        first = first[key // v] if len(key) else first
        self.p = (first // v, first % v, key % v, n)
        key, n, _ = _sums(pair[a[0]] * v + a[1], a[2])
        self.a = (key // v, key % v, n)
        self._hash: np.ndarray | None = None

    # -- prefixes and their ranges

    def _fingerprints(self, lang: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        if self._hash is None:
            self._hash = np.array([zlib.crc32(w) for w in self.words.to_pylist()], np.uint64)
        tongue = np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64)
        h = mix(tongue[lang] * _K1 + self._hash[first] + np.uint64(1))
        if second is not None:
            h = mix(h + self._hash[second] * _K2 + np.uint64(2))
        return (h >> np.uint64(32)).astype(np.int64)

    def ranges(self, n: int, lang: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        return (self._fingerprints(lang, first, second) * n) >> 32

    # -- cutting, storing and reading

    def cut(self, n: int, by: int = 1) -> Iterator[tuple[int, bytes]]:
        """(range, stored part) for each of ``n`` ranges that has a path; ``by`` ranges go together."""
        ru = self.ranges(n, self.u[0], self.u[1]) // by
        rp = self.ranges(n, self.p[0], self.p[1], self.p[2]) // by
        ou, op = np.argsort(ru, kind="stable"), np.argsort(rp, kind="stable")
        arcs = np.searchsorted(self.a[0], np.arange(len(rp) + 1))
        here = np.unique(np.concatenate((ru, rp)))
        cu, cp = (np.searchsorted(r[o], np.append(here, n)) for r, o in ((ru, ou), (rp, op)))
        for i, r in enumerate(here.tolist()):
            iu, ip = ou[cu[i] : cu[i + 1]], op[cp[i] : cp[i + 1]]
            yield r, self._store([x[iu] for x in self.u], [x[ip] for x in self.p], arcs[ip], arcs[ip + 1] - arcs[ip])

    def _store(self, u: list, p: list, start: np.ndarray, length: np.ndarray) -> bytes:
        at = _runs(start, length)
        word, count = self.a[1][at], self.a[2][at]
        used = np.unique(np.concatenate((u[1], p[1], p[2], word)))
        arc = np.stack((np.searchsorted(used, word), count), axis=1)
        raw, bounds = arc.tobytes(), (np.concatenate(([0], np.cumsum(length))) * 16).tolist()
        register: dict[bytes, int] = {}
        states, fresh = [], []
        for i, (b, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
            state = register.setdefault(raw[b:e], len(fresh))
            if state == len(fresh):
                fresh.append(i)
            states.append(state)
        fresh = np.array(fresh, np.int64)
        kept = arc[_runs(np.concatenate(([0], np.cumsum(length)))[fresh], length[fresh])]
        names = self.words.take(pa.array(used))
        spell = b"".join(names.to_pylist())
        langs = json.dumps(self.langs).encode()
        columns = [
            np.frombuffer(langs, np.uint8), np.frombuffer(spell, np.uint8), pc.binary_length(names).to_numpy(), u[0], np.searchsorted(used, u[1]), u[2],
            p[0], np.searchsorted(used, p[1]), np.searchsorted(used, p[2]), p[3], np.array(states, np.int64), length[fresh], kept[:, 0], kept[:, 1],
        ]
        columns = [_least(c) for c in columns]
        body = np.array([x for c in columns for x in (len(c), c.itemsize)], "<u4").tobytes() + b"".join(c.tobytes() for c in columns)
        return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)

    @staticmethod
    def _load(blob: bytes) -> list[np.ndarray]:
        body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        head = np.frombuffer(body, "<u4", 28).tolist()
        out, at = [], 28 * 4
        for n, size in zip(head[::2], head[1::2], strict=True):
            out.append(np.frombuffer(body, f"<u{size}", n, at))
            at += n * size
        return out

    @classmethod
    def union(cls, blobs: list[bytes]) -> Transducer:
        """The sum of stored transducers."""
        langs: dict[str, int] = {}
        parts = []
        for blob in blobs:
            c = cls._load(blob)
            names = json.loads(c[0].tobytes())
            parts.append((np.array([langs.setdefault(x, len(langs)) for x in names], np.int64), c))
        spell = np.concatenate([c[1] for _, c in parts])
        words, number = _coded(_binary(spell, np.concatenate([c[2] for _, c in parts]).astype(np.int64)))
        u, p, a, at, pairs = [], [], [], 0, 0
        for tongue, c in parts:
            mine = number[at : at + len(c[2])]
            at += len(c[2])
            u.append((tongue[c[3]], mine[c[4]], c[5].astype(np.int64)))
            p.append((tongue[c[6]], mine[c[7]], mine[c[8]], c[9].astype(np.int64)))
            length = c[11].astype(np.int64)
            state = c[10].astype(np.int64)
            start = np.concatenate(([0], np.cumsum(length)))[state] if len(state) else state
            arcs = _runs(start, length[state] if len(state) else state)
            a.append((np.repeat(np.arange(pairs, pairs + len(state)), length[state] if len(state) else 0), mine[c[12][arcs]], c[13][arcs].astype(np.int64)))
            pairs += len(state)
        return cls(list(langs), words, *(tuple(np.concatenate(x) for x in zip(*rows, strict=True)) for rows in (u, p, a)))

    # -- counts

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``u``, ``p`` and ``a`` whose weight is ``least`` or more."""
        return tuple(np.flatnonzero(x[-1] >= least) for x in (self.u, self.p, self.a))

    def spell(self, *numbers: np.ndarray) -> pa.Array:
        """The phrases of some columns of word numbers."""
        parts = [self.words.take(pa.array(n)) for n in numbers]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if len(parts) > 1 else parts[0]
        return joined.cast(pa.binary()).cast(pa.string())

    def compose(self, langs: pa.Array, parts: pa.Array) -> np.ndarray:
        """Weights of the paths that spell the given parts of one or two words; every part must be a path."""
        v = max(1, len(self.words))
        split = pc.split_pattern(parts.cast(pa.large_binary()), b" ")
        lang = pc.index_in(langs, value_set=pa.array(self.langs, langs.type)).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        word = pc.index_in(pc.list_flatten(split), value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(size)))[:-1]
        out = np.zeros(len(parts), np.int64)
        for k, keys, weights in (
            (1, self.u[0] * v + self.u[1], self.u[2]),
            (2, (self.p[0] * v + self.p[1]) * v + self.p[2], self.p[3]),
        ):
            mine = np.flatnonzero(size == k)
            if not len(mine):
                continue
            want = lang[mine] * v + word[first[mine]]
            if k == 2:
                want = want * v + word[first[mine] + 1]
            at = np.searchsorted(keys, want)
            if not len(keys) or (at >= len(keys)).any() or (keys[at] != want).any():
                raise ValueError("a part of a phrase is in no count transducer")
            out[mine] = weights[at]
        return out


def shard(langs: pa.Array, texts: pa.Array) -> Transducer | None:
    """The count transducer of some texts (null: empty)."""
    bodies = [(t.as_py() or b"").translate(FOLD) for t in texts.cast(pa.binary())]
    size = np.array([len(b) + 1 for b in bodies], np.int64)
    a = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
    blank = (a == 32) | (a == 10)
    edge = np.concatenate(([True], blank))
    start, end = np.flatnonzero(edge[:-1] & ~blank), np.flatnonzero(~edge[1:-1] & blank[1:]) + 1
    if not len(start):
        return None
    words, word = _coded(_binary(a[~blank], end - start))
    tongue = langs.dictionary_encode()
    lang = tongue.indices.to_numpy().astype(np.int64)[np.searchsorted(np.cumsum(size), start, side="right")]
    piece = np.cumsum(a == 10, dtype=np.int32)[start]
    near = piece[1:] == piece[:-1]
    pair = np.flatnonzero(near)
    number = np.cumsum(near) - 1
    triple = np.flatnonzero(near[1:] & near[:-1])

    def ones(x: np.ndarray) -> np.ndarray:
        return np.ones(len(x), np.int64)

    return Transducer(
        tongue.dictionary.to_pylist(), words, (lang, word, ones(word)), (lang[pair], word[pair], word[pair + 1], ones(pair)), (number[triple], word[triple + 2], ones(triple))
    )


def _range_batch(parts: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r, blob in parts:
        rows.append((r, blob))
        size += len(blob)
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["range", "automaton"])
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["range", "automaton"])


def _shards(ranges: int, by: int, shard_bytes: int):
    """Texts to stored ranges of shard transducers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            made = shard(table.column(0).combine_chunks(), table.column(1).combine_chunks())
            if made is not None:
                yield from _range_batch(made.cut(ranges, by))

        for whole in batches:
            for part in slices(whole, "text", shard_bytes):
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= shard_bytes:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _finer(ranges: int, bytes_at_once: int):
    """Stored parts, sorted by coarse range, united and cut into the final ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for b in batches:
            for r, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (r != last or size > bytes_at_once):
                    yield from _range_batch(Transducer.union(held).cut(ranges))
                    held, size = [], 0
                last = r
                held.append(blob)
                size += len(blob)
        if held:
            yield from _range_batch(Transducer.union(held).cut(ranges))

    return run


_UNITED = "range long, automaton binary, lang string, k int, phrase string, a long, head long, r1 long, r2 long, r3 long"
_ARROW = pa.schema(
    [("range", pa.int64()), ("automaton", pa.binary()), ("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())]
    + [(c, pa.int64()) for c in ("head", "r1", "r2", "r3")]
)


def _unite(ranges: int, least: int):
    """One range: its pruned transducer (k is null), its phrases with the ranges of their parts, its words by language (k is 0)."""

    def rows(r: int, t: Transducer, lang: np.ndarray, numbers: tuple, count: np.ndarray, head: np.ndarray | None = None) -> pa.Table:
        n, k = len(lang), len(numbers)
        none = pa.nulls(n, pa.int64())
        where = [none, none, none]
        if k > 1:
            where[0] = pa.array(t.ranges(ranges, lang, numbers[0]))
            where[1] = pa.array(t.ranges(ranges, lang, numbers[-1]))
        if k > 2:
            where[2] = pa.array(t.ranges(ranges, lang, numbers[1], numbers[2]))
        names = pa.array(t.langs, pa.string()).take(pa.array(lang))
        return pa.Table.from_arrays(
            [pa.array([r] * n, pa.int64()), pa.nulls(n, pa.binary()), names, pa.array([k] * n, pa.int32()), t.spell(*numbers), pa.array(count), none if head is None else pa.array(head), *where],
            schema=_ARROW,
        )

    def run(group: pa.Table) -> pa.Table:
        r = group.column("range")[0].as_py()
        t = Transducer.union(group.column("automaton").to_pylist())
        words = np.zeros(len(t.langs), np.int64)
        np.add.at(words, t.u[0], t.u[2])
        u, p, a = t.frequent(least)
        # parts have one or two words: the last arcs of the pruned transducer are only read here
        small = Transducer(t.langs, t.words, tuple(x[u] for x in t.u), tuple(x[p] for x in t.p), (p[:0], p[:0], p[:0]))
        blob = small._store(list(small.u), list(small.p), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)) if len(u) + len(p) else None
        pair = t.a[0][a]
        whole = [
            rows(r, t, t.u[0][u], (t.u[1][u],), t.u[2][u]),
            rows(r, t, t.p[0][p], (t.p[1][p], t.p[2][p]), t.p[3][p]),
            rows(r, t, t.p[0][pair], (t.p[1][pair], t.p[2][pair], t.a[1][a]), t.a[2][a], t.p[3][pair]),
        ]
        n = len(t.langs)
        more = [pa.array([r] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(t.langs, pa.string()), pa.array([0] * n, pa.int32()), pa.array([""] * n), pa.array(words)]
        whole.append(pa.Table.from_arrays(more + [pa.nulls(n, pa.int64())] * 4, schema=_ARROW))
        if blob is not None:
            one = [pa.array([r], pa.int64()), pa.array([blob], pa.binary())] + [pa.nulls(1, f.type) for f in list(_ARROW)[2:]]
            whole.append(pa.Table.from_arrays(one, schema=_ARROW))
        return pa.concat_tables(whole)

    return run


def _compose(wanted: pa.Table, automata: pa.Table) -> pa.Table:
    """Requests of one range with the weight of their part."""
    f = pa.array([], pa.int64())
    if wanted.num_rows:
        order = pc.sort_indices(wanted, [("lang", "ascending"), ("part", "ascending")])
        wanted = wanted.take(order)
        t = Transducer.union(automata.column("automaton").to_pylist())
        f = pa.array(t.compose(wanted.column("lang").combine_chunks(), wanted.column("part").combine_chunks()))
    keep = ["lang", "phrase", "k", "a", "head", "slot"]
    return pa.Table.from_arrays([*(wanted.column(c) for c in keep), f], names=[*keep, "f"])


def count_phrases(docs: DataFrame, least: int = MIN_COUNT, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """Written table of united transducers, frequent phrases and words of each language, and the number of ranges."""
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(size / range_bytes))
    by = 1 if ranges <= fanout else math.ceil(math.sqrt(ranges))
    stored = source.mapInArrow(_shards(ranges, by, shard_bytes), "range long, automaton binary")
    if by > 1:
        # coarse ranges are spread over several tasks, each of which unites what it meets of one
        spread = stored.repartition("range", F.pmod(F.xxhash64("automaton"), F.lit(by))).sortWithinPartitions("range")
        stored = spread.mapInArrow(_finer(ranges, range_bytes), "range long, automaton binary")
    return materialize(stored.groupBy("range").applyInArrow(_unite(ranges, least), _UNITED), "colloc-united"), ranges


def mine_collocations(
    docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, share: int = SHARE, heavy: int = HEAVY, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and U+000A-000D and those
    into words at spaces and tabs; phrases stay within a piece.  a counts the phrase, l and r the
    two sides of its lowest-scoring cut (then the first), n all words of the language, and score
    is floor(1000000 a a / (l r)), computed with decimals of 38 digits, exact to 10^14 words.  Phrases
    with less than ``least`` occurrences are no candidates; a candidate of two words goes if a
    candidate of three that contains it has ``share`` percent of its occurrences.  Ranked by score, a
    and then phrase in byte order, so there are no ties.  Null texts are empty, a null lang is
    ``und``; repeated rows count as often as they stand; a table without candidates gives no rows;
    columns other than text and lang are not read.
    """
    united, _ = count_phrases(docs, least, shard_bytes, range_bytes, fanout)
    words = united.where("k = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    counts = united.where("k > 0").drop("range", "automaton")
    common = counts.where((F.col("k") < 3) & (F.col("a") * F.lit(heavy) >= F.lit(total))).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))

    found = counts.where("k > 1")
    first, last, rest = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1), F.substring_index("phrase", " ", -2)

    def ask(slot: int, part, where: str):
        return F.struct(F.lit(slot).alias("slot"), part.alias("part"), F.col(where).alias("range"))

    two, three = [ask(1, first, "r1"), ask(2, last, "r2")], ask(3, rest, "r3")
    asked = found.withColumn("ask", F.explode(F.when(F.col("k") == 3, F.array(*two, three)).otherwise(F.array(*two))))
    asked = asked.select("lang", "phrase", "k", "a", "head", "ask.slot", "ask.part", "ask.range")
    known = asked.join(F.broadcast(common), ["lang", "part"], "left")  # at most 2 * heavy rows
    columns = ["lang", "phrase", "k", "a", "head", "slot", "f"]
    wanted = known.where("f is null").select("range", "lang", "part", "phrase", "k", "a", "head", "slot")
    automata = united.where("automaton is not null").select("range", "automaton")
    looked = wanted.groupBy("range").cogroup(automata.groupBy("range")).applyInArrow(_compose, "lang string, phrase string, k int, a long, head long, slot int, f long")
    answers = known.where("f is not null").select(*columns).unionByName(looked.select(*columns))

    def slot(i: int):
        return F.max(F.when(F.col("slot") == i, F.col("f")))

    each = answers.groupBy("lang", "phrase", "k", "a", "head").agg(slot(1).alias("f1"), slot(2).alias("f2"), slot(3).alias("f3"))

    def cut(k: int, left: str, right: str):
        def exact(c: str, digits: int = 14):
            return F.col(c).cast(f"decimal({digits},0)")

        quotient = F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact(left) * exact(right))
        return F.struct(quotient.alias("score"), F.lit(k).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r"))

    best = F.when(F.col("k") == 2, cut(1, "f1", "f2")).otherwise(F.least(cut(1, "f1", "f3"), cut(2, "head", "f2")))
    scored = each.withColumn("best", best).select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")
    inside = counts.where("k = 3").select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), rest)).alias("phrase"), F.col("a").alias("longer"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a language first, so that no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    fore = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = fore.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
