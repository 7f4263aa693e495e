"""N-gram Jaccard self-join: MinHash prefixes of a fixed length, then exact verification.

1. Copies (equal words, ignoring case and white space) become one text.
2. A text has ``trees`` prefixes of MinHash values of its word 5-grams, each folded to
   one number.  Their length is shortened from ``max_depth`` until a pair at the
   threshold meets in some prefix with the target recall; this depends on the
   parameters alone, so no longer labels and no tries are built: it is banding.
3. Texts of one prefix, a node, are candidates.  A pair is verified only in the first
   tree in which it meets; nodes whose texts another tree already has are dropped.
   A node with more than ``block`` texts is cut into blocks and every pair of blocks
   is a task of its own, so nothing caps a node and no task holds a whole one.
4. Verification computes exact intersections of the whole shingle sets and returns
   the number of links of each text and a spanning forest of the links, never the
   pairs; connected components give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.components import components
from lexiflow.llm.textops import Words, mix, multipliers, row_numbers, shingles, slices
from lexiflow.sources.tables import materialize

K = 5
SIMILARITY = 0.8
TREES = 16
MAX_DEPTH = 12
RECALL = 0.999
BLOCK = 256


def matched_depth(similarity: float, trees: int, max_depth: int, recall: float) -> int:
    """Shorten the matched prefix until a pair at the threshold meets in some tree with probability ``recall``."""
    depth = max_depth
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def plain_words(text: Column) -> Column:
    """Lower-cased words joined by one space; null counts as empty."""
    t = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+", " ")
    return F.trim(t)


def _sketch(k: int, trees: int, depth: int):
    a, m = mix(np.arange(trees * depth, dtype=np.uint64) + np.uint64(991)), multipliers(trees * depth, 5)
    level = multipliers(depth, 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = row_numbers()
        for batch in batches:
            for b in slices(batch, "plain"):
                words = Words(b.column("plain"))
                sh, at, _ = shingles(words, k)
                n = len(b)
                has = np.zeros(n, bool)
                has[at] = True
                first = np.flatnonzero(np.diff(at, prepend=-1))
                labels = np.zeros((int(has.sum()), trees), np.uint64)
                if len(first):
                    for t in range(trees):
                        for d in range(depth):
                            p = t * depth + d
                            labels[:, t] += np.minimum.reduceat((sh ^ a[p]) * m[p], first) * level[d]
                    labels = mix(labels)
                off = np.concatenate(([0], np.cumsum(has * trees))).astype(np.int32)
                sig = pa.ListArray.from_arrays(pa.array(off), pa.array(labels.view(np.int64).ravel()))
                kept = [c for c in b.schema.names if c == "kept_row"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.arange(row, row + n)), b.column("digest"), sig, *(b.column(c) for c in kept)], names=["doc_id", "row", "digest", "sig", *kept])
                row += n

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "plain"):
                sh, at, _ = shingles(Words(b.column("plain")), k)
                cut = np.searchsorted(at, np.arange(len(b) + 1))
                own = [np.unique(sh[x:y]).tobytes() for x, y in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), b.column("sig"), pa.array(own, pa.binary())], names=["rep", "n", "sig", "own"])

    return run


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sorted sets; only items of two sets or more are multiplied."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count >= 2
    number = np.cumsum(shared) - 1
    keep = shared[item]
    item, owner = number[item[keep]], owner[keep]
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    out = np.zeros((m, m), np.float32)
    width = int(shared.sum())
    for lo in range(0, width, columns):
        x, y = np.searchsorted(item, [lo, lo + columns])
        block = np.zeros((m, min(columns, width - lo)), np.float32)
        block[owner[x:y], item[x:y] - lo] = 1
        out += block @ block.T
    return out


def _verify(similarity: float):
    def links(tree: int, same: bool, rep: np.ndarray, n: np.ndarray, side: np.ndarray, sig: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple]:
        m = len(rep)
        inter = intersections(sets)
        size = np.array([len(s) for s in sets], np.float64)
        union = size[:, None] + size[None, :] - inter
        hit = inter >= similarity * union - 1e-9
        np.fill_diagonal(hit, False)
        for t in range(tree):
            hit &= sig[:, None, t] != sig[None, :, t]
        if not same:
            hit &= side[:, None] != side[None, :]
        texts, docs = hit.sum(1), hit @ n
        root = np.full(m, -1)
        for i in np.flatnonzero(texts).tolist():
            if root[i] < 0:
                root[i], reach = i, np.array([i])
                while len(reach):
                    reach = np.flatnonzero(hit[reach].any(0) & (root < 0))
                    root[reach] = i
            yield int(rep[i]), int(rep[root[i]]) if root[i] != i else None, int(texts[i]), int(docs[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(8)), strict=True)

        def groups() -> Iterator[tuple[tuple, list[tuple]]]:
            key, members, last = None, [], None
            for tree, p, x, y, rep, n, sig, own in rows():
                if (tree, p, x, y) != key:
                    if key is not None:
                        yield key, members
                    key, members, last = (tree, p, x, y), [], None
                if rep != last:  # a text may come twice when its row repeats
                    members.append((rep, n, sig, own))
                    last = rep
            if key is not None:
                yield key, members

        out: list[tuple] = []
        for (tree, _, x, y), members in groups():
            if len(members) > 1:
                rep = np.array([g[0] for g in members])
                n = np.array([g[1] for g in members])
                sig = np.array([g[2] for g in members], np.int64)
                sets = [np.frombuffer(g[3], np.uint64) for g in members]
                parts = max(1, y >> 32)  # number of blocks of the node, packed beside the second block's number
                side = block_of(rep, parts)
                out += links(tree, x == (y & 0xFFFFFFFF), rep, n, side, sig, sets)
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rep", "other", "texts", "docs"])

    return run


def block_of(rep: np.ndarray, parts: int) -> np.ndarray:
    """Block of a text among ``parts``; the same rule as :func:`block_col`."""
    return (rep ^ (rep >> 40)) % parts


def block_col(rep: str, parts: str) -> Column:
    return F.expr(f"({rep} ^ shiftright({rep}, 40)) % {parts}")


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, trees: int = TREES, max_depth: int = MAX_DEPTH, recall: float = RECALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies, kept (with ``keep`` also a struct kept_row of those columns).

    Two documents are linked if the sets of their word 5-grams have a Jaccard
    similarity of ``similarity`` or more (lower case, words by ASCII white space; a
    text of 1 to 4 words has one gram, all its words).  Texts without words, null
    among them, are copies of each other and have no other links.  ``class_id`` is the
    least doc_id of the connected component (null last), ``n_links`` the number of
    other rows linked to this one, copies included, ``n_copies`` the rows with the
    same words.  Exactly one row of each class has ``kept``: the one with class_id
    (repeated rows: the first read).  An empty table gives an empty result; other
    columns are not read.
    """
    depth = matched_depth(similarity, trees, max_depth, recall)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_words(F.col(text_col)).alias("plain")).withColumn("digest", F.sha2("plain", 256))
    read, extra = src, []
    if keep:
        extra = ["kept_row"]
        read = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_words(F.col(text_col)).alias("plain"), F.struct(*keep).alias("kept_row")).withColumn("digest", F.sha2("plain", 256))
    schema = T.StructType.fromDDL("doc_id long, row long, digest string, sig array<long>")
    for c in extra:
        schema = schema.add(c, read.schema[c].dataType)
    sk = materialize(read.mapInArrow(_sketch(k, trees, depth), schema), "jj-sketch")
    classes = sk.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("f"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select("digest", F.col("f.row").alias("rep"), F.col("f.doc_id").alias("first_id"), "n"), "jj-classes")
    reps = sk.select("row", "sig").join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    under = reps.select(F.col("row").alias("rep"), F.posexplode("sig").alias("tree", "p"))
    nodes = under.groupBy("tree", "p").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(3), "rep")).alias("x2")).where("m > 1")
    nodes = nodes.groupBy("m", "x1", "x2").agg(F.min(F.struct("tree", "p")).alias("t")).select("t.tree", "t.p", "m")
    nodes = materialize(nodes, "jj-nodes")
    parts = F.ceil(F.col("m") / block).cast("long")
    members = under.join(nodes, ["tree", "p"]).withColumn("parts", parts)
    members = materialize(members.select("tree", "p", "parts", "rep"), "jj-members")
    needed = members.select("rep").distinct()
    wanted = classes.join(needed, "rep").select("digest", F.col("first_id").alias("doc_id"), "rep", "n")
    texts = src.join(wanted, (src["digest"] == wanted["digest"]) & src["doc_id"].eqNullSafe(wanted["doc_id"])).select("rep", "n", "plain")
    sets = texts.join(sk.select(F.col("row").alias("rep"), "sig"), "rep").mapInArrow(_sets(k), "rep long, n long, sig array<long>, own binary")
    sets = materialize(sets, "jj-sets")
    b = block_col("rep", "parts")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.struct(F.least(i, b).alias("x"), F.greatest(i, b).alias("y")))
    dealt = members.select("tree", "p", "parts", "rep", F.explode(pairs).alias("xy"))
    dealt = dealt.select("tree", "p", F.col("xy.x").alias("x"), (F.shiftleft("parts", 32) + F.col("xy.y")).alias("y"), "rep")
    dealt = dealt.join(sets, "rep").select("tree", "p", "x", "y", "rep", "n", "sig", "own")
    dealt = dealt.repartition("tree", "p", "x", "y").sortWithinPartitions("tree", "p", "x", "y", "rep")
    found = materialize(dealt.mapInArrow(_verify(similarity), "rep long, other long, texts long, docs long"), "jj-links")
    counts = found.groupBy("rep").agg(F.sum("docs").alias("docs"))
    label = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct())
    known = classes.join(counts, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    known = materialize(known, "jj-known")
    lead = known.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull().alias("x"), F.col("first_id").alias("doc_id"), F.col("rep").alias("row"))).alias("lead"))
    known = known.join(materialize(lead, "jj-lead"), "label")
    known = materialize(known.select("digest", "n", "docs", F.col("lead.doc_id").alias("class_id"), F.col("lead.row").alias("lead_row")), "jj-final")
    return sk.select("doc_id", "row", "digest", *extra).join(known, "digest").select(
        "doc_id", "class_id", (F.coalesce("docs", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("n").alias("n_copies"), (F.col("row") == F.col("lead_row")).alias("kept"), *extra,
    )
