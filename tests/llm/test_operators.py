"""The llm operators against brute force on small tables with nulls, blanks, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lexiflow.llm import exact_dedup as ed
from lexiflow.llm import packing as pk
from lexiflow.llm.components import components
from lexiflow.llm.fingerprints import fingerprint_edits
from lexiflow.llm.html_blocks import extract_main_text, main_text
from lexiflow.llm.jaccard_join import intersections, jaccard_join, matched_depth
from lexiflow.llm.language_id import language_id, limit
from lexiflow.llm.line_dedup import line_dedup
from lexiflow.llm.mixing import mix
from lexiflow.llm.quality import score_quality
from lexiflow.llm.queries import QUERIES, tokenizer_path
from lexiflow.llm.substring_dedup import align, chain, common, repeated_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, kept boolean, score double, bucket int"
SYLLABLES = ["an", "re", "ti", "on", "sta", "mo", "ve", "li", "ku", "per", "da", "shi"]


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus():
    """Distinct, copied, nearly copied, blank, null, short and very long texts; null and repeated ids; clashing columns."""
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randint(30, 120))) for _ in range(40)]
    rows, ids = [], iter(range(1, 10_000))
    for i, t in enumerate(base):
        rows.append((next(ids), t, ["en", "de"][i % 2], f"s{i % 12}"))
        if i % 4 == 0:
            rows.append((next(ids), t.replace(" ", "\n", 3), "en", f"s{(i + 1) % 12}"))
        if i % 5 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            rows.append((next(ids), " ".join(w), "en", None))
    passage = " ".join(words(rng, 70))
    for _ in range(3):
        rows.append((next(ids), " ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 40)), "en", "s1"))
    for i in range(14):
        rows.append((next(ids), f"Shared line here.\n{' '.join(words(rng, 20))}\n\n Shared line here. ", "en", f"s{i}"))
    rows += [(next(ids), x, None, "s1") for x in ("", None, " \n\t", "hi", "hi", "two words", "12 34 !!")]
    rows += [(None, base[0], "en", None), (None, None, None, None), (5, rows[4][1], rows[4][2], rows[4][3])]
    rows.append((next(ids), " ".join(words(rng, 9000)), "de", "s2"))
    return [(i, t, lang, s, len(t or ""), 1, "x", True, 0.5, 3) for i, t, lang, s in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_exact_dedup_equals_brute_force(docs, empty):
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    want = collections.Counter()
    for body, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in g:
            want[(r[0], best[0], len(g), hashlib.sha256(body.encode()).hexdigest())] += 1
    for table_bytes in (ed.TABLE_BYTES, 2000):
        got = ed.exact_dedup(docs, table_bytes=table_bytes).collect()
        assert bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert ed.exact_dedup(empty).count() == 0


def test_grace_table_compares_content_not_digests():
    records = [(b"\0" * 32, t, 1, (-1, False, i, i), i) for i, t in enumerate([b"a", b"b", b"a"] * 50)]
    got = {g.text: list(g.tags) for g in ed.grace(records, table_bytes=10)}
    assert {t: len(x) for t, x in got.items()} == {b"a": 100, b"b": 50}


def test_line_dedup_equals_brute_force(docs, empty):
    spread, first = collections.defaultdict(set), {}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    order = sorted((r for r in ROWS if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0))
    for r in order:
        for p, line in enumerate(map(strip, r[1].split("\n"))):
            if line:
                spread[line].add(r[3])
                first.setdefault(line, (r[0], p))
    def clean(r):
        lines = r[1].split("\n")
        return "\n".join(x for p, x in enumerate(lines) if not (strip(x) and len(spread[strip(x)]) >= 10 and first[strip(x)] != (r[0], p)))
    want = bag((r[0], None if r[1] is None else clean(r), r[4]) for r in ROWS)
    out = line_dedup(docs)
    assert bag((r.doc_id, r.text, r.n_chars) for r in out.collect()) == want
    clash = docs.selectExpr("doc_id", "text", "source", "n_chars", *[f"1 as `{c}`" for c in ("gone", "_gone_row", "_0row", "h1", "line", "a.b")])
    assert bag((r.doc_id, r.text, r.n_chars) for r in line_dedup(clash).collect()) == want
    assert any("Shared line" in (r[1] or "") and not clean(r).count("Shared") for r in ROWS if r[1])
    assert line_dedup(empty).count() == 0


def test_fingerprints_estimate_generalised_jaccard(docs, empty):
    rows = {(r.doc_id, r.edited_sha256): r for r in fingerprint_edits(docs).collect()}
    ordered = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert sum(1 for _ in rows) >= len({r[0] for r in ROWS if r[0] is not None})
    bag_of = lambda t: collections.Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t) if w)
    like = lambda a, b: sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
    err, prints, unique = [], {}, {r[0] for r in ROWS if [x[0] for x in ROWS].count(r[0]) == 1 and r[0] is not None}
    for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        if a[0] not in unique or b[0] not in unique:
            continue
        t, u = a[1] or "", b[1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = rows[(a[0], hashlib.sha256(edited.encode()).hexdigest())]
        assert r.n_chars == len(t)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        err.append(r.near_edited - like(bag_of(t), bag_of(edited)))
        assert abs(r.near_next - like(bag_of(t), bag_of(u))) < 0.35
    assert len(err) >= 60 and abs(np.mean(err)) < 0.03 and np.sqrt(np.mean(np.square(err))) < 0.09
    assert fingerprint_edits(empty).count() == 0


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for r in ROWS:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for s in range(0, len(ids), 4096):
            want[(r[0], s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids))] += 1
    got = pk.pack(docs, tokenizer_path()).collect()
    assert bag((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert pk.pack(empty, tokenizer_path()).count() == 0


def test_word_ids_equal_the_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer

    tok, words_ = Tokenizer.from_file(tokenizer_path()), pk.WordIds(tokenizer_path())
    odd = ["It's the dog's, we'll x²y ½ 3.14 foo_bar", "Straße ÀÉ İstanbul ΑΣ σς", "a\tb\x0bc d e\x1cf\x85g", "<|endoftext|> x<|startoftext|>y", "é café 日本語 한국어 🎉👍🏽", "'S 'T isn't", "ª º ǅ ŉ ſ ẞ ɐ", " ", "don’t “x” …"]
    for text in odd:
        assert words_.ids(text) == np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 500)
    place, offset = pk.best_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [c for c in room if c >= lengths[i]]
        if fits:
            room.remove(min(fits))
        left = (min(fits) if fits else 100) - int(lengths[i])
        room.append(left)
        want[i] = 100 - left - int(lengths[i])
    assert [want[i] for i in range(500)] == offset.tolist()
    used = np.bincount(place, weights=lengths)
    assert used.max() <= 100 and len(used) == len(room)


def test_mixing_targets_and_sizes(docs, empty):
    got = mix(docs).collect()
    size = collections.Counter()
    for r in ROWS:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert bag((r.doc_id, r.size) for r in got) == bag((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in ROWS)
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    by_size = collections.defaultdict(set)
    for s in names:
        by_size[size[s]].add(round(target[s], 6))
    assert all(round(r.target, 6) in by_size[r.source_size] for r in got)
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in got)
    assert bag(mix(docs.repartition(5)).collect()) == bag(got)
    assert mix(empty).count() == 0


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [256, 2])
def test_jaccard_join_equals_brute_force(docs, empty, block):
    sets = [grams(r[1]) for r in ROWS]
    n, parent = len(ROWS), list(range(len(ROWS)))
    links = [0] * n
    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for i in range(n):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= 0.8 * union:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    lead = {}
    for i, r in enumerate(ROWS):
        if r[0] is not None:
            lead[find(i)] = min(lead.get(find(i), r[0]), r[0])
    got = jaccard_join(docs, block=block).collect()
    assert bag((r.doc_id, r.class_id, r.n_links) for r in got) == bag((r[0], lead.get(find(i)), links[i]) for i, r in enumerate(ROWS))
    assert sum(r.kept for r in got) == len({find(i) for i in range(n)})
    if block == 2:
        assert jaccard_join(empty).count() == 0


def test_matched_depth_and_intersections():
    assert matched_depth(0.8, 16, 12, 0.999) == 4
    assert 1 - (1 - 0.8**5) ** 16 < 0.999 <= 1 - (1 - 0.8**4) ** 16
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = intersections(sets, columns=7)
    assert all(got[i][j] == want[i][j] for i in range(20) for j in range(20) if i != j)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_chain_equals_quadratic_dynamic_programming():
    rng = random.Random(5)
    for _ in range(30):
        pts = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(25)})
        x, y, k, cost = [p[0] for p in pts], [p[1] for p in pts], 8, 0.1
        best = [8.0] * len(pts)
        # the same recurrence by brute force: the predecessor of the best net score, its gain bounded by the steps
        for i in range(len(pts)):
            js = [j for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            if js:
                net, j = max((best[j] + cost * (x[j] + y[j]), -j) for j in js)
                j = -j
                best[i] = max(8.0, net + min(k, x[i] - x[j], y[i] - y[j]) - cost * (x[i] + y[i]))
        chains = chain(x, y, k, cost)
        assert sorted(i for c in chains for i in c) == list(range(len(pts)))
        for c in chains:
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:], strict=False))
        assert chains[0][-1] == max(range(len(pts)), key=lambda q: (round(best[q], 6), -q)) or max(best) == pytest.approx(best[chains[0][-1]])


def test_align_counts_edits():
    a = [f"w{i}" for i in range(60)]
    b = ["q", *a[:30], "x", *a[31:], "z"]
    s, n, t, m, hits = align(a, b, [0, 40], [1, 41], 8)
    assert (s, n, t, m, hits) == (0, 60, 1, 60, 59)


def test_periodic_passages_are_found(spark):
    rng = random.Random(11)
    around = lambda: " ".join(words(rng, 30))
    rows = [(i, f"{around()} {' '.join(['of'] * n)} {around()}") for i, n in ((1, 60), (2, 90), (3, 75))]
    rows += [(4, around() + " x y" * 40), (5, " x y" * 35 + around()), (6, around())]
    named = {x for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in (r.doc_id, r.other_id)}
    assert named == {1, 2, 3, 4, 5}


def test_common_words_equal_dynamic_programming():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for cells in (1 << 26, 20):
            got = common(a, b, cells)
            assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_two_passages_of_one_pair_are_split(spark):
    rng = random.Random(13)
    one, two = words(rng, 80), words(rng, 80)
    fill = lambda n, w: [f"{w}{i}" for i in range(n)]
    rows = [(1, one + fill(100, "p") + two), (2, one + fill(100, "q") + two)]
    rows += [(3, [x + "a" for x in one + two]), (4, [x + "a" for x in one] + fill(100, "r") + [x + "a" for x in two])]
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    spans = {(r.doc_id, r.start, r.length) for r in got} | {(r.other_id, r.other_start, r.other_length) for r in got}
    assert {s for s in spans if s[0] in (1, 2)} == {(d, s, 80) for d in (1, 2) for s in (0, 180)}
    assert {s for s in spans if s[0] == 4} == {(4, 0, 80), (4, 180, 80)} and {s for s in spans if s[0] == 3} == {(3, 0, 80), (3, 80, 80)}
    assert all(r.identity == 1 for r in got)


def test_every_copy_of_a_passage_is_found(spark):
    rng = random.Random(19)
    p, around = words(rng, 70), lambda: words(rng, 40)
    quote = p[20:40]
    texts = {1: [p, p], 2: [p], 3: [quote, p, p, p], 4: [p], 5: [p, p, quote]}
    rows, places = [], set()
    for d, parts in texts.items():
        t = around()
        for x in parts:
            if x is p:
                places.add((d, len(t)))
            t = t + x + around()
        rows.append((d, " ".join(t)))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = [(r.doc_id, r.start, r.length) for r in got] + [(r.other_id, r.other_start, r.other_length) for r in got]
    found = {(d, at) for d, at in places for i, s, n in spans if i == d and s <= at + 2 and s + n >= at + 68 and n < 80}
    assert found == places


def test_passages_of_lines_that_stand_elsewhere_are_found(spark):
    rng = random.Random(23)
    rows, pairs = [], set()
    for g in range(30):
        lines = [words(rng, 20) for _ in range(3)]
        texts = {7: sum(lines, []), 9: sum(lines, [])}
        for j, line in enumerate(lines):
            # around the ends as well: what two lines have at their border stands elsewhere too
            texts[1 + j], texts[20 + j] = line, line
        texts[4] = texts[30] = lines[0][-6:] + lines[1][:6]
        texts[5] = texts[31] = lines[1][-6:] + lines[2][:6]
        pairs.add((100 * g + 7, 100 * g + 9))
        rows += [(100 * g + d, " ".join(words(rng, 30) + t + words(rng, 30))) for d, t in texts.items()]
    got = {tuple(sorted((r.doc_id, r.other_id))) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pairs


def test_edited_passages_are_found(spark):
    rng = random.Random(17)
    rows, edited = [], {}
    for i in range(160):
        rate, p = (5, 10, 20, 0)[i % 4], words(rng, 100 if i % 4 < 3 else 60)
        places = set(rng.sample(range(1, 99), rate)) if rate else set(range(7, 60, 8))
        q = [f"edit{i}x{j}" if j in places else w for j, w in enumerate(p)]
        for d, t in ((2 * i, p), (2 * i + 1, q)):
            rows.append((d, " ".join(words(rng, 30) + t + words(rng, 30))))
        edited[2 * i] = rate
    got = {min(r.doc_id, r.other_id) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if abs(r.doc_id - r.other_id) == 1}
    recall = {rate: np.mean([d in got for d, r in edited.items() if r == rate]) for rate in (0, 5, 10, 20)}  # 0: every 8th of 60 words
    assert recall[0] == recall[5] == recall[10] == 1 and recall[20] >= 0.9


def test_passages_are_found_and_clean_documents_left_alone(docs, empty):
    got = repeated_passages(docs).collect()
    named = {x for r in got for x in (r.doc_id, r.other_id)}
    text = {r[0]: (r[1] or "").lower().split() for r in ROWS if r[0] is not None}
    def runs(t, n=50):
        return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    holders = collections.defaultdict(set)
    for i, t in text.items():
        for q in runs(t):
            holders[q].add(i)
    sharing = {i for s in holders.values() if len(s) > 1 for i in s}
    assert sharing <= named
    fives = collections.defaultdict(set)
    for i, t in text.items():
        for q in runs(t, 8):
            fives[q].add(i)
    clean = {i for i, t in text.items() if all(fives[q] == {i} for q in runs(t, 8))}
    assert clean and not clean & named
    assert all(r.length >= 50 and r.other_length >= 50 and r.identity >= 0.8 for r in got)
    assert repeated_passages(empty).count() == 0


def test_quality_scores(spark, docs, empty):
    out = score_quality(docs, ["doc_id", "text", "score"]).collect()
    assert bag((r.doc_id, r.text) for r in out) == bag((r[0], r[1]) for r in ROWS)
    assert all(r.quality_score == 0 for r in out if not (r.text or "").strip(" \n\t"))
    assert all(0 <= r.quality_score <= 1 and 0 <= r.weak_label <= 1 for r in out)
    assert score_quality(empty, ["doc_id"]).count() == 0
    import duckdb

    sf = "/root/testdata/sf0.01"
    gold = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    kept = {r.doc_id: r.kept for r in QUERIES["op2_quality_classifier"](spark, sf).collect()}
    good = [kept[i] for i, q in gold.items() if q == 1]
    bad = [kept[i] for i, q in gold.items() if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.15


def test_language_id(spark, docs, empty):
    out = language_id(docs).collect()
    assert bag((r.doc_id, r.held_out) for r in out) == bag((r[0], zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 4 == 2) for r in ROWS)
    assert all((r.lang_pred == "und") == (r.doc_id in {x[0] for x in ROWS if not re.search(r"[^\W\d_]", x[1] or "")}) for r in out if r.doc_id is not None)
    assert language_id(empty).count() == 0
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [(r.lang_pred, truth[r.doc_id]) for r in QUERIES["op8_language_id"](spark, sf).collect() if r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.98


def test_language_id_of_many_and_rare_languages(spark):
    rng = random.Random(29)
    letters = [chr(0x4E00 + i) for i in range(130 * 8)]  # 8 letters of its own a language
    rows = []
    for i in range(130):
        for _ in range(3000 if i == 0 else 24):
            rows.append((len(rows), " ".join("".join(rng.choice(letters[8 * i : 8 * i + 8]) for _ in range(2)) for _ in range(40)), f"l{i:03}"))
    truth = {r[0]: r[2] for r in rows}
    out = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=100).collect()
    held = [r for r in out if r.held_out]
    assert len({truth[r.doc_id] for r in held}) > 120 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert limit(5, 3) == limit(3, 3) == 2**63 - 1 and limit(20_000, 10**12) > limit(1, 10**12) > -(2**63)


def test_html(spark):
    article = "<p>One of the\n  things &amp; more.</p><p>Two<br>three <a href=x>link</a> of the story that was told to all who came and sat by the fire.</p>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=a>Menu</a></li></ul></nav><div class='cookie-notice'>We use the cookies of the site</div><article><h1>Head</h1>{article}<section id=comments><p>The first of the comments</p></section><form>Name <input></form><aside>Side</aside></article><footer>&copy; x</footer><script>var a='<p>no</p>'</script>"
    want = "Head\nOne of the things & more.\nTwo three link of the story that was told to all who came and sat by the fire."
    assert main_text(page) == want
    bare = f"<div id=menu><a href=a>Home</a></div><div>{article}<p>Short one.</p>{article}</div><div class=footer>All of the rights</div>"
    assert main_text(bare).split("\n")[2] == "Short one." and "rights" not in main_text(bare) and "Home" not in main_text(bare)
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<article><p><b>a<br><p>b" + " c" * 50_000, "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert bag(got) == bag([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "a\nb" + " c" * 50_000, 100_003)])
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_long_passage_of_mixed_holders_is_reported_whole(spark):
    rng = random.Random(29)
    p = [f"w{i}x{rng.randint(0, 9)}" for i in range(900)]
    around = lambda n: [f"r{rng.randint(0, 10**9)}" for _ in range(n)]
    rows = [(10, around(30) + p + around(30)), (11, around(700) + p + around(20))]
    # all but the inner 100 words of the passage also stand elsewhere, in documents of every order
    for d, part in ((1, p[:400]), (2, p[500:]), (30, p[:400]), (31, p[500:]), (5, p[200:400]), (6, p[500:700])):
        rows.append((d, around(20) + part + around(20)))
    got = repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    whole = {(r.doc_id, r.start, r.length) for r in got} | {(r.other_id, r.other_start, r.other_length) for r in got}
    assert {(10, 30, 900), (11, 700, 900)} <= whole


def test_a_passage_whose_parts_also_stand_elsewhere_is_found_in_spite_of_edits(spark):
    rng = random.Random(31)
    rows, pairs = [], set()
    for g in range(15):
        p = words(rng, 60)
        q = [f"edit{g}x{i}" if i % 12 == 11 else w for i, w in enumerate(p)]
        texts = {7: p, 9: q}
        # each part between two edits stands in other documents, so first and last holders of its seeds seldom have the passage
        for j in range(0, 60, 12):
            for c in range(20):
                texts[10 + 20 * (j // 12) + c] = p[j : j + 11]
        pairs.add((1000 * g + 7, 1000 * g + 9))
        rows += [(1000 * g + d, " ".join(words(rng, 30) + t + words(rng, 30))) for d, t in texts.items()]
    got = {tuple(sorted((r.doc_id, r.other_id))) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pairs


def test_scratch_of_passages_goes_as_soon_as_nothing_reads_it(spark, docs):
    import time

    from lexiflow.session import checkpoint_dir

    def shuffled():
        """Bytes of each shuffle file of this process."""
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    def tables():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/lexiflow-tables")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()

    old, old_tables = set(shuffled()), tables()
    got = repeated_passages(docs)
    left = 0
    for _ in range(40):  # executors remove files a little later
        left = sum(n for f, n in shuffled().items() if f not in old)
        if left < 20_000:
            break
        time.sleep(0.5)
    assert left < 20_000
    assert not {t for t in tables() - old_tables if t.startswith(("sd-shared", "sd-runs"))}
    assert got.count() > 0


def test_the_screen_of_pairs_keeps_what_an_alignment_finds():
    import pyarrow as pa

    from lexiflow.llm.substring_dedup import _alignments, _screen

    rng = random.Random(37)
    lists = pa.list_(pa.list_(pa.int32()))
    rows = []
    for i in range(400):
        n, seed = rng.choice((20, 38, 45, 60, 150)), 4
        p = words(rng, n)
        q = [w if rng.random() < rng.choice((1, 0.9, 0.7)) else "other" for w in p]
        at = rng.randrange(n - seed)
        q[at : at + seed] = p[at : at + seed]
        a, b = words(rng, 90) + p + words(rng, rng.choice((0, 90))), words(rng, rng.choice((0, 70))) + q + words(rng, 80)
        rows.append((i, i + 1000, a, b, [[90 + at]], [[len(b) - 80 - n + at]]))

    def batch(rows, margin):
        cut = lambda t, c: (max(0, c[0][0] - margin), t[max(0, c[0][0] - margin) : c[0][0] + 4 + margin])
        cols = collections.defaultdict(list)
        for d, od, a, b, xs, ys in rows:
            for side, t, c in (("a", a, xs), ("b", b, ys)):
                start, part = cut(t, c)
                cols[f"{side}0"].append(start)
                cols[f"n{side}"].append(len(t))
                cols[f"t{side}"].append(" ".join(part))
            for name, v in (("d", d), ("od", od), ("id", d), ("oid", od), ("xs", xs), ("ys", ys)):
                cols[name].append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, lists if c in ("xs", "ys") else None) for c, v in cols.items()], names=list(cols))

    kept = {d for r in _screen(4, 50, 0.8)(iter([batch(rows, 50)])) for d in r.column("d").to_pylist()}
    found = {d: f for r in _alignments(4, 50, 0.8)(iter([batch(rows, 1000)])) for d, f in zip(r.column("d").to_pylist(), r.column("found").to_pylist())}
    again = {d: f for r in _alignments(4, 50, 0.8)(iter([batch([x for x in rows if x[0] in kept], 1000)])) for d, f in zip(r.column("d").to_pylist(), r.column("found").to_pylist())}
    assert found == again and 50 < len(found) <= len(kept) < 300


def test_links_of_rare_and_common_seeds_are_chained_together(spark):
    rng = random.Random(37)
    rows, pairs = [], set()
    for g in range(12):
        p, q = words(rng, 25), words(rng, 25)
        # the halves are parted by words that only one has, so neither is enough alone; six others have the first half too
        texts = {7: p + words(rng, 4) + q, 9: p + q, **{20 + c: p for c in range(6)}}
        pairs.add((100 * g + 7, 100 * g + 9))
        rows += [(100 * g + d, " ".join(words(rng, 30) + t + words(rng, 30))) for d, t in texts.items()]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in got} == pairs
    # a pair of documents stands in one order only
    assert not {(r.doc_id, r.other_id) for r in got} & {(r.other_id, r.doc_id) for r in got}


def test_further_copies_are_matched_with_every_holder(spark):
    rng = random.Random(41)
    p, rows, places = words(rng, 60), [], {}
    for d in range(8):
        t = words(rng, 30) + p
        places[d] = [30]
        if d < 4:
            places[d].append(len(t) + 70)
            t = t + words(rng, 70) + p
        rows.append((d, " ".join(t + words(rng, 30))))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {(a, b, s) for r in got for a, b, s in ((r.doc_id, r.other_id, r.start), (r.other_id, r.doc_id, r.other_start))}
    assert {(a, b, s) for a in places for b in places if a != b for s in places[a]} <= spans
