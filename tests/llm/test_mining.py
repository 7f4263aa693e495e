"""Collocations, filter audit and decontamination against brute force."""

import collections
import hashlib
import itertools
import random
import re

import pyarrow as pa
import pytest

from lexiflow.llm import filter_audit as fa
from lexiflow.llm.collocations import Transducer, mine_collocations, shard
from lexiflow.llm.decontamination import FOLD, GROUPS, Matcher, _pieces, contamination_digest, find_contamination, windows_of
from lexiflow.llm.filter_audit import audit_filters, failure_bits, word_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, bits int, n long, `range` string, k0 string, spans string"
LABELS = "doc_id long, quality int, toxic int, part string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 9, 1, "y", "z", "q") for r in rows], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


# -- collocations


def brute_collocations(rows, least, top, share):
    f = collections.defaultdict(collections.Counter)
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        best = []
        for g, a in cand.items():
            if any(len(x) > len(g) and b * 100 >= a * share and any(x[i : i + len(g)] == g for i in range(len(x))) for x, b in cand.items()):
                continue
            score, cut = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), a, c[g[:cut]], c[g[cut:]], score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n, score))
    return sorted(out)


def talk(rng, n, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ", ", "\n", "\r\n", "!? "]) for _ in range(n))


def phrases_corpus():
    rng = random.Random(3)
    common = ["the", "The", "of", "New", "york", "été", "naïve", "z z", "\x1c", "a", "b", "c", "語", "x1"]
    rows = [(i, talk(rng, rng.randint(0, 120), common[: rng.randint(2, len(common))]), rng.choice(["en", "fr", None, "und", "a\nb", ""]), "s") for i in range(60)]
    rows += [(None, "the the the the " * 40, "en", None), (5, "new york city, " * 30, "en", "s"), (5, "new york city, " * 30, "en", "s")]
    rows += [(7, None, "en", "s"), (8, "", None, "s"), (9, " \t\n", "fr", None), (10, talk(rng, 5000, common), "en", "s"), (11, "w" * 70_000 + " the of", "en", "s")]
    return rows


@pytest.mark.parametrize(("shard_bytes", "range_bytes", "fanout", "heavy"), [(8 << 20, 16 << 20, 1024, 100_000), (700, 900, 4, 100_000), (2000, 3000, 1024, 5)])
def test_collocations_equal_brute_force(spark, shard_bytes, range_bytes, fanout, heavy):
    rows = phrases_corpus()
    for least, top, share in ((3, 40, 50), (10, 2000, 50), (2, 5, 90)):
        got = mine_collocations(frame(spark, rows), least, top, share, heavy, shard_bytes, range_bytes, fanout)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, least, top, share)


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, None, None)], [(1, "one two", "en", "s")]):
        assert mine_collocations(frame(spark, rows)).count() == 0


def test_score_beyond_64_bits(spark):
    """Cut products and a million times the square of a count pass 64 bits."""
    from pyspark.sql import functions as F

    a, left, right = 7_000_000_000_123, 9_000_000_000_457, 8_000_000_000_981
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(*[f"cast({c} as decimal(14,0)) {c}" for c in "alr"])
    got = df.select(F.call_function("div", F.col("a") * F.col("a") * F.lit(1_000_000).cast("decimal(7,0)"), F.col("l") * F.col("r"))).first()[0]
    assert got == 1000000 * a * a // (left * right)


def test_transducers_share_states_and_add_up():
    text = "a b c. d b c. e b c. a b c. a x"
    t = shard(pa.array(["en"]), pa.array([text]))
    (blob,) = [b for _, b in t.cut(1)]
    columns = Transducer._load(blob)
    assert len(columns[10]) == 5 and len(columns[11]) == 3, "pairs ab, db, eb, bc, ax: d b and e b have equal states, b c and a x none"
    twice = Transducer.union([blob, blob, *[b for _, b in t.cut(7)]])
    assert twice.u[2].tolist() == (3 * t.u[2]).tolist() and twice.p[3].tolist() == (3 * t.p[3]).tolist() and twice.a[2].tolist() == (3 * t.a[2]).tolist()
    assert t.compose(pa.array(["en", "en"]), pa.array(["b", "b c"])).tolist() == [4, 4]
    with pytest.raises(ValueError):
        t.compose(pa.array(["en"]), pa.array(["c b"]))


# -- filter audit


def brute_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    parts = collections.defaultdict(list)
    for doc, text, _, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _, _ in rows):
            fails.add("E")
        parts[source or ""].append((fails, doc in good, doc in toxic))
    out, shapley = [], collections.Counter()
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            for i, f in enumerate(order):
                before = set(order[:i])
                alive = [d for d in docs if not d[0] & before]
                gone = [d for d in alive if f in d[0]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), i + 1, len(alive) - len(gone), len(gone), sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audit_corpus():
    rng = random.Random(5)
    letters = ["ab", "cd", "ef", "gh", "É", "x", "y"]

    def prose(n, distinct):
        return " ".join("".join(rng.choice(letters) for _ in range(1 + i % distinct)) + str(i % distinct) for i in range(n))

    texts = [prose(rng.choice([50, 199, 200, 201, 400]), rng.choice([20, 99, 100, 101, 300])) + rng.choice(["", " A#", " QQQQQQQQQQQQ", "\x0b\x1c |"]) for _ in range(25)]
    rows = [(i, rng.choice(texts), None, rng.choice(["s1", "s2", None, "s3"])) for i in range(120)]
    rows += [(200 + i, "hot copy " * 150, None, ["s1", "s2"][i % 2]) for i in range(60)]
    rows += [(i, t, None, "s1") for i, t in ((300, None), (301, ""), (None, texts[0]), (None, None), (None, texts[0]), (302, texts[1]), (302, texts[1]), (302, texts[2]))]
    rows += [(-5, texts[3], None, "s4"), (303, texts[3], None, "s5"), (303, texts[3], None, "s6"), (303, texts[3], None, "s5")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(10, 1, 1), (10, 0, 0), (None, 1, 1), (999, 1, 1), (303, 1, 0)]
    return rows, labels


@pytest.mark.parametrize(("salt_bytes", "power"), [(64 << 20, 28), (5000, 6)])
def test_audit_equals_brute_force(spark, monkeypatch, salt_bytes, power):
    monkeypatch.setattr(fa, "SALT_BYTES", salt_bytes)
    monkeypatch.setattr(fa, "BITMAP_POWER", power)
    rows, labels = audit_corpus()
    got = audit_filters(frame(spark, rows), spark.createDataFrame([(*x, "p") for x in labels], LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], LABELS)
    assert audit_filters(frame(spark, []), empty).count() == 0
    got = audit_filters(frame(spark, [(None, None, None, None)]), empty).collect()
    assert len(got) == 600 and {r.part for r in got} == {""}


def test_long_texts_are_counted_in_stretches():
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "bb", "ccc" * 40, "é"]) + rng.choice([" ", "\n", "\t  ", "\r", "\x0b", "\x0c"]) for _ in range(3000)).encode() + b"z" * 500
    whole = text.split()
    for stretch in (1, 7, 64, 1000, 1 << 20):
        assert word_counts(text, stretch) == (len(whole), len(set(whole)))
    assert failure_bits("".encode()) == 1


# -- decontamination


def brute_contamination(rows, items):
    word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    wanted = collections.defaultdict(set)
    for item, text in items:
        w = re.findall(word, lower(text))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wanted[tuple(w[i : i + k])].add(item or "")
    out = []
    for doc, text, _, _ in rows:
        w = re.findall(word, lower(text))
        hit, found = set(), set()
        for k in {len(x) for x in wanted}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wanted:
                    hit |= set(range(i, i + k))
                    found |= wanted[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_corpus():
    rng = random.Random(11)
    vocabulary = ["an", "Of", "été", "語語", "x9", "longerword" * 3, "b", "c", "de", "resumé"]

    def prose(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" "] * 6 + [", ", "-", "\n", "\x00", "'", "  "]) for _ in range(n))

    items = [(str(i), prose(rng.choice([3, 10, 11, 25, 60]))) for i in range(30)]
    items += [("30", "one"), ("31", "Q R"), ("32", "..."), ("33", None), (None, "null id item of four"), ("9", items[9][1]), ("34", items[3][1]), ("4", prose(14))]
    rows = [(i, prose(rng.randint(0, 200)) + (rng.choice(items)[1] or "") * rng.choice([0, 1, 1, 2]) + prose(rng.randint(0, 30)), "en", "s") for i in range(80)]
    rows += [(None, items[0][1], None, None), (None, items[0][1], None, None), (5, None, None, None), (5, "", "en", "s"), (6, "¿?¡!", "en", "s"), (7, "ONE", "en", "s")]
    rows += [(8, prose(3000) + items[1][1] + prose(500) + items[2][1], "en", "s"), (9, "q" * 5000 + " r null id item of four", "en", "s")]
    return rows, items


@pytest.mark.parametrize(("block_bytes", "slice_bytes"), [(32 << 20, 4 << 20), (4000, 4 << 20), (32 << 20, 150)])
def test_contamination_equals_brute_force(spark, block_bytes, slice_bytes):
    rows, items = leak_corpus()
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id string, text string, doc_id string")
    found = find_contamination(frame(spark, rows), bench, block_bytes=block_bytes, slice_bytes=slice_bytes)
    got = contamination_digest(found)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_contamination(rows, items)


def test_contamination_of_nothing_and_by_nothing(spark):
    rows, items = leak_corpus()
    bench = "item_id long, text string"
    assert contamination_digest(find_contamination(frame(spark, []), spark.createDataFrame([(1, "a b")], bench))).count() == 0
    none = contamination_digest(find_contamination(frame(spark, rows), spark.createDataFrame([(1, "..."), (2, None)], bench)))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def test_search_skips_most_positions_and_misses_nothing():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(20)]
    matcher = Matcher({w: [str(i)] for i, p in enumerate(passage) for w in windows_of(p)})
    text = (" ".join(rng.choice(vocabulary) for _ in range(60_000)) + " " + passage[3] + " end").encode().translate(FOLD)
    looked = []
    for g in matcher.groups:
        shift = g.shift

        class Counting(type(shift)):
            def __getitem__(self, at):
                looked.append(at.size)
                return super().__getitem__(at)

        g.shift = shift.view(Counting)
    words, hits = matcher.search([text])
    assert words.tolist() == [60_031] and {w for _, w, _, _ in hits} == set(range(60_000, 60_021))
    assert sum(looked) < len(text) / 5 * len(matcher.groups)


def test_pieces_overlap_by_nine_words():
    rng = random.Random(4)
    text = b" ".join(rng.choice([b"a", b"bb", b"cccccc" * 9]) + b" " * rng.randint(0, 3) for _ in range(400))
    words = text.split()
    for limit in (1, 10, 100, 3000):
        seen = []
        for before, again, piece in _pieces(text, limit, 10):
            mine = piece.split()
            assert words[before : before + len(mine)] == mine and again <= 9
            seen.append((before, before + len(mine)))
        assert all(b[0] <= max(0, a[1] - 9) for a, b in itertools.pairwise(seen)) and seen[-1][1] == len(words)
    assert GROUPS[-1] == len(windows_of("a")[0])
