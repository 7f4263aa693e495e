"""Bytes are worked on in steps inside a text; plain versions of the language filters and of the mixture's nearness."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lexiflow.llm import language_id as li
from lexiflow.llm import quality as ql
from lexiflow.llm import textops as to
from lexiflow.llm.queries import QUERIES

TEXTS = ["", None, "a", "one two  three", "x" * 100, "é ünï\n" * 40, "Word, " * 30 + "y" * 64 + " end.", "\t \r\n", "!!", "the story was told " * 50]


def plain_hash(word: bytes) -> int:
    total = sum((c + 1) * pow(to._BASE, i, 1 << 64) for i, c in enumerate(word))
    return int(to.mix(np.array([(total + len(word) * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0])


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 18])
def test_words_hash_alike_for_every_step(monkeypatch, step):
    monkeypatch.setattr(to, "STEP", step)
    words = to.Words(pa.array(TEXTS))
    want = [plain_hash(w) for t in TEXTS for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert words.hashes().tolist() == want
    assert to.Words(pa.array([], pa.string())).hashes().tolist() == []
    flag = words.data == ord("e")
    assert to.row_sums(flag, words.off).tolist() == [(t or "").encode().count(b"e") for t in TEXTS]


@pytest.mark.parametrize("step", [1, 5, 33])
def test_features_and_votes_are_alike_for_every_step(monkeypatch, step):
    words = to.Words(pa.array(TEXTS))
    feats, votes = ql.features(words, 64), ql.votes(words)
    grams = [np.concatenate(c) for c in zip(*li.ngrams(pa.array([f"  {t or ''}  " for t in TEXTS])), strict=True)]
    for module in (to, ql, li):
        monkeypatch.setattr(module, "STEP", step)
    assert (ql.features(words, 64) == feats).all() and (ql.votes(words) == votes).all()
    again = [np.concatenate(c) for c in zip(*li.ngrams(pa.array([f"  {t or ''}  " for t in TEXTS])), strict=True)]
    assert all((x == y).all() for x, y in zip(grams, again, strict=True))


def test_a_text_of_a_few_megabytes_in_every_operator_on_words(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(400_000)) + " " + "z" * 600_000
    rows = [(0, long, "en"), (1, long + " end", "en"), (2, "short text of its own", "en"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from lexiflow.llm.jaccard_join import jaccard_join

    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs).collect()} == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0)}
    scores = {r.doc_id: r.quality_score for r in ql.score_quality(docs, ["doc_id"]).collect()}
    assert scores[3] == 0 and abs(scores[0] - scores[1]) < 1e-3
    assert {r.doc_id: r.lang_pred for r in li.language_id(docs).collect()} == {0: "en", 1: "en", 2: "en", 3: "und"}


def gram_list(text):
    data = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in f"  {(text or '').lower()}  ".encode())
    return [data[i - 2 : i + 3] for i in range(len(data)) if data[i] != 32]


def test_language_filters_equal_plain_sets(spark):
    rng = random.Random(12)
    base = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(60)] for x, a in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklmnéü"))}
    rows = []
    for i in range(600):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        mixed = base[lang] + rng.sample(base[rng.choice(list(base))], 25)
        rows.append((i, " ".join(rng.choice(mixed) for _ in range(30)), lang if rng.random() < 0.9 else None))
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "qqqq", None)]
    learned = [r for r in rows if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {x: collections.Counter(g for r in learned if r[2] == x for g in gram_list(r[1])) for x in base}
    size = collections.Counter(r[2] for r in learned)
    rate = {x: {g: n / sum(c.values()) for g, n in c.items() if n >= li.least_count(size[x], 20_000)} for x, c in counts.items()}
    top = collections.defaultdict(float)
    for c in rate.values():
        for g, v in c.items():
            top[g] = max(top[g], v)
    own = {x: {g for g, v in c.items() if v >= top[g] * li.RATE_SHARE} for x, c in rate.items()}
    got = {r.doc_id: r for r in li.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, text, _ in rows:
        g = gram_list(text)
        share = [sum(x in own[name] for x in g) / max(len(g), 1) for name in sorted(own)]
        if not g:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        elif sum(share) == 0:
            assert (got[i].lang_pred, got[i].score) == (max(size, key=size.get), 0.0)
        else:
            best = max(share)
            assert abs(got[i].score - best / sum(share)) < 0.02, (i, got[i], share)
            assert sorted(own)[share.index(best)] == got[i].lang_pred or sorted(share)[-2] > best - 0.02


def test_taken_words_come_near_the_targets(spark):
    sf = "/root/testdata/sf0.01"
    source = dict(duckdb.sql(f"select doc_id, source from '{sf}/documents.parquet'").fetchall())
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in QUERIES["op9_mixing"](spark, sf).collect():
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s], largest[s] = r.target, max(largest[s], r.size)
    assert len(target) == len(set(source.values()))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
