"""Scalar expressions against Python's own rules (str.strip, re \\s, int())."""

import re

import numpy as np

from lexiflow.functions import argmax, clean_text, label_remap, parse_label, text_len, token_count, uid_key
from lexiflow.functions.arrays import nll, truncate_tokens
from lexiflow.functions.text import tokens

ODD = [
    "  hello \t world \n",
    "a\u3000b",
    "\u001cx\u001d y\u001e\u001f",
    "\u0085lead",
    "tail  ",
    "mid        end",
    "emoji 😀  ok",
    "",
    "   ",
    "\u000b\u000c",
    None,
    "keep\u200bzero-width",
]


def py_clean(s):
    if not isinstance(s, str):
        return ""
    return re.sub(r"\s+", " ", s.strip())


def py_int(x):
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def test_clean_text_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, s string")
    got = {r.i: (r.c, r.n) for r in df.select("i", clean_text("s").alias("c"), text_len("s").alias("n")).collect()}
    for i, s in enumerate(ODD):
        assert got[i][0] == py_clean(s), repr(s)
        assert got[i][1] == (None if s is None else len(s))


def test_parse_label_matches_int(spark):
    vals = ["1", "-1", "0", " 1 ", "+1", "007", "1.5", "x", "", "1.0", "　1　", "7", None, "99999999999"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = {r.i: r.p for r in df.select("i", parse_label("v").alias("p")).collect()}
    for i, v in enumerate(vals):
        expect = py_int(v)
        if expect is not None and not (-(2**31) <= expect < 2**31):
            expect = None  # documented: out-of-range integers are not labels
        assert got[i] == expect, repr(v)


def test_remap_and_uid(spark):
    df = spark.createDataFrame([("f.json", "3", -1), ("f.json", None, 0), (None, "x", 5)], "p string, i string, l int")
    rows = df.select(label_remap("l").alias("lab"), uid_key("p", "i").alias("uid")).collect()
    assert [r.lab for r in rows] == [0, 1, None]
    assert [r.uid for r in rows] == ["f.json::3", "f.json::nan", "nan::x"]


def test_token_count_and_truncate(spark):
    df = spark.createDataFrame([("Hello, world! 42x",), ("",)], "t string")
    rows = df.select(token_count("t").alias("n"), truncate_tokens(tokens("t"), 4).alias("tr")).collect()
    assert rows[0].n == 2 + 5  # Hello , world ! 42x
    assert rows[0].tr == ["[CLS]", "Hello", ",", "[SEP]"]
    assert rows[1].n == 2


def test_argmax_and_nll(spark):
    data = [([0.1, 0.7, 0.7], 2), ([3.0, -1.0, 0.0], 0), ([-5.0, -5.0, -4.0], 1)]
    df = spark.createDataFrame(data, "s array<double>, y int")
    rows = df.select(argmax("s").alias("a"), nll("s", "y").alias("l")).collect()
    for (s, y), r in zip(data, rows):
        a = np.array(s)
        assert r.a == int(np.argmax(a))
        expect = np.log(np.exp(a - a.max()).sum()) + a.max() - a[y]
        assert abs(r.l - expect) < 1e-12


def test_is_blank(spark):
    from lexiflow.functions import is_blank

    df = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, s string")
    got = {r.i: r.b for r in df.select("i", is_blank("s").alias("b")).collect()}
    for i, s in enumerate(ODD):
        assert got[i] == (s is not None and s.strip() == ""), repr(s)


def test_strict_label_check_and_position_uid(spark):
    import pytest
    from pyspark.errors import PySparkException

    from lexiflow.operators import prep

    rows = [("f.json", None, "hi", "1", 0), ("f.json", None, "yo", "7", 1), ("f.json", "3", "ok", "-1", 2)]
    df = spark.createDataFrame(rows, "file_path string, review_index string, raw_text string, polarity string, pos int")
    df = df.selectExpr("*", "'d' as domain", "'c' as main_category", "'shop' as source")
    # default: both null-Index rows share uid 'f.json::nan' and the first one is kept
    assert prep.prepare(df).count() == 2
    # 'position' keys null-Index rows by array position instead
    kept = prep.staged(df, null_index="position").select("uid").collect()
    assert sorted(r.uid for r in kept) == ["f.json::#0", "f.json::#1", "f.json::3"]
    with pytest.raises(PySparkException):
        prep.prepare(df, strict=True, null_index="position").collect()


def test_random_strings_match_python(spark):
    """400 seeded random strings over whitespace, letters, digits, signs and symbols."""
    import random

    from lexiflow.functions import is_blank
    from lexiflow.functions.text import WS_CHARS

    rng = random.Random(7)
    alphabet = list(WS_CHARS) + list("abé中١") + list("0123456789+-.") + ["\U0001f600", "​", "­"]
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, s string")
    got = {r.i: r for r in df.select("i", clean_text("s").alias("c"), is_blank("s").alias("b"), parse_label("s").alias("p")).collect()}
    for i, s in enumerate(samples):
        assert got[i].c == py_clean(s), repr(s)
        assert got[i].b == (s.strip() == ""), repr(s)
        expect = py_int(s)
        ascii_int = re.fullmatch(r"\s*[+-]?[0-9]+\s*", s) is not None and re.search("[0-9]", s) is not None
        # documented: only ASCII digits count, and 32-bit range
        if expect is not None and (not ascii_int or not (-(2**31) <= expect < 2**31)):
            expect = None
        assert got[i].p == expect, repr(s)
