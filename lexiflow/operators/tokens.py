"""Token lengths, truncation tables, max-length choice, vocabulary and WordPiece.

The token count is a built-in expression (regex word/punctuation tokens plus
two special tokens); truncation percentages for all candidate lengths come
from one aggregate of conditional counts (no loop of scans).  WordPiece is
the one operator that needs per-row Python: a greedy longest-match over a
vocabulary whose size is bounded by its parameters, run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.arrays import attention_mask, pad_tokens, truncate_tokens
from lexiflow.functions.text import N_SPECIAL, TOKEN_PATTERN, UNK_TOKEN, token_count, tokens
from lexiflow.sources.tables import materialize

# Candidate maximum lengths of the truncation table.
CANDIDATE_MAX_LENGTHS = (64, 96, 128, 192, 256, 320, 384)
MAX_LENGTH = 192


def with_token_len(df: DataFrame, text: str = "text", out: str = "token_len") -> DataFrame:
    return df.withColumn(out, token_count(F.col(text)).cast("int"))


def _pct(cond, n):
    return F.round(F.count_if(cond) * 100.0 / n, 6)


def truncation_overall(df: DataFrame, candidates: Sequence[int] = CANDIDATE_MAX_LENGTHS, col: str = "token_len") -> DataFrame:
    """(max_length, truncated_pct): share of rows longer than each candidate, one aggregate."""
    c = F.col(col)
    wide = df.agg(*[(_pct(c > ml, F.count(F.lit(1)))).alias(f"t{ml}") for ml in candidates])
    stacked = F.explode(F.array(*[F.struct(F.lit(ml).alias("max_length"), F.col(f"t{ml}").alias("truncated_pct")) for ml in candidates]))
    return wide.select(stacked.alias("s")).select("s.max_length", "s.truncated_pct")


#: lengths of one bucket of the truncation curve
_BUCKET = 4096


def truncation_curve(df: DataFrame, thresholds: DataFrame, col: str = "token_len") -> DataFrame:
    """(max_length, n_over, truncated_pct) for every row of a table of integer thresholds (column ``max_length``).

    Any number of thresholds costs one scan: lengths are counted per value, thresholds are laid
    among the values, and the rows over a threshold are a running sum from the longest value
    down.  Values are summed in buckets of lengths, and buckets, of which there are at most
    2^31 / 4096, on top.  Null thresholds are left out, repeated ones count once.
    """
    lengths = materialize(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "length-counts")
    asked = thresholds.select(F.col("max_length").cast("long").alias("_v")).dropna().distinct()
    rows = lengths.select("_v", "_c", F.lit(1).alias("_kind")).unionByName(asked.select("_v", F.lit(0).cast("long").alias("_c"), F.lit(0).alias("_kind")))
    rows = rows.withColumn("_bucket", F.floor(F.col("_v") / _BUCKET))
    here = Window.partitionBy("_bucket").orderBy(F.desc("_v"), F.asc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_over", F.sum("_c").over(here)).where("_kind = 0")
    buckets = rows.groupBy("_bucket").agg(F.sum("_c").alias("_c"))
    above = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    higher = buckets.select("_bucket", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_higher"))
    n = lengths.agg(F.sum("_c")).scalar()
    over = F.col("_over") + F.col("_higher")
    return inside.join(higher, "_bucket").select(F.col("_v").cast("int").alias("max_length"), over.alias("n_over"), F.round(over * 100.0 / n, 6).alias("truncated_pct"))


def truncation_by(df: DataFrame, by: str, candidates: Sequence[int] = CANDIDATE_MAX_LENGTHS, col: str = "token_len") -> DataFrame:
    """Per group (null group dropped): count and ``trunc_<ml>`` percentages."""
    c = F.col(col)
    n = F.count(F.lit(1))
    return (
        df.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(n.alias("count"), *[_pct(c > ml, n).alias(f"trunc_{ml}") for ml in candidates])
    )


def recommend_max_length(
    df: DataFrame, candidates: Sequence[int] = CANDIDATE_MAX_LENGTHS, limit_pct: int = 5, col: str = "token_len"
) -> DataFrame:
    """First candidate whose truncated share is <= limit_pct %, else the last one.
    Compared in integers (100 * over <= limit * n), so no rounding decides it."""
    c = F.col(col)
    over = [F.count_if(c > ml).alias(f"o{ml}") for ml in candidates]
    agg = df.agg(F.count(F.lit(1)).alias("n"), *over)
    ok = [F.when(F.col(f"o{ml}") * 100 <= limit_pct * F.col("n"), F.lit(ml)) for ml in candidates]
    rec = F.coalesce(*ok, F.lit(candidates[-1]))
    pct_at = F.coalesce(*[F.when(rec == ml, F.col(f"o{ml}") * 100.0 / F.col("n")) for ml in candidates])
    return agg.select(rec.cast("int").alias("recommended_max_length"), F.round(pct_at, 6).alias("truncated_pct"), F.col("n"))


def with_truncated(df: DataFrame, max_len: int = MAX_LENGTH, text: str = "text") -> DataFrame:
    """Token sequence cut to ``max_len`` including [CLS]/[SEP]."""
    return df.withColumn("input_tokens", truncate_tokens(tokens(F.col(text)), max_len))


def pad_features(df: DataFrame, max_len: int = MAX_LENGTH, text: str = "text") -> DataFrame:
    """Fixed-length ``input_tokens`` padded with [PAD] plus ``attention_mask``."""
    d = with_truncated(df, max_len, text)
    return d.withColumn("attention_mask", attention_mask("input_tokens", max_len)).withColumn(
        "input_tokens", pad_tokens("input_tokens", max_len)
    )


def padding_share(df: DataFrame, max_len: int = MAX_LENGTH, col: str = "token_len") -> DataFrame:
    """Real and pad positions when every row is padded (or cut) to ``max_len``."""
    real = F.least(F.col(col), F.lit(max_len))
    d = df.agg(F.count(F.lit(1)).alias("n"), F.sum(real).alias("real_tokens"))
    pad = F.col("n") * max_len - F.col("real_tokens")
    return d.select(
        "n",
        F.lit(max_len).alias("max_length"),
        F.col("real_tokens").cast("bigint").alias("real_tokens"),
        pad.cast("bigint").alias("pad_tokens"),
        F.round(pad * 100.0 / (F.col("n") * max_len), 6).alias("padding_pct"),
    )


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over the corpus: explode + grouped count (combines map-side)."""
    return df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Top-n tokens by frequency (ties by token) with rank; the limit is the feature."""
    top = token_counts(df, text).orderBy(F.desc("n"), F.asc("token")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token"))).cast("int"))


def wordpiece_vocab(df: DataFrame, n_words: int = 8000, n_chars: int = 2000, text: str = "text") -> DataFrame:
    """A WordPiece vocabulary: top words, top characters, and every kept character
    as a continuation piece '##c'.  Size <= n_words + 2 * n_chars by construction.
    Characters are counted on the distinct-token table, weighted by frequency."""
    counts = token_counts(df, text)
    words = counts.orderBy(F.desc("n"), F.asc("token")).limit(n_words).select(F.col("token").alias("piece"))
    chars = (
        counts.select(F.explode(F.regexp_extract_all("token", F.lit("(?s)."), 0)).alias("ch"), "n")
        .groupBy("ch")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), F.asc("ch"))
        .limit(n_chars)
    )
    pieces = chars.select(F.col("ch").alias("piece")).unionByName(chars.select(F.concat(F.lit("##"), "ch").alias("piece")))
    return words.unionByName(pieces).distinct()


def subword_ids(df: DataFrame, tokenizer_path: str, max_len: int | None = None, text: str = "text", ids: str = "input_ids", length: str = "subword_len") -> DataFrame:
    """Ids of a published subword tokenizer, and how many there are before they are cut to ``max_len``.

    ``tokenizer_path`` is a file of the ``tokenizers`` library that the driver can read; its
    content (bounded by ``MAX_TOKENIZER_BYTES``) goes to the tasks, which need the library but not
    the file.  Batches are Arrow batches of texts, encoded ``ENCODE_CHARS`` characters (or one text)
    at a time: an encoding takes many times its text.  Null texts have null ids.  Tokenizers are
    used as published, with their own special tokens left out, and never trained.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        body = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(body) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} has more than {MAX_TOKENIZER_BYTES} characters")
    bc = df.sparkSession.sparkContext.broadcast(body)
    most = ENCODE_CHARS

    @F.pandas_udf("struct<ids:array<int>,n:int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(bc.value)
        tok.no_truncation()
        tok.no_padding()
        tok.encode_special_tokens = True
        for texts in batches:
            part = texts.str.len().fillna(0).astype("int64").cumsum() // most
            for _, some in texts.groupby(part.to_numpy(), sort=False):
                found = iter(tok.encode_batch_fast([t for t in some if t is not None], add_special_tokens=False))
                all_ids = [next(found).ids if t is not None else None for t in some]
                yield pd.DataFrame({"ids": [i if i is None else i[:max_len] for i in all_ids], "n": pd.array([None if i is None else len(i) for i in all_ids], dtype="Int32")})

    return df.withColumn("_e", encode(F.col(text))).withColumns({ids: F.col("_e.ids"), length: F.col("_e.n")}).drop("_e")


#: characters of texts whose encodings a task holds at once
ENCODE_CHARS = 1 << 18

#: greatest size of a tokenizer file that goes to the tasks
MAX_TOKENIZER_BYTES = 64 << 20

#: pieces of a vocabulary that tasks hold in memory; more raise an error
MAX_PIECES = 1_000_000


def wordpiece_len(df: DataFrame, vocab: DataFrame, text: str = "text", max_chars: int | None = 100, out: str = "wp_len") -> DataFrame:
    """WordPiece token count (+2 specials) per row, greedy longest match first.

    The vocabulary is collected once (more than ``MAX_PIECES`` pieces raise) and
    shipped with the Arrow UDF; the per-row work stays on the executors in Arrow
    batches.  The UDF is self-contained (no reference to this package), so executors
    need only pandas and regex.  A word of more than ``max_chars`` characters is one
    [UNK], the usual WordPiece rule; None turns it off.
    """
    rows = vocab.select("piece").limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"the vocabulary has more than {MAX_PIECES} pieces")
    pieces = frozenset(r[0] for r in rows) - {UNK_TOKEN}
    return df.withColumn(out, wordpiece_udf(pieces, max_chars)(F.col(text)))


def wordpiece_udf(pieces: frozenset, max_chars: int | None = 100):
    """Arrow UDF: text -> WordPiece count (+2 specials) over the given pieces."""
    pattern = TOKEN_PATTERN
    n_special = N_SPECIAL

    def count_pieces(word: str) -> int:
        """Greedy longest-match-first; a word with no match at some point is one [UNK]."""
        if max_chars is not None and len(word) > max_chars:
            return 1
        n, start = 0, 0
        while start < len(word):
            end = len(word)
            while end > start:
                sub = word[start:end] if start == 0 else "##" + word[start:end]
                if sub in pieces:
                    break
                end -= 1
            if end == start:
                return 1
            n += 1
            start = end
        return n

    @F.pandas_udf("int")
    def _wp(texts: pd.Series) -> pd.Series:
        import regex

        rx = regex.compile(pattern)
        memo: dict[str, int] = {}
        res = []
        for t in texts:
            if t is None:
                res.append(None)
                continue
            total = n_special
            for w in rx.findall(t):
                k = memo.get(w)
                if k is None:
                    k = count_pieces(w)
                    if len(memo) < 200_000:
                        memo[w] = k
                total += k
            res.append(total)
        return pd.Series(res, dtype="Int32")

    return _wp
