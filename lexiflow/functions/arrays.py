"""Array expressions: score vectors and token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow.functions.text import CLS_TOKEN, N_SPECIAL, PAD_TOKEN, SEP_TOKEN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def argmax(col) -> Column:
    """0-based index of the first maximum (numpy ``argmax`` rule)."""
    c = _c(col)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def log_sum_exp(col) -> Column:
    c = _c(col)
    m = F.array_max(c)
    return m + F.log(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def nll(scores, label) -> Column:
    """Negative log-softmax of the true class (cross-entropy of one row)."""
    s = _c(scores)
    return log_sum_exp(s) - F.element_at(s, _c(label) + 1)


def truncate_tokens(tokens_col, max_len: int) -> Column:
    """[CLS] + first (max_len - 2) tokens + [SEP]."""
    keep = max(max_len - N_SPECIAL, 0)
    return F.concat(
        F.array(F.lit(CLS_TOKEN)),
        F.slice(_c(tokens_col), 1, keep),
        F.array(F.lit(SEP_TOKEN)),
    )


def pad_tokens(seq_col, max_len: int) -> Column:
    """Right-pad a token sequence to ``max_len`` with [PAD]."""
    s = _c(seq_col)
    return F.concat(s, F.array_repeat(F.lit(PAD_TOKEN), F.greatest(F.lit(max_len) - F.size(s), F.lit(0))))


def attention_mask(seq_col, max_len: int) -> Column:
    s = _c(seq_col)
    n = F.least(F.size(s), F.lit(max_len))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
