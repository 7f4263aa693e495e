"""Text column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace of Python's str.strip / re \s on str, as
# inclusive code point ranges.
WS_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)

# The same set as a regex class with \x{..} escapes (valid in Java regex and
# in RE2, the DuckDB oracle) and as a plain string of characters.
def regex_class(ranges) -> str:
    return "[" + "".join(f"\\x{{{lo:02x}}}" if lo == hi else f"\\x{{{lo:02x}}}-\\x{{{hi:02x}}}" for lo, hi in ranges) + "]"


WS_CLASS = regex_class(WS_RANGES)
WS_CHARS = "".join(chr(c) for lo, hi in WS_RANGES for c in range(lo, hi + 1))

# Python's int() skips surrounding whitespace too, but not the information
# separators U+001C-001F that str.strip removes.
INT_WS_CLASS = regex_class([(0x09, 0x0D), (0x20, 0x20)] + [r for r in WS_RANGES if r[0] > 0x20])

# One token = a run of letters/digits, or one other non-space character.
# Applied to cleaned text, where the only whitespace left is U+0020.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N} ]"

# Special tokens added around every sequence, and the pad token.
CLS_TOKEN = "[CLS]"
SEP_TOKEN = "[SEP]"
PAD_TOKEN = "[PAD]"
UNK_TOKEN = "[UNK]"
N_SPECIAL = 2


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Non-string/null -> '', collapse Unicode whitespace runs to one space, strip."""
    return F.trim(F.regexp_replace(F.coalesce(_c(col), F.lit("")), WS_CLASS + "+", " "))


def text_len(col) -> Column:
    """Length in code points; null text stays null (never the length of 'nan')."""
    return F.length(_c(col))


def is_blank(col) -> Column:
    """Non-null text that is empty after a Unicode strip."""
    c = _c(col)
    # btrim stops at the first non-space character from each end
    return c.isNotNull() & (F.length(F.btrim(c, F.lit(WS_CHARS))) == 0)


def token_count(col, n_special: int = N_SPECIAL) -> Column:
    """Regex word/punctuation token count plus the special tokens."""
    return F.regexp_count(_c(col), F.lit(TOKEN_PATTERN)) + F.lit(n_special)


def tokens(col) -> Column:
    """Array of regex tokens of (cleaned) text."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 0)
