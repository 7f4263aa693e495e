"""Label and key expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow.functions.text import INT_WS_CLASS

# Polarity -> model label, label -> display name, valid polarities.
POLARITY_TO_LABEL = {-1: 0, 0: 1, 1: 2}
LABEL_TO_NAME = {0: "부정", 1: "중립", 2: "긍정"}
VALID_POLARITIES = (-1, 0, 1)
NUM_LABELS = 3

# Text accepted as an integer: optional whitespace, sign, ASCII digits.
INT_TEXT = "^" + INT_WS_CLASS + "*[+-]?[0-9]+" + INT_WS_CLASS + "*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_label(col) -> Column:
    """Tolerant integer parse of label text; anything else (e.g. '1.5', 'x') -> null."""
    c = _c(col)
    return F.when(
        c.rlike(INT_TEXT),
        F.regexp_replace(c, INT_WS_CLASS, "").try_cast("int"),
    )


def strict_label(col, where) -> Column:
    """Integer of label text; a label that is none raises an error that names ``where`` it stands."""
    c = _c(col)
    text = F.concat(F.lit("label "), F.coalesce(c, F.lit("null")), F.lit(" is no integer: "), where)
    return F.coalesce(parse_label(c), F.raise_error(text).cast("int"))


def parse_label_variant(col) -> Column:
    """Same rule on a VARIANT value: numbers and booleans truncate, text uses ``parse_label``."""
    v = _c(col)
    as_text = F.try_variant_get(v, "$", "string")
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("int"))
        .when(kind == "STRING", parse_label(as_text))
        .otherwise(F.try_variant_get(v, "$", "int"))
    )


def label_remap(col, mapping: Mapping[int, int] = POLARITY_TO_LABEL) -> Column:
    """Dictionary lookup; keys outside the mapping give null."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), _c(col))


def label_name(col, names: Mapping[int, str] = LABEL_TO_NAME) -> Column:
    return label_remap(col, names)


def uid_key(path_col, index_col, null_index: str = "nan", pos_col=None) -> Column:
    """``file_path::Index`` with pandas' text for missing values ('nan').

    ``null_index='position'`` keys rows without Index by their array position
    instead, so they are no longer collapsed into one uid per file.
    """
    path = F.coalesce(_c(path_col), F.lit("nan"))
    idx = _c(index_col)
    if null_index == "position":
        if pos_col is None:
            raise ValueError("null_index='position' needs pos_col")
        fill = F.concat(F.lit("#"), _c(pos_col).cast("string"))
    else:
        fill = F.lit("nan")
    return F.concat(path, F.lit("::"), F.coalesce(idx, fill))
