"""Scalar column functions."""

from lexiflow.functions.arrays import argmax, attention_mask, nll, pad_tokens, truncate_tokens  # noqa: F401
from lexiflow.functions.labels import (  # noqa: F401
    LABEL_TO_NAME,
    NUM_LABELS,
    POLARITY_TO_LABEL,
    VALID_POLARITIES,
    label_name,
    label_remap,
    parse_label,
    parse_label_variant,
    uid_key,
)
from lexiflow.functions.text import (  # noqa: F401
    TOKEN_PATTERN,
    WS_CLASS,
    clean_text,
    is_blank,
    text_len,
    token_count,
    tokens,
)
