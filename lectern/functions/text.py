"""Whole batches of text as arrays of code points."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa

_NOT_WORD = re.compile(r"[\W_]+")


def texts_of(column: pa.Array) -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [t or "" for t in column.to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a batch one after another, and where each text starts (one more entry than texts)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32), bounds


def letters_and_digits(text: str) -> str:
    """Text without case, width, white space and punctuation."""
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", text).casefold())
