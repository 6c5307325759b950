"""Token counts: texts are encoded in Arrow batches and only lengths come back.

Within an Arrow batch the texts are dealt into calls of about `CALL_BYTES` each, so one call never holds many long texts, and a text
longer than `PIECE_CHARS` is cut at safe boundaries: before a space that stands between two ASCII letters. Byte-level
pre-tokenisation always starts a new token there, and no special token contains a space, so counts add up exactly. A long text
without such a place stays whole.

Nulls: a null text is empty and has no tokens. Repeated rows are counted each; an empty table gives an empty result. The count is a
column expression, so other columns are untouched.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

PIECE_CHARS = 1 << 16
CALL_BYTES = 1 << 20
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def cut_safely(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text in pieces of about `size` characters, cut at safe boundaries only."""
    out, at = [], 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.start()
    return out + [text[at:]]


def lengths(texts: list[str], path: str) -> np.ndarray:
    """Token counts of some texts."""
    t = tokenizer(path)
    counts = np.zeros(len(texts), np.int64)
    owners, pieces, held = [], [], 0

    def flush():
        if pieces:
            np.add.at(counts, owners, [len(e.ids) if not hasattr(e, "__len__") else len(e) for e in t.encode_batch_fast(pieces, add_special_tokens=False)])

    for i, text in enumerate(texts):
        for piece in cut_safely(text):
            owners.append(i)
            pieces.append(piece)
            held += len(piece)
            if held > CALL_BYTES:
                flush()
                owners, pieces, held = [], [], 0
    flush()
    return counts


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text as the library counts them without added special tokens."""
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(lengths(texts.fillna("").tolist(), path))
    return count(text)
