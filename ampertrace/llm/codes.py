"""Helpers for Python tasks: running numbers for strings, rows in blocks of bounded text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

#: strings that a task keeps before it forgets them all
MOST_CODES = 500_000
#: characters that are worked on at once, where one text is not longer
BLOCK_CHARS = 1 << 21


class Codes(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    """The type that a column must have in batches that go back to Spark."""
    return to_arrow_type(df.schema[name].dataType)


def blocks(batches, text: str) -> Iterator[tuple[list, list[str]]]:
    """Rows of Arrow batches as (other columns of each row, texts); null texts are empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        others = [batch.column(c).to_pylist() for c in batch.schema.names if c != text]
        rows = list(zip(*others)) if others else [()] * len(texts)
        start = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= BLOCK_CHARS or i == len(texts) - 1:
                yield rows[start : i + 1], texts[start : i + 1]
                start, held = i + 1, 0


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
