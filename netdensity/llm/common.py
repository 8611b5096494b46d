"""Column helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def free(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with so many underscores before them that no column of ``docs`` has them, in any case."""
    taken, lead = {c.lower() for c in docs.columns}, "__"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)),
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(text: Column, chars: str) -> Column:
    """``text`` with every one of ``chars`` taken out."""
    return F.translate(text, chars, "")


def lean(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """All rows in slices of about ``size`` bytes of a text column besides their first text, which may be of any length.

    A batch may hold all rows of a task; what is made of a slice does not grow with it. Python workers live on between tasks, so
    at the end freed memory goes back to the system.
    """
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(), dtype=np.int64)
        cut = (np.flatnonzero(np.diff(upto // size)) + 1).tolist()
        for x, y in zip([0, *cut], [*cut, len(b)]):
            yield b.slice(x, y - x)
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc's
        libc.malloc_trim(0)
