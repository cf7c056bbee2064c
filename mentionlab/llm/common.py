"""What the operators of this subpackage share: text rules, written tables, fresh column names."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionlab.session import forget, fresh, shared_dir, table, written  # noqa: F401

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def identified(docs: DataFrame, doc_id: str, name: str) -> tuple[DataFrame, str]:
    """docs with a column that tells each row from all others, and that column's name: the id where every row has one of
    its own, else a number, for which docs are written. So rows that repeat an id or have none can be told apart."""
    (row,) = fresh(docs, "row")
    told = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(doc_id).alias("ids")).first()
    if told.n == told.ids:
        return docs.withColumn(row, F.col(doc_id)), row
    return numbered(docs, name, row), row


def numbered(docs: DataFrame, name: str, row: str | None = None) -> DataFrame:
    """docs, written, with a number of each row's own."""
    return written(docs.withColumn(row or fresh(docs, "row")[0], F.monotonically_increasing_id()), name)


def text_of(col: str | Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def n_words_of(text: Column) -> Column:
    """How many words a text has, without building them: each begins where a word character follows white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def released(run):
    """A batch function that gives its freed memory back to the system when a task ends: idle workers stay small."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped
