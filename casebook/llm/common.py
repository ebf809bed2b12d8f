"""What several operators of this package share: word rule, stored tables, byte views of text columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.session import apply_settings, work_folder

# A word is a run of characters other than these six.  `bytes.split()`
# splits UTF-8 text at exactly the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new table in the shared folder and read it from there.

    Cuts lineage: what follows survives lost executors without computing `df` again.
    """
    spark = apply_settings(df.sparkSession)
    folder = work_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def as_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; a null is empty."""
    return [value or b"" for value in array.cast(pa.large_binary()).to_pylist()]


def portions(texts: list[bytes], size: int = 1_000_000) -> Iterator[slice]:
    """Runs of texts of about `size` bytes together, at least one text each."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
