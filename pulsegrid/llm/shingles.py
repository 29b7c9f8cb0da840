"""Words, shingle hashes and sliding minima as native array expressions.

A chain of these must go through ``steps``: one projection per array, since a
column that is used twice in one expression would be computed twice. For the
same reason nothing here may be filtered or exploded with an inferred filter;
use ``posexplode_outer``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: str | Column) -> Column:
    """Lower-case A-Z alone; ``lower`` does the same where all bytes are ASCII, only faster."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: str | Column, separators: str) -> Column:
    """The runs between ``separators`` (a regular expression); null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def ahead(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def trim(array: Column, length: Column) -> Column:
    return F.slice(array, 1, F.greatest(length, F.lit(0)))


def steps(df: DataFrame, column: str, *parts: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``column`` replaced by each part in turn, one projection each."""
    for part in parts:
        df = df.withColumn(column, part(F.col(column)))
    return df


def pair(by: int, f: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.zip_with(a, ahead(a, by), f)


def _spans(size: int) -> list[int]:
    """Offsets that double a span of one until it is ``size`` wide."""
    out, wide = [], 1
    while 2 * wide <= size:
        out.append(wide)
        wide *= 2
    return out + ([size - wide] if wide < size else [])


def grams(df: DataFrame, column: str, size: int, out: str) -> DataFrame:
    """``out``: the hash of each run of ``size`` words of ``column``, by start.

    Hashes of 1, 2, 4, ... words are paired, so that the work is a few passes
    whatever the size. Arrays of fewer words give an empty array.
    """
    df = df.withColumn(out, F.transform(column, lambda w: F.xxhash64(w)))
    df = steps(df, out, *[pair(by, lambda a, b: F.xxhash64(a, b)) for by in _spans(size)])
    return df.withColumn(out, trim(F.col(out), F.size(column) - (size - 1)))


def minima(df: DataFrame, column: str, size: int) -> DataFrame:
    """``column`` replaced by the least of each run of ``size`` values."""
    df = steps(df, column, *[pair(by, lambda a, b: F.least(a, b)) for by in _spans(size)])
    return steps(df, column, lambda a: trim(a, F.size(a) - (size - 1)))
