"""Numeric coercion and binning expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that counts as a number; everything else (also ``nan`` and ``12d``) is missing.
_NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)\s*$"


def to_number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a number, missing where the text is not one.

    A column that is numeric already keeps its type.
    """
    col = F.col(f"`{name}`")
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    if isinstance(dtype, T.NumericType):
        return col
    return F.when(col.rlike(_NUMBER), F.trim(col).try_cast("double"))


def floor_bin(col: Column, width: int) -> Column:
    """Lower edge of the bin of ``width`` that holds ``col``; rounds down below zero too."""
    return (col - F.pmod(col, F.lit(width))).cast("long")


def epoch_ms_to_timestamp(col: Column) -> Column:
    """Epoch milliseconds, whole or fractional, to a timestamp."""
    return F.timestamp_micros((col * 1000).cast("long"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, NULL for an empty whole."""
    return 100.0 * part / F.nullif(whole, F.lit(0))


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a zone."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))
