"""Predicates and rounding on numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(df: DataFrame, name: str) -> Column:
    """True where the column is null, or NaN for the types that have NaN."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def is_valid_nonzero(df: DataFrame, name: str) -> Column:
    """True where the column is present and, if it is numeric, not zero."""
    present = ~is_missing(df, name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return present & (F.col(name) != 0)
    return present


def round_int(column: Column) -> Column:
    """Round half up to a whole number."""
    return F.round(column).cast("int")


def shift_round(column: Column, shift: float) -> Column:
    """Add a constant, then round; used to bring loudness above zero."""
    return round_int(column + F.lit(shift))
