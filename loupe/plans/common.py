"""Shared helpers for binding operators to the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed rule: the generated tables hold no nulls, so null-handling queries
# blank a column on every row whose key is a multiple of 7 (the oracle SQL
# applies the same rule).
NULL_EVERY = 7


def null_when(col: str, key: str, every: int = NULL_EVERY) -> Column:
    return F.when(F.col(key) % every == 0, F.lit(None)).otherwise(F.col(col)).alias(col)


def inject_nulls(df: DataFrame, cols, key: str, every: int = NULL_EVERY) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.select(*[null_when(c, key, every) if c in cols else F.col(c) for c in df.columns])


def r(col, digits: int = 6) -> Column:
    """Round a double for comparison: sign(x) * floor(|x| * 10^d + 0.5) / 10^d,
    computed in binary floating point (not on the decimal text, as
    ``F.round`` does), so identical doubles round identically in any engine
    that rounds this way."""
    c = F.col(col) if isinstance(col, str) else col
    m = float(10 ** digits)
    return (F.signum(c) * F.floor(F.abs(c) * F.lit(m) + F.lit(0.5)) / F.lit(m)).cast("double")


def day(col: str) -> Column:
    """timestamp_ntz -> date."""
    return F.to_date(F.col(col))
