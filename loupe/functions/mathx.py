"""Numeric expressions (MTH*) with the notebook semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col, digits: int = 0) -> Column:
    """numpy/pandas ``round``: half to even."""
    return F.bround(F.col(col) if isinstance(col, str) else col, digits)


def safe_log(col) -> Column:
    """Natural log; non-positive input -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c > 0, F.ln(c))
