"""Attach a handful of statistics to every row without a join.

Table-wide statistics (a mean, a total, quantile boundaries) form a single
row of a fixed number of values.  They are fetched to the driver — a few
numbers, never data-sized — and added as literal columns, so the per-row
step stays a narrow projection (no cross join, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scalars(stats: DataFrame) -> dict:
    """The single row of ``stats`` as a dict (no row -> all None)."""
    rows = stats.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("expected one statistics row, got more")
    if not rows:  # e.g. the mode of an all-null column: nothing to attach
        return {c: None for c in stats.columns}
    return rows[0].asDict(recursive=False)


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` plus one literal column per value of the one-row ``stats``."""
    vals = scalars(stats)
    types = dict(stats.dtypes)
    return df.select("*", *[F.lit(v).cast(types[k]).alias(k) for k, v in vals.items()])
