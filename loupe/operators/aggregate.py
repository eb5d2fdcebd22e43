"""Grouping, counting, pivots, shares, sorting and top-k (AGG*, SRT*, WIN10).

All aggregations are hash aggregates with a partial (map-side) stage, so
a hot key is pre-combined before the shuffle.  Top-k uses ``orderBy().limit``
(TakeOrderedAndProject: k rows per partition) and top-n per class uses a
``row_number`` filter that Spark turns into a partial WindowGroupLimit before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def not_null_keys(df: DataFrame, keys) -> DataFrame:
    """pandas drops null group keys; do the same before grouping."""
    cond = None
    for k in _cols(keys):
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)


def value_counts(df: DataFrame, keys, out: str = "count", ordered: bool = True) -> DataFrame:
    """Counts of non-null key combinations (order: count desc, key asc, unless
    something else is computed from them)."""
    ks = _cols(keys)
    c = not_null_keys(df, ks).groupBy(*ks).agg(F.count(F.lit(1)).alias(out))
    return c.orderBy(F.col(out).desc(), *ks) if ordered else c


def group_count(df: DataFrame, keys, col: str, out: str = "count") -> DataFrame:
    """``groupby(k)[c].count()``: non-null values of ``col`` per group."""
    ks = _cols(keys)
    return not_null_keys(df, ks).groupBy(*ks).agg(F.count(col).alias(out))


def group_size(df: DataFrame, keys, out: str = "size") -> DataFrame:
    ks = _cols(keys)
    return not_null_keys(df, ks).groupBy(*ks).agg(F.count(F.lit(1)).alias(out))


def group_agg(df: DataFrame, keys, aggs: dict[str, Column]) -> DataFrame:
    ks = _cols(keys)
    return not_null_keys(df, ks).groupBy(*ks).agg(*[c.alias(n) for n, c in aggs.items()])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    num = ("int", "bigint", "smallint", "tinyint", "double", "float")
    return [c for c, t in df.dtypes if (t in num or t.startswith("decimal")) and c not in exclude]


def group_sum_numeric(df: DataFrame, keys, suffix: str = "") -> DataFrame:
    """Sums of the numeric columns in each group; whole numbers are summed as
    decimals of 38 digits, which a large table does not overflow."""
    ks = _cols(keys)
    whole = {c for c, t in df.dtypes if t in ("bigint", "int", "smallint", "tinyint")}
    cols = numeric_columns(df, ks)
    return not_null_keys(df, ks).groupBy(*ks).agg(*[
        F.sum(F.col(c).cast("decimal(38,0)") if c in whole else F.col(c)).alias(c + suffix) for c in cols])


def grouping_sets_mean(df: DataFrame, dims: Sequence[str], measure: str,
                       out: str = "mean") -> DataFrame:
    """Mean of ``measure`` by each of several dimensions in ONE pass
    (GROUPING SETS), returned long: (dimension, value, mean, n)."""
    sets = [[F.col(d)] for d in dims]
    g = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.avg(measure).alias(out), F.count(measure).alias("n"),
        F.grouping_id().alias("_gid"))
    n = len(dims)
    # grouping_id has bit (n-1-i) clear for the dimension i that is grouped.
    dim_name = F.lit(None).cast("string")
    dim_val = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        dim_name = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(dim_name)
        dim_val = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(dim_val)
    return g.select(dim_name.alias("dimension"), dim_val.alias("value"), out, "n")


def grouping_sets_ratio(df: DataFrame, dims: Sequence[str], sums: str, counts: str,
                        out: str = "mean") -> DataFrame:
    """Like ``grouping_sets_mean`` over pre-aggregated rows holding partial
    sums and counts: mean = sum(sums) / sum(counts), n = sum(counts)."""
    sets = [[F.col(d)] for d in dims]
    g = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        (F.sum(sums) / F.sum(counts)).alias(out), F.sum(counts).alias("n"), F.grouping_id().alias("_gid"))
    n = len(dims)
    dim_name = F.lit(None).cast("string")
    dim_val = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        dim_name = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(dim_name)
        dim_val = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(dim_val)
    return g.select(dim_name.alias("dimension"), dim_val.alias("value"), out, "n")


def wide_counts(df: DataFrame, row: str, col: str, by_frequency: bool = False) -> tuple[DataFrame, list]:
    """Counts as a table with one column for each value of ``col``, and those
    values in order (or from the most frequent on).

    The facts are counted once, in long form; the list of values and the wide
    table come from the stored counts.  The list has one entry for each column
    of the result."""
    from loupe.session import stored
    c = stored(not_null_keys(df, [row, col]).groupBy(row, col).agg(F.count(F.lit(1)).alias("_n")), "counts")
    totals = c.groupBy(col).agg(F.sum("_n").alias("_t"))
    values = [x[0] for x in totals.orderBy(*([F.col("_t").desc()] if by_frequency else []), col).collect()]
    p = c.groupBy(row).pivot(col, values).agg(F.sum("_n"))
    return p.fillna(0, subset=[f"`{v}`" for v in values]), values


def share_of_total(counts: DataFrame, count_col: str = "count", out: str = "share",
                   scale: float = 1.0, digits: int | None = None) -> DataFrame:
    """count / grand total.  The counts are stored, so that the facts are read
    once; the total is one value attached as a literal, not a global window
    that would pull rows into one task."""
    from loupe.session import stored
    counts = stored(counts, "counts")
    tot = counts.agg(F.sum(count_col).alias("_tot"))
    share = F.col(count_col) * F.lit(scale) / F.col("_tot")
    if digits is not None:
        share = F.bround(share, digits)
    from loupe.operators.scalars import with_scalars
    return with_scalars(counts, tot).withColumn(out, share).drop("_tot")


def share_within(counts: DataFrame, group: str, count_col: str = "count",
                 out: str = "share") -> DataFrame:
    """count / total of its group (row-normalised contingency table, long)."""
    tot = counts.groupBy(group).agg(F.sum(count_col).alias("_tot"))
    return (counts.join(tot, group).withColumn(out, F.col(count_col) / F.col("_tot"))
            .drop("_tot"))


def row_sum(cols: Sequence[str]) -> Column:
    """Row-wise sum of columns as one expression (nulls count as 0)."""
    expr = F.lit(0)
    for c in cols:
        expr = expr + F.coalesce(F.col(c), F.lit(0))
    return expr


def mean_ci(df: DataFrame, keys, measure: str, z: float = 1.96) -> DataFrame:
    """Mean with a normal-approximation confidence interval per group."""
    ks = _cols(keys)
    g = not_null_keys(df, ks).groupBy(*ks).agg(
        F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("_sd"),
        F.count(measure).alias("n"))
    half = F.lit(z) * F.col("_sd") / F.sqrt(F.col("n"))
    return g.select(*ks, "n", "mean", (F.col("mean") - half).alias("ci_low"),
                    (F.col("mean") + half).alias("ci_high"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k: sort + limit, planned as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(k)


def top_n_per_group(df: DataFrame, group, order: Sequence[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """First n rows per group by ``order`` (ties must be broken by the caller
    with a key); Spark adds a partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(*_cols(group)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def argmax_row(df: DataFrame, key: str, measure: str, group=None) -> DataFrame:
    """Member with the largest measure (ties -> smallest key), globally or
    per group.  Global: top-1 (TakeOrderedAndProject).  Per group: a
    ``row_number`` limit, which Spark pre-limits before the shuffle."""
    order = [F.col(measure).desc_nulls_last(), F.col(key).asc()]
    if group is None:
        return df.select(key, measure).orderBy(*order).limit(1)
    gs = _cols(group)
    return (top_n_per_group(df.select(*gs, key, measure), gs, order, 1, "_r")
            .drop("_r"))


def order_by_frequency(df: DataFrame, key: str) -> DataFrame:
    """Attach each value's frequency rank (1 = most frequent)."""
    vc = not_null_keys(df, key).groupBy(key).agg(F.count(F.lit(1)).alias("freq"))
    from loupe.operators.series import position
    return position(vc, [F.col("freq").desc(), F.col(key)], out="freq_rank", start=1).withColumn("freq_rank", F.col("freq_rank").cast("int"))


def slice_rows(df: DataFrame, order: Sequence[Column], start: int, stop: int) -> DataFrame:
    """Rows [start, stop) in ``order`` (positional ``iloc`` after a sort).

    Implemented as top-``stop`` (bounded) followed by dropping the first
    ``start`` rows, so only ``stop`` rows ever leave the partitions."""
    top = df.orderBy(*order).limit(stop)
    w = Window.orderBy(*order)
    return top.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") > start).drop("_pos")
