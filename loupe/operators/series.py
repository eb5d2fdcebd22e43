"""Ordered / time-series operators (WIN*, PRJ10, TSF*, DTE7, FIL10).

Every ordered operator takes ``keys``: windows are ``partitionBy(keys)``, so
many series spread over the cluster.  A long series is cut into ranges of its
order (``ranked``) or blocks with a halo (``halo_window``), so that no task
sorts all of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loupe.operators.scalars import with_scalars
from loupe.session import stored


def _keys(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def daily(df: DataFrame, ts: str, value: Column, keys=None, out: str = "y") -> DataFrame:
    """Aggregate facts to one row per (keys, day): ``ds`` date + ``out``."""
    ks = _keys(keys)
    return df.groupBy(*ks, F.to_date(F.col(ts)).alias("ds")).agg(value.alias(out))


def with_lags(df: DataFrame, value: str, order: str, lags: Sequence[int], keys=None,
              fmt: str = "{v}_lag_{k}") -> DataFrame:
    """All requested lags at once.  A series is cut into blocks with a halo
    (``halo_window``), so that a long one is not sorted in one task."""
    return halo_window(df, order, keys, -max([0, *lags]), max([0, *[-k for k in lags]]),
                       lambda w: [F.lag(value, k).over(w).alias(fmt.format(v=value, k=k)) for k in lags])


def rolling(df: DataFrame, value: str, order: str, n: int | Sequence[int], keys=None, min_periods: int | None = None,
            stats: Sequence[str] = ("mean",), centered: bool = False, prefix: str | None = None) -> DataFrame:
    """Row-count window of ``n`` rows, trailing or centred; several lengths
    share one pass.

    ``min_periods`` (default ``n``, pandas' default) is the number of non-null
    values required; fewer gives NULL.  ``std`` is the sample std.  A centred
    window of n rows reaches (n - 1) // 2 rows ahead, as in pandas.  A series
    is cut into blocks with a halo (``halo_window``)."""
    lengths = [n] if isinstance(n, int) else list(n)
    fn = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}
    ahead = {m: (m - 1) // 2 if centered else 0 for m in lengths}

    def exprs(w):
        out = []
        for m in lengths:
            wf = w.rowsBetween(ahead[m] - (m - 1), ahead[m])
            enough = F.count(value).over(wf) >= (m if min_periods is None else min_periods)
            out += [F.when(enough, fn[s](value).over(wf)).alias(f"{prefix or f'{value}_roll{m}'}_{s}") for s in stats]
        return out
    return halo_window(df, order, keys, min(ahead[m] - (m - 1) for m in lengths), max(ahead.values()), exprs)


def ranked(df: DataFrame, order, keys=None, out: str = "rank") -> DataFrame:
    """0-based rank of every row in its series, and ``_part``, the range of the
    order that holds it.

    Rows are range-partitioned and sorted by (keys, order) and written with
    their partition and place; a series' rank starts where its rows in earlier
    partitions end.  Neither the table nor a long series is in one task.  Rows
    with equal order get different ranks."""
    ks, spark = _keys(keys), df.sparkSession
    by = [*ks, *([order] if isinstance(order, (str, Column)) else order)]
    x = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    x = stored(x.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    runs = x.groupBy("_part", *ks).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    if ks:
        w = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.select("_part", *ks, (F.coalesce(F.sum("_rows").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
        same = [F.col("x._part") == F.col("s._part"), *[F.col(f"x.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ks]]
        return x.alias("x").join(runs.alias("s"), same).select(
            *[f"x.`{c}`" for c in x.columns if c != "_place"], (F.col("x._place") + F.col("s._shift")).alias(out))
    shifts, total = [], 0
    for r in runs.orderBy("_part").collect():  # one row a partition
        shifts.append((r["_part"], total - r["_first"]))
        total += r["_rows"]
    if not shifts:
        return x.withColumn(out, F.col("_place")).drop("_place")
    shifts = F.broadcast(spark.createDataFrame(shifts, "_part int, _shift long"))
    return x.join(shifts, "_part").withColumn(out, F.col("_place") + F.col("_shift")).select(*df.columns, "_part", out)


def position(df: DataFrame, order, keys=None, out: str = "t", start: int = 0) -> DataFrame:
    """0-based (or ``start``-based) position in time order, per series."""
    return ranked(df, order, keys, out).withColumn(out, (F.col(out) + start).cast("long")).drop("_part")


def fill_forward(df: DataFrame, order: str, cols: Sequence[str], present: Column, keys=None) -> DataFrame:
    """``cols`` of rows that are not ``present`` take the last present row's
    values.

    Ranges of the order are filled apart, and what their last present row
    holds is handed on to the following ranges: a series of any length is
    filled without a window over all of it."""
    ks = _keys(keys)
    x = ranked(df.withColumn("_row", F.when(present, F.struct(*cols))), order, ks, "_rank")
    inner = Window.partitionBy("_part", *ks).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.last("_row", ignorenulls=True).over(inner))
    last = stored(x.groupBy("_part", *ks).agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_rank"))).alias("_last")), "last")
    if ks:
        before = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        last = last.select("_part", *ks, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    else:
        rows, carry = [], None
        for r in last.orderBy("_part").collect():  # one row a partition
            rows.append((r["_part"], carry))
            carry = carry if r["_last"] is None else r["_last"]
        kind = StructType([StructField("_part", IntegerType()), StructField("_carry", last.schema["_last"].dataType)])
        last = F.broadcast(df.sparkSession.createDataFrame(rows, kind))
    same = [F.col("x._part") == F.col("l._part"), *[F.col(f"x.{k}").eqNullSafe(F.col(f"l.{k}")) for k in ks]]
    j = x.alias("x").join(last.alias("l"), same).withColumn("_f", F.coalesce("x._in", "l._carry"))
    return j.select(*[f"x.`{c}`" for c in df.columns if c not in cols], *[F.col(f"_f.{c}").alias(c) for c in cols])


def calendar(bounds: DataFrame, start: str, stop: str, step_days: int = 1, keys=None,
             out: str = "ds") -> DataFrame:
    """Explode one row per (keys) into its dates from ``start`` to ``stop``."""
    ks = _keys(keys)
    seq = F.sequence(F.col(start), F.col(stop), F.expr(f"INTERVAL {step_days} DAYS"))
    return bounds.select(*ks, F.explode(seq).alias(out))


def resample_weekly(df: DataFrame, ds: str, value: str, keys=None, how: str = "mean",
                    out: str = "y") -> DataFrame:
    """Calendar weeks ending Sunday, labelled with that Sunday; weeks without
    rows appear with NULL, for sums and counts with 0, as in pandas."""
    ks = _keys(keys)
    lab = F.date_add(F.to_date(F.date_trunc("week", F.col(ds))), 6)
    fn = {"mean": F.avg, "sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[how]
    agg = df.groupBy(*ks, lab.alias("week")).agg(fn(value).alias(out))
    bounds = agg.groupBy(*ks).agg(F.min("week").alias("_lo"), F.max("week").alias("_hi"))
    cal = calendar(bounds, "_lo", "_hi", 7, ks, "week")
    full = cal.join(agg, ks + ["week"], "left")
    return full.withColumn(out, F.coalesce(F.col(out), F.lit(0))) if how in ("sum", "count") else full


def asfreq_pad(df: DataFrame, ds: str, cols: Sequence[str], keys=None) -> DataFrame:
    """Daily calendar; dates missing from the input take the last present
    row's values (nulls inside present rows stay null)."""
    ks = _keys(keys)
    bounds = df.groupBy(*ks).agg(F.min(ds).alias("_lo"), F.max(ds).alias("_hi"))
    cal = calendar(bounds, "_lo", "_hi", 1, ks, ds)
    j = cal.join(df.withColumn("present", F.lit(True)), ks + [ds], "left").withColumn("present", F.col("present").isNotNull())
    return fill_forward(j, ds, cols, F.col("present"), ks).select(*ks, ds, "present", *cols)


def cumulative_sum(df: DataFrame, order: str, value, keys=None, out="cum") -> DataFrame:
    """Running sum(s) in ``order`` that stay distributed for any number of rows.

    Rows are summed within ranges of the order (``ranked``); each range adds
    what its series has in earlier ones.  No window spans a whole table or a
    long series.  ``value``/``out`` may be lists to accumulate several columns
    at once; the source is scanned once."""
    ks = _keys(keys)
    vals = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    x = ranked(df, order, ks, "_rank")
    inner = Window.partitionBy("_part", *ks).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.sum(v).over(inner).alias(f"_in{i}") for i, v in enumerate(vals)])
    tot = x.groupBy("_part", *ks).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(vals)])
    if ks:
        prev = Window.partitionBy(*ks).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        tot = tot.select("_part", *ks, *[F.sum(f"_t{i}").over(prev).alias(f"_off{i}") for i in range(len(vals))])
    else:
        rows, upto = [], [None] * len(vals)
        for r in tot.orderBy("_part").collect():  # one row a partition
            rows.append((r["_part"], *upto))
            upto = [u if r[f"_t{i}"] is None else r[f"_t{i}"] if u is None else u + r[f"_t{i}"] for i, u in enumerate(upto)]
        kind = StructType([StructField("_part", IntegerType()), *[StructField(f"_off{i}", tot.schema[f"_t{i}"].dataType) for i in range(len(vals))]])
        tot = F.broadcast(df.sparkSession.createDataFrame(rows, kind))
    same = [F.col("x._part") == F.col("t._part"), *[F.col(f"x.{k}").eqNullSafe(F.col(f"t.{k}")) for k in ks]]
    j = x.alias("x").join(tot.alias("t"), same)
    total = lambda i: F.coalesce(F.col(f"_in{i}") + F.coalesce(F.col(f"_off{i}"), F.lit(0)), F.col(f"_off{i}"))
    return j.select(*[f"x.`{c}`" for c in df.columns], *[total(i).alias(o) for i, o in enumerate(outs)])


def ecdf(df: DataFrame, col: str, keys=None) -> DataFrame:
    """Empirical CDF: for each distinct value x, share of rows <= x.

    Counts per value first (partial aggregation), then a distributed running
    sum over the distinct values."""
    from loupe.session import materialize
    ks = _keys(keys)
    c = df.where(F.col(col).isNotNull()).groupBy(*ks, col).agg(F.count(F.lit(1)).alias("n"))
    # the per-value counts feed several jobs (range bounds, totals, the sum
    # itself): write them once instead of re-aggregating the facts each time
    c = materialize(c)
    c = cumulative_sum(c, col, "n", ks, "cum_n")
    tot = c.groupBy(*ks).agg(F.sum("n").alias("_tot"))
    c = c.join(tot, ks) if ks else with_scalars(c, tot)
    return c.select(*ks, col, "n", "cum_n", (F.col("cum_n") / F.col("_tot")).alias("ecdf"))


def stacked_cumsum(counts: DataFrame, time_col: str, cat_col: str, value: str,
                   categories: Sequence[str]) -> DataFrame:
    """Stack categories (in list order) per time point: running sum across the
    category list, not across time (the notebook's ``cumsum(axis=0)`` before
    ``.T``).  Missing (time, category) cells count 0."""
    cats = F.array(*[F.struct(F.lit(c).alias(cat_col), F.lit(i).alias("_pos")) for i, c in enumerate(categories)])
    times = counts.select(time_col).distinct()
    grid = times.select(time_col, F.explode(cats).alias("_c")).select(time_col, "_c.*")
    j = grid.join(counts.select(time_col, cat_col, value), [time_col, cat_col], "left").fillna(0, [value])
    w = Window.partitionBy(time_col).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("stacked", F.sum(value).over(w)).drop("_pos")


def running_total(df: DataFrame, order: str, value: str, keys=None, out: str = "running") -> DataFrame:
    """Running sum in ``order``, in ranges of the order (``cumulative_sum``)."""
    return cumulative_sum(df, order, value, keys, out)


def future_dates(df: DataFrame, ds: str, n: int, keys=None) -> DataFrame:
    """The ``n`` days after each series' last date."""
    ks = _keys(keys)
    b = df.groupBy(*ks).agg(F.date_add(F.max(ds), 1).alias("_lo"), F.date_add(F.max(ds), n).alias("_hi"))
    return calendar(b, "_lo", "_hi", 1, ks, ds)


def ordered_split(df: DataFrame, order: str, frac: float = 0.9, skip: int = 0, keys=None,
                  out: str = "split") -> DataFrame:
    """Rows [skip, floor(frac*n)) -> 'train', [floor(frac*n), n) -> 'test';
    the first ``skip`` rows are dropped."""
    ks = _keys(keys)
    x = ranked(df, order, ks, "_p").drop("_part")
    n = x.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(n, ks) if ks else with_scalars(x, n)
    x = x.withColumn("_cut", F.floor(F.col("_n") * frac)).drop("_n")
    return (x.where(F.col("_p") >= skip)
            .withColumn(out, F.when(F.col("_p") < F.col("_cut"), "train").otherwise("test"))
            .drop("_p", "_cut"))


def fourier_terms(t: Column, freq: float, order: int) -> list[Column]:
    """sin/cos of 2*pi*i*t/freq for i = 1..order, named sin_{freq}_{i}."""
    name = f"{freq:g}"
    out = []
    for i in range(1, order + 1):
        k = F.lit(2 * 3.141592653589793 * i / freq) * t
        out += [F.sin(k).alias(f"sin_{name}_{i}"), F.cos(k).alias(f"cos_{name}_{i}")]
    return out


# ------------------------------------------------ halo windows (one long series)
BLOCK_ROWS = 1 << 16


def halo_window(df: DataFrame, order: str, keys, lo: int, hi: int, exprs, block_rows: int | None = None) -> DataFrame:
    """Row-frame window work over series of any length.

    Ranks (``ranked``) are cut into blocks of ``block_rows`` (BLOCK_ROWS) per series, and
    each block receives copies of the last ``-lo`` rows of the block before and
    the first ``hi`` rows of the next (the halo).  ``exprs(w)`` builds the
    output columns from a window ``w`` over one block; only a block's own rows
    are kept, so the result equals the same window over the whole series.
    ``order`` must be unique per series."""
    ks = _keys(keys)
    back, fwd = max(0, -lo), max(0, hi)
    size = max(block_rows or BLOCK_ROWS, back, fwd)
    x = ranked(df, order, ks, "_g").drop("_part").withColumn("_home", F.floor(F.col("_g") / size))
    off = F.col("_g") - F.col("_home") * size  # position inside the home block
    targets = F.array(F.col("_home"))
    if back:
        targets = F.when(off >= size - back, F.array_union(targets, F.array(F.col("_home") + 1))).otherwise(targets)
    if fwd:
        targets = F.when((off < fwd) & (F.col("_home") > 0), F.array_union(targets, F.array(F.col("_home") - 1))).otherwise(targets)
    x = x.withColumn("_tb", F.explode(targets))
    w = Window.partitionBy(*ks, "_tb").orderBy("_g")
    out = x.select("*", *exprs(w))
    return out.where(F.col("_tb") == F.col("_home")).drop("_g", "_home", "_tb")
