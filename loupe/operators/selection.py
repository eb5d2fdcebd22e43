"""Exact order statistics by refining histograms over the bits of a double.

A double's 64 bits, with the lower ones of negative numbers turned over, are a
whole number in the same order.  A pass counts the values by the next 16 bits
of that number, within the ranges that hold a wanted rank; four passes fix all
64.  A range whose smallest and largest value agree is done, so whole numbers
and other repeated values end after one or two passes.  What is shuffled are
counts of at most 65,536 ranges a column and wanted rank, never values; there
is one algorithm at every size."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.session import stored

STEP, PASSES = 16, 4
HELD = 1 << 18  # ranges of one column that a task holds before it merges them


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order; -0.0 is 0.0, NaN is largest."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    b = x.view(np.int64)
    return b ^ ((b >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_bits(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.int64)
    return (k ^ ((k >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def _ranges(key: np.ndarray, shift: int) -> np.ndarray:
    """(range, count, smallest, largest) of keys by their bits above ``shift``."""
    key = np.sort(key)
    b = key >> np.int64(shift)
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int)
    ends = np.append(at[1:], len(b))
    return np.stack([b[at], ends - at, key[at], key[ends - 1]], axis=1) if len(at) else np.zeros((0, 4), np.int64)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(parts)
    x = x[np.argsort(x[:, 0], kind="stable")]
    at = np.flatnonzero(np.append(True, x[1:, 0] != x[:-1, 0])) if len(x) else np.zeros(0, int)
    if not len(at):
        return x
    return np.stack([x[at, 0], np.add.reduceat(x[:, 1], at), np.minimum.reduceat(x[:, 2], at), np.maximum.reduceat(x[:, 3], at)], axis=1)


class _Column:
    """What one task has counted of one column."""

    def __init__(self):
        self.parts, self.size, self.n = [], 0, 0
        self.total = self.square = np.longdouble(0)  # sums of many values lose no digits of a double

    def add(self, x: np.ndarray, shift: int, within: np.ndarray | None, mean: float | None) -> None:
        self.n += len(x)
        off = x if mean is None else x - mean
        self.total += off.sum(dtype=np.longdouble)
        if mean is not None:
            self.square += (off * off).sum(dtype=np.longdouble)
        key = ordered_bits(x)
        if within is not None:
            key = key[np.isin(key >> np.int64(shift + STEP), within)]
        r = _ranges(key, shift)
        self.parts.append(r)
        self.size += len(r)
        if self.size > HELD:
            self.parts = [_merged(self.parts)]
            self.size = len(self.parts[0]) // 2

    def batch(self, c: int) -> pa.RecordBatch:
        r = _merged(self.parts) if self.parts else np.zeros((0, 4), np.int64)
        k = len(r)
        column = lambda v, own: pa.array([*v.tolist(), own])
        return pa.RecordBatch.from_arrays([
            pa.array([c] * (k + 1), pa.int32()), pa.array([*r[:, 0].tolist(), None], pa.int64()), column(r[:, 1], self.n),
            pa.array([*r[:, 2].tolist(), None], pa.int64()), pa.array([*r[:, 3].tolist(), None], pa.int64()),
            pa.array([None] * k + [float(self.total)], pa.float64()), pa.array([None] * k + [float(self.square)], pa.float64())], _NAMES)


_NAMES = ["c", "bin", "n", "lo", "hi", "total", "square"]
_KINDS = "c int, bin long, n long, lo long, hi long, total double, square double"


def _counted(level: int, within: dict[int, list[int]] | None, means: list[float] | None, width: int):
    """One pass over all columns: ranges of the next bits, and the count and
    sum (or, with ``means``, the sums of the differences and their squares)."""
    shift = 64 - STEP * (level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Column() for _ in range(width)]
        inside = None if within is None else [np.array(within.get(i, []), np.int64) for i in range(width)]
        for b in batches:
            for i in range(width):
                x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                held[i].add(x, shift, None if inside is None else inside[i], None if means is None else means[i])
        for i, h in enumerate(held):
            if h.n:
                yield h.batch(i)
    return run


def _picked(hist: DataFrame, keys: Sequence[str], targets: DataFrame, level: int) -> DataFrame:
    """The range that holds each wanted rank, and the rank within it."""
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    hist = hist.where("bin is not null").withColumn("prefix", F.shiftright("bin", STEP) if level else F.lit(0).cast("long"))
    # at most 2^16 ranges a prefix
    w = Window.partitionBy(*keys, "prefix").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("upto", F.sum("n").over(w))
    j = hist.alias("h").join(targets.alias("t"), [*same("h", "t"), F.col("h.prefix") == F.col("t.prefix"),
                                                  F.col("t.rank") < F.col("h.upto"), F.col("t.rank") >= F.col("h.upto") - F.col("h.n")])
    return j.select(*[f"t.{k}" for k in keys], "t.wanted", F.col("h.bin").alias("prefix"),
                    (F.col("t.rank") - (F.col("h.upto") - F.col("h.n"))).alias("rank"), "h.lo", "h.hi")


def _wanted(n: int, probs: Sequence[float]) -> list[int]:
    """Ranks that linear interpolation at ``p * (n - 1)`` needs, by position."""
    out = []
    for p in probs:
        low = math.floor(p * (n - 1))
        out += [low, min(low + 1, n - 1)]
    return out


def describe_columns(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> list[dict]:
    """Count, mean, sample deviation, smallest, largest and exact quantiles of
    each column, as one dict a column.

    One scan for counts, sums and the first bits; the second also takes the
    squared differences from the means; further ones only while a wanted rank
    is open.  No column is unpivoted.  The driver holds a few numbers a
    column.  Nulls are left out, NaN counts as the largest value."""
    spark, cols = df.sparkSession, list(cols)
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    out = [dict(column=c, count=0, mean=None, std=None, min=None, max=None, quantiles=[None] * len(probs)) for c in cols]
    within, means, targets, values = None, None, None, {}
    for level in range(PASSES):
        hist = stored(x.mapInArrow(_counted(level, within, means, len(cols)), _KINDS).groupBy("c", "bin").agg(
            F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.sum("square").alias("square")), "ranges")
        if level <= 1:
            for r in hist.where("bin is null").collect():
                o = out[r.c]
                if level:
                    o["std"] = math.sqrt(max(r.square - r.total * r.total / r.n, 0.0) / (r.n - 1)) if r.n > 1 else None
                else:
                    o["count"], o["mean"] = r.n, r.total / r.n
        if not level:
            for r in hist.where("bin is not null").groupBy("c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
                out[r.c]["min"], out[r.c]["max"] = from_bits([r.lo, r.hi]).tolist()
            means = [o["mean"] or 0.0 for o in out]
            rows = [(i, k, 0, rank) for i, o in enumerate(out) if o["count"] for k, rank in enumerate(_wanted(o["count"], probs))]
        else:
            rows = targets
        targets = []
        if rows:  # a few ranks a column
            t = F.broadcast(spark.createDataFrame(rows, "c int, wanted int, prefix long, rank long"))
            for r in _picked(hist, ["c"], t, level).collect():
                if r.lo == r.hi:
                    values[r.c, r.wanted] = float(from_bits([r.lo])[0])
                else:
                    targets.append((r.c, r.wanted, r.prefix, r["rank"]))
        within = {i: sorted({t[2] for t in targets if t[0] == i}) for i in range(len(cols))}
        if not targets and level:
            break
    for i, o in enumerate(out):
        for k, p in enumerate(probs):
            if o["count"]:
                at, low, high = p * (o["count"] - 1), values[i, 2 * k], values[i, 2 * k + 1]
                o["quantiles"][k] = low if low == high else low + (at - math.floor(at)) * (high - low)
    return out


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``value`` per group, for any
    number of groups: ``keys`` and one column a probability.

    Same passes as ``describe_columns``, with the ranges and wanted ranks of
    all groups in tables.  A hot group is counted map-side.  Groups without a
    value have nulls; a null key is a group."""
    keys = list(keys)
    if not keys:
        return quantiles_by(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, names).drop("_all")

    @F.pandas_udf("long")
    def bits(v: pd.Series) -> pd.Series:
        return pd.Series(ordered_bits(v.to_numpy(np.float64)))

    @F.pandas_udf("double")
    def double(v: pd.Series) -> pd.Series:
        return pd.Series(from_bits(v.to_numpy(np.int64)))
    rows = df.where(F.col(value).isNotNull()).select(*keys, bits(F.col(value).cast("double")).alias("key"))
    targets, done = None, []
    for level in range(PASSES):
        shift, x = 64 - STEP * (level + 1), rows
        if level:
            open_ = targets.where("lo < hi")
            if not open_.limit(1).count():
                break
            same = [F.col(f"x.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
            x = x.alias("x").join(open_.select(*keys, "prefix").distinct().alias("o"),
                                  [*same, F.shiftright("x.key", shift + STEP) == F.col("o.prefix")], "left_semi")
        hist = stored(x.groupBy(*keys, F.shiftright("key", shift).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")), "ranges")
        if not level:
            low = lambda p: F.floor(F.lit(float(p)) * (F.col("n") - 1))
            ranks = F.array(*[r for p in probs for r in (low(p), F.least(low(p) + 1, F.col("n") - 1))])
            n = stored(hist.groupBy(*keys).agg(F.sum("n").alias("n")), "counts")
            want = n.select(*keys, F.posexplode(ranks).alias("wanted", "rank")).withColumn("prefix", F.lit(0).cast("long"))
        else:
            want = open_.select(*keys, "wanted", "prefix", "rank")
        targets = stored(_picked(hist, keys, want, level), "ranks")
        done.append(targets.where("lo = hi").select(*keys, "wanted", double(F.col("lo")).alias("v")))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("wanted") == i, F.col("v"))).alias(f"_v{i}") for i in range(2 * len(probs))])
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return n.alias("n").join(found.alias("f"), same).select(*[f"n.{k}" for k in keys], *[_between(F.col(f"f._v{2 * i}"), F.col(f"f._v{2 * i + 1}"), float(p) * (F.col("n.n") - 1)).alias(name)
                                               for i, (p, name) in enumerate(zip(probs, names))])


def _between(low: Column, high: Column, at: Column) -> Column:
    return F.when(low == high, low).otherwise(low + (at - F.floor(at)) * (high - low))
