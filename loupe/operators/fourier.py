"""Discrete Fourier transform of a series of any length, in blocks.

The transform of n values is a convolution with a chirp (Bluestein), done at a
power of two M = R x C of at least 2n - 1.  Each transform of length M is a
transform of the columns, a twist, and one of the rows of an R x C matrix, so
the work is M log M and no task holds more than a few columns or rows.  The
inverse starts on the rows where the forward one ends; two shuffles of M
numbers in all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 32  # columns or rows of one task's matrix


def _shape(n: int) -> tuple[int, int, int]:
    """(M, R, C) for n values."""
    bits = max((2 * n - 2).bit_length(), 2)
    return 1 << bits, 1 << (bits // 2), 1 << (bits - bits // 2)


def _chirp(t: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi t^2 / n); the square is reduced in whole numbers."""
    t = np.asarray(t, np.int64) % (2 * n)
    return np.exp(1j * np.pi * ((t * t) % (2 * n)) / n)


def _packed(x: np.ndarray) -> list:
    return np.ascontiguousarray(x).view(np.float64).ravel().tolist()


def _unpacked(v, *shape: int) -> np.ndarray:
    return np.asarray(v, np.float64).view(np.complex128).reshape(shape)


def _columns(n: int):
    big, r, c = _shape(n)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        """Transforms of some columns of the data and of the chirp."""
        group = int(g["group"].iloc[0])
        cols = np.arange(group * WIDTH, min((group + 1) * WIDTH, c))
        a = np.zeros((r, len(cols)), complex)
        g = g[g["t"] >= 0]
        t = g["t"].to_numpy(np.int64)
        a[t // c, t % c - cols[0]] = g["x"].to_numpy() * np.conj(_chirp(t, n))
        j = np.arange(r)[:, None] * c + cols
        j = np.minimum(j, big - j)
        b = np.where(j < n, _chirp(j, n), 0)
        k1 = np.arange(r)
        twist = np.exp(-2j * np.pi * (np.outer(k1, cols) % big) / big)
        a, b = np.fft.fft(a, axis=0) * twist, np.fft.fft(b, axis=0) * twist
        at = range(0, r, WIDTH)
        return pd.DataFrame({"to": [s // WIDTH for s in at], "group": group, "v": [_packed(np.stack([a[s:s + WIDTH], b[s:s + WIDTH]])) for s in at]})
    return run


def _rows(n: int):
    big, r, c = _shape(n)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        """Transforms of some rows, their product, and its first inverse step."""
        to = int(g["to"].iloc[0])
        k1 = np.arange(to * WIDTH, min((to + 1) * WIDTH, r))
        ab = np.concatenate([_unpacked(v, 2, len(k1), -1) for v in g.sort_values("group")["v"]], axis=2)
        a, b = np.fft.fft(ab, axis=2)
        p = np.fft.ifft(a * b, axis=1) * np.exp(2j * np.pi * (np.outer(k1, np.arange(c)) % big) / big)
        at = range(0, c, WIDTH)
        return pd.DataFrame({"to": [s // WIDTH for s in at], "group": to, "v": [_packed(p[:, s:s + WIDTH]) for s in at]})
    return run


def _ends(n: int, most: int):
    _, r, c = _shape(n)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        to = int(g["to"].iloc[0])
        j1 = np.arange(to * WIDTH, min((to + 1) * WIDTH, c))
        p = np.concatenate([_unpacked(v, -1, len(j1)) for v in g.sort_values("group")["v"]], axis=0)
        y = np.fft.ifft(p, axis=0)
        k = j1 + c * np.arange(r)[:, None]
        keep = k <= most
        k, y = k[keep], y[keep]
        y = y * np.conj(_chirp(k, n))
        return pd.DataFrame({"k": k, "re": y.real, "im": y.imag})
    return run


def transform(df: DataFrame, t: str, x: str, n: int, most: int | None = None) -> DataFrame:
    """``k, re, im`` of sum x_t exp(-2 pi i k t / n) for k = 0 to ``most``
    (n - 1).  ``t`` runs from 0 to n - 1, one row each; missing and null values
    count as 0."""
    most = n - 1 if most is None else most
    if n <= 0:
        return df.sparkSession.createDataFrame([], "k long, re double, im double")
    _, _, c = _shape(n)
    groups = (c + WIDTH - 1) // WIDTH
    data = df.where(F.col(x).isNotNull()).select(F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x"))
    data = data.withColumn("group", F.floor(F.col("t") % c / WIDTH))
    # a column without values still holds the chirp
    every = df.sparkSession.range(groups).select(F.lit(-1).cast("long").alias("t"), F.lit(0.0).alias("x"), F.col("id").alias("group"))
    part = "to long, group long, v array<double>"
    cols = data.unionByName(every).groupBy("group").applyInPandas(_columns(n), part)
    rows = cols.groupBy("to").applyInPandas(_rows(n), part)
    return rows.groupBy("to").applyInPandas(_ends(n, most), "k long, re double, im double")
