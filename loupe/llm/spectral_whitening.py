"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the spectrum of the rows it has seen and takes up every
further row as a centred rank-one update: the new eigenvalues are the roots of
a secular equation, after components that the row does not touch and repeated
eigenvalues have been deflated.  Two spectra are combined by taking up the
scaled eigenvectors of one, and the difference of the means, as successive
rank-one updates of the other.  A last distributed pass projects the centred
rows on the basis found and solves the small problem there (Rayleigh-Ritz),
which brings the components to double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import written

COMPONENTS = 4
FAN_IN = 16  # spectra combined by one task
EPS = np.finfo(float).eps


# ------------------------------------------------------- rank-one updates
def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z_j^2 / (d_j - x) for ascending distinct ``d``, no
    zero in ``z`` and rho > 0, as (origin, distance): each root is its nearest
    pole's index and the distance from it, so that differences between roots
    and poles lose no digits.

    All roots are refined together.  A step solves the equation of the two
    poles around a root with the other terms' value and slope held; a step
    that leaves the root's bracket is replaced by halving it."""
    k, w = len(d), rho * z * z
    if k == 1:
        return np.zeros(1, int), w.copy()
    gap = np.append(np.diff(d), w.sum())
    i = np.arange(k)
    mid = 1 + (w / (d - d[:, None] - gap[:, None] / 2)).sum(axis=1)
    origin = np.where((mid >= 0) | (i == k - 1), i, i + 1)
    delta = d[None, :] - d[origin][:, None]
    near = origin == i
    lo = np.where(near, 0.0, -gap / 2)
    hi = np.where(near, np.where(i == k - 1, gap, gap / 2), 0.0)
    last_far = (i == k - 1) & (mid < 0)
    lo[last_far] = gap[last_far] / 2
    hi[(i == k - 1) & (mid >= 0)] = gap[-1] / 2
    x = (lo + hi) / 2
    left = np.tri(k, dtype=bool)
    left[-1, -1] = False  # the last root has both poles on its left
    p = np.minimum(i, k - 2)
    open_ = np.ones(k, bool)
    with np.errstate(all="ignore"):
        for _ in range(60):
            r = np.flatnonzero(open_)
            t = delta[r] - x[r, None]
            q = w / t
            f = 1 + q.sum(axis=1)
            up = f < 0
            lo[r] = np.where(up, x[r], lo[r])
            hi[r] = np.where(up, hi[r], x[r])
            slope = q / t
            s_left = (slope * left[r]).sum(axis=1)
            s_all = slope.sum(axis=1)
            a1, a2 = t[np.arange(len(r)), p[r]], t[np.arange(len(r)), p[r] + 1]
            c = f - a1 * s_left - a2 * (s_all - s_left)
            a, b = (a1 + a2) * f - a1 * a2 * s_all, a1 * a2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            far = r == k - 1
            step[far] = np.where(a >= 0, (a + root) / (2 * c), 2 * b / (a - root))[far]
            new = x[r] + step
            inside = (new > lo[r]) & (new < hi[r])
            new = np.where(inside, new, (lo[r] + hi[r]) / 2)
            done = (np.abs(f) <= 4 * EPS * (1 + np.abs(q).sum(axis=1))) | (new == x[r]) | (hi[r] - lo[r] <= 2 * EPS * np.maximum(np.abs(lo[r]), np.abs(hi[r])))
            x[r] = np.where(done, x[r], new)
            open_[r] = ~done
            if not open_.any():
                break
    return origin, x


def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of q diag(lam) q' + rho v v'."""
    z = v @ q
    size = rho * float(z @ z)
    if size <= 0:
        return lam, q
    tol = 8 * EPS * max(abs(lam[-1]), abs(lam[0]), size)
    # equal eigenvalues: a reflection leaves one component for each run
    start = 0
    turned = False
    close = np.diff(lam) <= tol
    if close.any():
        z, ends = z.copy(), np.append(np.flatnonzero(~close) + 1, len(lam))
        for end in ends.tolist():
            if end - start > 1 and (norm := np.linalg.norm(z[start:end])) > 0:
                u = z[start:end].copy()
                u[-1] += math.copysign(norm, u[-1])
                u /= np.linalg.norm(u)
                if not turned:
                    q, turned = q.copy(), True
                q[:, start:end] -= 2 * np.outer(q[:, start:end] @ u, u)
                last = -math.copysign(norm, z[end - 1])
                z[start:end] = 0
                z[end - 1] = last
            start = end
    touched = np.flatnonzero(rho * np.abs(z) * math.sqrt(size / rho) > tol)
    if not len(touched):
        return lam, q
    d, zt = lam[touched], z[touched]
    origin, x = secular_roots(d, zt, rho)
    # pole minus root, without cancellation; then the z that has these roots exactly
    diff = (d[None, :] - d[origin][:, None]) - x[:, None]
    k = len(d)
    ratio = -diff / np.where(np.eye(k, dtype=bool), 1.0, d[:, None] - d[None, :])
    zt = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0)) / rho), zt)
    vec = (zt[None, :] / diff).T
    vec /= np.linalg.norm(vec, axis=0)
    if not turned:
        q = q.copy()
    lam = lam.copy()
    lam[touched] = d[origin] + x
    q[:, touched] = q[:, touched] @ vec
    order = np.argsort(lam, kind="stable")
    return lam[order], q[:, order]


class Spectrum:
    """Count, exact sums, and the spectrum of the scatter (sum of centred
    products) of the rows seen."""

    def __init__(self, dim: int):
        self.n, self.total = 0, [0] * dim
        self.mean, self.lam, self.q = np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, rows: np.ndarray) -> None:
        for x in rows.astype(float):
            if self.n:
                v = x - self.mean
                self.lam, self.q = rank_one(self.lam, self.q, v, self.n / (self.n + 1))
                self.mean = self.mean + v / (self.n + 1)
            else:
                self.mean = x
            self.n += 1
        self.total = [a + int(b) for a, b in zip(self.total, rows.astype(object).sum(axis=0))] if len(rows) else self.total
        self.mean = np.array([t / self.n for t in self.total]) if self.n else self.mean

    def merge(self, o: Spectrum) -> None:
        if not self.n or not o.n:
            if o.n:
                self.__dict__ |= o.__dict__
            return
        for lam, v in zip(o.lam, o.q.T):
            if lam > 0:
                self.lam, self.q = rank_one(self.lam, self.q, v, float(lam))
        self.lam, self.q = rank_one(self.lam, self.q, o.mean - self.mean, self.n * o.n / (self.n + o.n))
        self.n, self.total = self.n + o.n, [a + b for a, b in zip(self.total, o.total)]
        self.mean = np.array([t / self.n for t in self.total])
        # the errors of many updates must not add up
        self.q = np.linalg.qr(self.q)[0]

    def frame(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [self.n], "total": [[Decimal(t) for t in self.total]], "lam": [self.lam.tolist()], "q": [self.q.ravel().tolist()]})

    @staticmethod
    def of(row) -> Spectrum:
        s = Spectrum(len(row.lam))
        s.n, s.total, s.lam = int(row.n), [int(t) for t in row.total], np.asarray(row.lam, float)
        s.q = np.asarray(row.q, float).reshape(len(s.lam), -1)
        s.mean = np.array([t / s.n for t in s.total])
        return s


STATE = "part long, n long, total array<decimal(38,0)>, lam array<double>, q array<double>"


# ---------------------------------------------------------------- passes
def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of long arrays, padded with zeros to ``dim``."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim) < n[:, None]] = flat
    return out


def _spectra(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        s = Spectrum(dim)
        for b in batches:
            s.add(_matrix(b.column("x"), dim))
        if s.n:
            f = s.frame(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([
                pa.array(f["part"]), pa.array(f["n"]), pa.array(f["total"].tolist(), pa.list_(pa.decimal128(38, 0))),
                pa.array(f["lam"].tolist(), pa.list_(pa.float64())), pa.array(f["q"].tolist(), pa.list_(pa.float64()))], ["part", "n", "total", "lam", "q"])
    return run


def _combined(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("part")
    s = Spectrum.of(g.iloc[0])
    for i in range(1, len(g)):
        s.merge(Spectrum.of(g.iloc[i]))
    return s.frame(int(g["part"].iloc[0]) // FAN_IN)


def _vector_sum(df: DataFrame, f, length: int) -> np.ndarray:
    """Sum over all rows of ``f`` (an Arrow batch -> a vector): one vector a
    partition, added map-side and then in two steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total, some = np.zeros(length), False
        for b in batches:
            if b.num_rows:
                total, some = total + f(b), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 256]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["g", "v"])
    parts = df.mapInArrow(run, "g long, v array<double>").select("g", array_to_vector("v").alias("v"))
    parts = parts.groupBy("g").agg(Summarizer.sum(F.col("v")).alias("v"))
    row = parts.agg(Summarizer.sum(F.col("v")).alias("v")).first()
    return np.zeros(length) if row is None or row.v is None else row.v.toArray()


def whitening_model(vectors: DataFrame, components: int = COMPONENTS) -> dict | None:
    """Fit on distinct rows of ``x`` (array<long>): count, exact sums, unit
    eigenvectors, eigenvalues and the trace of the covariance (divisor n), and
    the identity error of the whitened fit rows.  None without rows."""
    fit = written(vectors.select("x").distinct(), "whiten-fit")
    dim = fit.agg(F.max(F.size("x"))).first()[0]
    if dim is None:
        return None
    if not dim:
        return {"n": fit.count(), "total": [], "vectors": np.zeros((0, 0)), "values": np.zeros(0), "trace": 0.0, "error": None}
    # rows of different lengths that are equal once padded count once
    pad = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x")))
    if fit.where(F.size("x") < dim).limit(1).count():
        fit = written(fit.select(pad.alias("x")).distinct(), "whiten-fit")
    state = written(fit.mapInArrow(_spectra(dim), STATE), "whiten-spectra")
    while state.count() > 1:
        state = written(state.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(_combined, STATE), "whiten-spectra")
    s = Spectrum.of(state.first())
    basis, mean, n = np.linalg.qr(s.q)[0], s.mean, s.n

    def products(b: pa.RecordBatch) -> np.ndarray:
        y = (_matrix(b.column("x"), dim) - mean) @ basis
        return (y.T @ y).ravel()
    small = _vector_sum(fit, products, dim * dim).reshape(dim, dim) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, vec = values[::-1][:components], (basis @ turn)[:, ::-1][:, :components]
    trace = float(np.trace(small))
    good = values > dim * EPS * max(trace, 0)
    scale = np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)

    def whitened(b: pa.RecordBatch) -> np.ndarray:
        w = ((_matrix(b.column("x"), dim) - mean) @ vec) * scale
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
    k = len(values)
    sums = _vector_sum(fit, whitened, k + k * k) / n
    off = np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k))[np.ix_(good, good)]
    return {"n": n, "total": s.total, "vectors": vec, "values": np.where(good, values, 0.0), "trace": trace, "error": float(off.max()) if off.size else None}


def _projected(model: dict, dim: int):
    n, total, vec, values = model["n"], model["total"], model["vectors"], model["values"]
    k, mean = len(values), np.array([t / n for t in total])
    scale = np.array([1 / math.sqrt(v) if v > 0 else np.nan for v in values])

    def deviation(x: np.ndarray) -> list[int | None]:
        most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
        if dim * most * most < 1 << 63:
            return ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(axis=1)
        return [int(v) if v < 10**38 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), dim)
            w = ((x - mean) @ vec) * scale
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([None if v is None else Decimal(v) for v in deviation(x)], pa.decimal128(38, 0)),
                 pa.FixedSizeListArray.from_arrays(pa.array(w.ravel(), from_pandas=True), k).cast(pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``; ``deviation`` is a decimal.

    Rows whose vector is null or holds null or non-finite entries are left
    out.  Shorter vectors count as ended by zeros.  Repeated vectors are fitted
    once and each row is returned; null ids are kept.  A component without
    variance (all vectors equal, or fewer of them than components) has a null
    ``whitened`` and ``explained`` 0 (null if nothing varies).  A deviation of
    over 38 digits is null.  Empty tables, and vectors without entries, give an
    empty result.  Other columns are not read.

    An update costs dim^3, and a partition holds dim^2 numbers besides a batch;
    what reaches the driver are dim^2 numbers a pass."""
    c = F.col(vec_col)
    odd = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    d = vectors.where(c.isNotNull() & ~F.coalesce(odd, F.lit(True))).select(
        F.col(id_col).alias("vec_id"), F.transform(c, lambda e: F.floor(256 * e.cast("double")) + F.lit(0).cast("long")).alias("x"))
    kind = dict(d.dtypes)["vec_id"]
    m = whitening_model(d, components)
    if m is None or not len(m["values"]):
        return d.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(name) for name, t in (
            ("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    w = d.mapInArrow(_projected(m, len(m["total"])), f"vec_id {kind}, deviation decimal(38,0), w array<double>")
    share = F.array(*[F.lit(float(v / m["trace"])) if m["trace"] > 0 else F.lit(None).cast("double") for v in m["values"]])
    w = w.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return w.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(m["n"]).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(m["error"]).cast("double").alias("identity_error"))
