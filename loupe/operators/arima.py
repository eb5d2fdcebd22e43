"""Fitted ARIMA models: coefficients, innovation variance, fitted values and
residuals by conditional least squares, for one long series or many.

The innovations ``e_t = z_t - c - sum phi_i z_{t-i} - sum theta_j e_{t-j}`` and
their derivatives follow one linear recursion.  Over a block of rows it is an
affine map of the state before the block, and maps of adjoining blocks combine
to the map of both.  So blocks are run apart, each from a zero state, together
with the responses to a unit state; combining their maps (and the products of
their columns) gives the exact sums over the whole series for a Gauss-Newton
step, and a last pass over the small maps gives each block's true state for the
residuals.  No task sees a whole series."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.operators.models import _differenced
from loupe.operators.selection import describe_columns
from loupe.operators.series import _keys, position, ranked, with_lags
from loupe.session import stored

BLOCK_ROWS = 1 << 14
FAN_IN = 256  # maps combined by one task
MOST_STEPS = 60  # evaluations of a model


class Map:
    """A block's affine map for a model of order (p, q).

    Columns of the block's rows: ``1 + m`` particular ones (the innovation and
    its derivatives by c, phi, theta, from a zero state), q responses to a unit
    state of a column's own, and q * q responses of the theta derivatives to a
    unit state of the innovation.  ``gram`` holds all their products, ``b``,
    ``a``, ``x`` their values at the block's end."""

    def __init__(self, q: int, b: np.ndarray, a: np.ndarray, x: np.ndarray, gram: np.ndarray, n: int):
        self.q, self.b, self.a, self.x, self.gram, self.n = q, b, a, x, gram, n

    def then(self, o: Map) -> Map:
        """The map of this block and the next one."""
        q, k = self.q, len(self.b)
        t = np.zeros_like(o.gram)
        t[:k, :k] = np.eye(k)
        b = np.empty_like(o.b)
        for c in range(k):
            t[k:k + q, c] = self.b[c]
            b[c] = o.b[c] + o.a @ self.b[c]
            if c >= k - q:
                j = c - (k - q)
                t[k + q + j * q:k + q + (j + 1) * q, c] = self.b[0]
                b[c] += o.x[j] @ self.b[0]
        t[k:k + q, k:k + q] = self.a
        x = np.empty_like(o.x)
        for j in range(q):
            at = slice(k + q + j * q, k + q + (j + 1) * q)
            t[k:k + q, at], t[at, at] = self.x[j], self.a
            x[j] = o.a @ self.x[j] + o.x[j] @ self.a
        return Map(q, b, o.a @ self.a, x, self.gram + t.T @ o.gram @ t, self.n + o.n)

    def row(self) -> dict:
        return {"q": self.q, "k": len(self.b), "n": self.n, "m": np.concatenate([v.ravel() for v in (self.b, self.a, self.x, self.gram)]).tolist()}

    @staticmethod
    def of(r) -> Map:
        q, k, m = int(r.q), int(r.k), np.asarray(r.m, float)
        size = k + q + q * q
        cut = np.cumsum([k * q, q * q, q * q * q])
        b, a, x, g = np.split(m, cut)
        return Map(q, b.reshape(k, q), a.reshape(q, q), x.reshape(q, q, q), g.reshape(size, size), int(r.n))


def recursion(drive: np.ndarray, theta: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rows v_t = drive_t - sum theta_j v_{t-j}; ``state`` is v_0, v_-1, ..."""
    q = len(theta)
    out = np.empty((len(drive) + q, drive.shape[1]))
    out[:q] = state[::-1]
    back = theta[::-1]
    for t in range(len(drive)):
        out[t + q] = drive[t] - back @ out[t:t + q]
    return out[q:] if q else drive.astype(float)


def innovations_drive(z: np.ndarray, head: int, beta: np.ndarray, p: int) -> np.ndarray:
    """z_t - c - sum phi_i z_{t-i} of the rows from ``head`` on."""
    w = z[head:] - beta[0]
    for i in range(1, p + 1):
        w = w - beta[i] * z[head - i:len(z) - i]
    return w


def block_map(z: np.ndarray, head: int, beta: np.ndarray, p: int, q: int) -> Map:
    """The map of the rows of ``z`` from ``head`` on (at least p precede)."""
    theta, n = beta[1 + p:], len(z) - head
    lags = [z[head - i:len(z) - i] for i in range(1, p + 1)]
    first = np.column_stack([innovations_drive(z, head, beta, p), -np.ones(n), *[-x for x in lags]])
    zeros = np.zeros((n, q))
    state = np.zeros((q, 1 + 1 + p + q))
    state[:, 2 + p:] = np.eye(q)  # v_0, v_-1, ... in turn
    v = recursion(np.column_stack([first, zeros]), theta, state)
    part, h = v[:, :2 + p], v[:, 2 + p:]
    if q:
        # the derivatives by theta are driven by earlier innovations, of rows before the block too
        e = np.concatenate([np.zeros(q), part[:, 0]])
        hom = np.concatenate([np.eye(q)[::-1], h])
        drives = [-e[q - j:q - j + n, None] for j in range(1, q + 1)] + [-hom[q - j:q - j + n] for j in range(1, q + 1)]
        d = recursion(np.concatenate(drives, axis=1), theta, np.zeros((q, q + q * q)))
        part, cross = np.concatenate([part, d[:, :q]], axis=1), d[:, q:]
    else:
        cross = np.zeros((n, 0))
    cols = np.concatenate([part, h, cross], axis=1)
    end = np.concatenate([np.zeros((q, cols.shape[1])), cols])
    if q:
        end[:q, part.shape[1]:part.shape[1] + q] = np.eye(q)[::-1]
    last = end[len(end) - q:][::-1]  # v at the end, one before, ...
    k = part.shape[1]
    return Map(q, last[:, :k].T.copy(), last[:, k:k + q].copy(), np.stack([last[:, k + q + j * q:k + q + (j + 1) * q] for j in range(q)]) if q else np.zeros((0, 0, 0)),
               cols.T @ cols, n)


MAP = "sid long, block long, q int, k int, n long, m array<double>"


def _maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples():
            z, head = np.asarray(r.z, float), int(r.head)
            if len(z) > head:
                rows.append({"sid": r.sid, "block": r.block, **block_map(z, head, np.asarray(r.trial, float), int(r.p), int(r.q)).row()})
        if rows:
            yield pd.DataFrame(rows)


def _combined(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("block")
    maps = [Map.of(r) for r in g.itertuples()]
    whole = maps[0]
    for m in maps[1:]:
        whole = whole.then(m)
    return pd.DataFrame([{"sid": g["sid"].iloc[0], "block": int(g["block"].iloc[0]) // FAN_IN, **whole.row()}])


def gauss_newton(beta: list, step: list, sse: float, halved: int, evaluated: int, whole: Map, p: int, q: int) -> dict:
    """Take or shorten the step just tried, and propose the next one.

    The first step moves c and phi alone (theta is 0), which is a linear fit."""
    trial = np.asarray(beta) + np.asarray(step)
    k, new = 2 + p + q, float(whole.gram[0, 0])
    if not math.isfinite(new) or (evaluated >= 1 and new > sse * (1 + 1e-13)):
        step, halved = np.asarray(step) / 2, halved + 1
        done = halved > 20 or np.abs(step).max() <= 1e-10
        return {"beta": list(beta), "step": step.tolist(), "sse": sse, "halved": halved, "evaluated": evaluated + 1, "n": whole.n, "done": bool(done)}
    free = k - 1 if evaluated or not p else 1 + p
    jj, je = whole.gram[1:1 + free, 1:1 + free], whole.gram[1:1 + free, 0]
    scale = np.sqrt(np.maximum(np.diag(jj), 1e-300))
    move = -np.linalg.lstsq(jj / np.outer(scale, scale), je / scale, rcond=1e-12)[0] / scale
    step = np.zeros(k - 1)
    step[:free] = move
    done = evaluated and np.all(np.abs(step) <= 1e-9 * (1 + np.abs(trial)))
    return {"beta": trial.tolist(), "step": step.tolist(), "sse": new, "halved": 0, "evaluated": evaluated + 1, "n": whole.n, "done": bool(done)}


STATE = "sid long, p int, d int, q int, beta array<double>, step array<double>, sse double, halved int, evaluated int, n long, done boolean"


def _advanced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [{"sid": r.sid, "p": r.p, "d": r.d, "q": r.q, **gauss_newton(r.beta, r.step, r.sse, r.halved, r.evaluated, Map.of(r), int(r.p), int(r.q))} for r in b.itertuples()]
        if rows:
            yield pd.DataFrame(rows)


class ArimaFit:
    """``coefficients``: one row a series; ``fitted()``: one row a time point."""

    def __init__(self, coefficients: DataFrame, blocks: DataFrame, state: DataFrame, keys: list[str], order: str, names: DataFrame):
        self.coefficients, self._blocks, self._state, self._keys, self._order, self._names = coefficients, blocks, state, keys, order, names

    def fitted(self) -> DataFrame:
        """``keys, order, y, fitted, resid``: one-step predictions of the
        series itself.  The first d + p rows have none."""
        at = self._blocks.join(self._state.select("sid", "p", "q", F.col("beta").alias("trial")), "sid")
        maps = stored(at.mapInPandas(_maps, MAP), "arima-maps")
        state = stored(maps.groupBy("sid").applyInPandas(_entering, "sid long, block long, enters array<double>"), "arima-states")
        x = at.join(state, ["sid", "block"], "left").mapInPandas(_residuals, f"sid long, at array<{dict(self._blocks.select(F.col('at')[0].alias('x')).dtypes)['x']}>, y array<double>, e array<double>")
        x = x.select("sid", F.explode(F.arrays_zip("at", "y", "e")).alias("r")).select(
            "sid", F.col("r.at").alias(self._order), F.col("r.y").alias("y"), (F.col("r.y") - F.col("r.e")).alias("fitted"), F.col("r.e").alias("resid"))
        return x.join(self._names, "sid").select(*self._keys, self._order, "y", "fitted", "resid")


def _entering(g: pd.DataFrame) -> pd.DataFrame:
    """The state before each block, from one small map a block."""
    g, out, s = g.sort_values("block"), [], None
    for r in g.itertuples():
        m = Map.of(r)
        s = np.zeros(m.q) if s is None else s
        out.append((r.sid, r.block, s.tolist()))
        s = m.b[0] + m.a @ s
    return pd.DataFrame(out, columns=["sid", "block", "enters"])


def _residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples():
            z, head, own, beta, p = np.asarray(r.z, float), int(r.head), int(r.own), np.asarray(r.trial, float), int(r.p)
            e = np.full(len(z) - own, np.nan)
            if len(z) > head:
                theta, enters = beta[1 + p:], np.asarray(r.enters, float)
                e[head - own:] = recursion(innovations_drive(z, head, beta, p)[:, None], theta, enters[:, None])[:, 0]
            rows.append({"sid": r.sid, "at": list(r.at)[own:], "y": list(r.y)[own:], "e": [None if v != v else v for v in e.tolist()]})
        if rows:
            yield pd.DataFrame(rows)


def arima_fit(df: DataFrame, value: str, order: str, orders: DataFrame | Sequence[int], keys=None, block_rows: int | None = None) -> ArimaFit:
    """Fit ARIMA models by conditional least squares (innovations before the
    first d + p rows are 0), with a constant.

    ``orders`` is (p, d, q) for all series or a table of keys, p, d, q.  Null
    values are left out; ``order`` is unique per series.  Coefficients: keys,
    p, d, q, n, intercept, ar, ma (arrays), sigma2 (sum of squares over n), sse,
    aic (n ln sigma2 + 2 (p + q + 1)), evaluations.  A series with no more rows
    than d + p has no row there, and no fitted values."""
    ks, rows = _keys(keys), block_rows or BLOCK_ROWS
    x = df.where(F.col(value).isNotNull()).select(*ks, order, F.col(value).cast("double").alias("y"))
    names = x.select(*ks).distinct() if ks else df.sparkSession.range(1).select()
    names = stored(position(names, ks, out="sid") if ks else df.sparkSession.range(1).withColumnRenamed("id", "sid"), "arima-series")
    x = x.join(names, [x[k].eqNullSafe(names[k]) for k in ks]).select("sid", x[order].alias(order), "y") if ks else x.withColumn("sid", F.lit(0).cast("long"))
    if isinstance(orders, DataFrame):
        o = orders.alias("o").join(names.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ks]).select(
            "sid", F.col("o.p").cast("int").alias("p"), F.col("o.d").cast("int").alias("d"), F.col("o.q").cast("int").alias("q"))
    else:
        o = names.select("sid", *[F.lit(int(v)).alias(c) for c, v in zip("pdq", orders)])
    o = stored(o, "arima-orders")
    most = o.agg(F.max("p"), F.max("d")).first()
    most_p, most_d = (most[0] or 0), (most[1] or 0)
    x = x.join(o.select("sid", "d"), "sid").withColumn("z", F.col("y"))
    for i in range(most_d):  # a series' first row leaves with each difference
        x = stored(_differenced(x, "z", order, "sid", F.col("d") > i), "arima-differenced")
    # blocks of the order with the p rows before them
    x = ranked(x.select("sid", order, "y", "z"), order, "sid", "g").drop("_part").withColumn("home", F.floor(F.col("g") / rows))
    to = F.array("home")
    to = F.when(F.col("g") - F.col("home") * rows >= rows - most_p, F.array("home", F.col("home") + 1)).otherwise(to) if most_p else to
    x = x.withColumn("block", F.explode(to))
    blocks = x.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("g", F.col(order).alias("at"), "y", "z", "home"))).alias("r"))
    # a block that only holds the rows before it is none
    blocks = blocks.where(F.exists("r", lambda v: v["home"] == F.col("block"))).join(o.select("sid", "p"), "sid").select(
        "sid", "block", F.col("r.at").alias("at"), F.col("r.y").alias("y"), F.col("r.z").alias("z"),
        F.size(F.filter("r", lambda v: v["home"] < F.col("block"))).alias("own"),
        F.greatest(F.size(F.filter("r", lambda v: v["home"] < F.col("block"))), F.when(F.col("block") == 0, F.col("p")).otherwise(0)).alias("head"))
    blocks = stored(blocks, "arima-blocks")
    last = blocks.agg(F.max("block")).first()[0] or 0
    zero = F.array_repeat(F.lit(0.0), F.col("p") + F.col("q") + 1)
    state = stored(o.select("sid", "p", "d", "q", zero.alias("beta"), zero.alias("step"), F.lit(0.0).alias("sse"), F.lit(0).alias("halved"),
                            F.lit(0).alias("evaluated"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("done")), "arima-state")
    ended = []
    for _ in range(MOST_STEPS):
        at = state.select("sid", "p", "q", F.zip_with("beta", "step", lambda a, b: a + b).alias("trial"))
        maps, level = blocks.join(at, "sid").mapInPandas(_maps, MAP), last
        while True:
            maps = maps.groupBy("sid", F.floor(F.col("block") / FAN_IN).alias("g")).applyInPandas(_combined, MAP)
            if level < FAN_IN:
                break
            level //= FAN_IN
        state = stored(state.drop("n").join(maps.select("sid", "k", "n", "m"), "sid").mapInPandas(_advanced, STATE), "arima-state")
        ended.append(state.where("done"))
        state = state.where("not done")
        if not state.limit(1).count():
            break
    else:
        ended.append(state)
    state = ended[0]
    for s in ended[1:]:
        state = state.unionByName(s)
    state = stored(state, "arima-fitted")
    sigma2 = F.col("sse") / F.col("n")
    coef = state.join(names, "sid").select(
        *ks, "p", "d", "q", "n", F.col("beta")[0].alias("intercept"), F.slice("beta", F.lit(2), F.col("p")).alias("ar"),
        F.slice("beta", F.col("p") + 2, F.col("q")).alias("ma"), sigma2.alias("sigma2"), "sse",
        (F.col("n") * F.log(sigma2) + 2 * (F.col("p") + F.col("q") + 1)).alias("aic"), F.col("evaluated").alias("evaluations"))
    return ArimaFit(coef, blocks, state, ks, order, names)


def residual_panels(resid: DataFrame, order: str, value: str = "resid", max_lag: int = 10, points: int = 99) -> DataFrame:
    """The four panels of residual diagnostics as rows ``panel, x, y``.

    moments: mean, variance, skewness, excess kurtosis (x = 1 to 4);
    correlogram: correlation with the residual x rows before; quantiles: exact
    quantile of the standardised residuals (y) against the normal one (x) at
    ``points`` probabilities; density: share of standardised residuals per unit
    in bins of 0.25 (y) around x, to be held against the normal density."""
    e = stored(resid.where(F.col(value).isNotNull()).select(order, F.col(value).alias("e")), "residuals")
    probs = [i / (points + 1) for i in range(1, points + 1)]
    d = describe_columns(e, ["e"], probs)[0]
    mean, sd = d["mean"] or 0.0, d["std"] or 1.0
    z = (F.col("e") - F.lit(mean)) / F.lit(sd)
    m = e.agg(F.avg("e").alias("m1"), F.var_samp("e").alias("m2"), F.skewness("e").alias("m3"), F.kurtosis("e").alias("m4"))
    moments = m.select(F.posexplode(F.array("m1", "m2", "m3", "m4")).alias("x", "y")).select(F.lit("moments").alias("panel"), (F.col("x") + 1).cast("double").alias("x"), "y")
    lagged = with_lags(e, "e", order, range(1, max_lag + 1), fmt="l{k}").agg(*[F.corr("e", f"l{k}").alias(f"c{k}") for k in range(1, max_lag + 1)])
    acf = lagged.select(F.posexplode(F.array(*[f"c{k}" for k in range(1, max_lag + 1)])).alias("x", "y")).select(F.lit("correlogram").alias("panel"), (F.col("x") + 1).cast("double").alias("x"), "y")
    normal = NormalDist()
    q = e.sparkSession.createDataFrame([("quantiles", normal.inv_cdf(p), None if v is None else (v - mean) / sd) for p, v in zip(probs, d["quantiles"])], "panel string, x double, y double")
    share = e.groupBy((F.floor(z / 0.25) * 0.25 + 0.125).alias("x")).agg((F.count("*") / F.lit(max(d["count"], 1)) / 0.25).alias("y"))
    return moments.unionByName(acf).unionByName(q).unionByName(share.select(F.lit("density").alias("panel"), "x", "y"))
