"""Fitted ARIMA models against a plain recursion over the whole series."""

import datetime
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from loupe.operators import arima as AR


def plain(y, d, c, phi, theta):
    """Innovations of the differenced series, row by row."""
    z, p = np.diff(y, d), len(phi)
    e = np.zeros(len(z))
    for t in range(p, len(z)):
        e[t] = z[t] - c - sum(phi[i] * z[t - 1 - i] for i in range(p)) - sum(theta[j] * e[t - 1 - j] for j in range(len(theta)) if t - 1 - j >= p)
    return e[p:]


def simulated(n, d, c, phi, theta, seed):
    rng = np.random.default_rng(seed)
    e, z = rng.normal(size=n + 50), np.zeros(n + 50)
    for t in range(3, n + 50):
        z[t] = c + sum(f * z[t - 1 - i] for i, f in enumerate(phi)) + e[t] + sum(f * e[t - 1 - j] for j, f in enumerate(theta))
    z = z[50:]
    for _ in range(d):
        z = np.cumsum(z)
    return z


@pytest.mark.parametrize("p,q", [(0, 0), (1, 0), (0, 1), (2, 1), (1, 3), (3, 2)])
def test_maps_combine_to_the_whole(p, q):
    rng = np.random.default_rng(p * 10 + q)
    z, beta = rng.normal(size=90), np.concatenate([[0.3], rng.uniform(-0.3, 0.3, p + q)])
    whole = AR.block_map(z, p, beta, p, q)
    cuts = [p, 20, 37, 60, 90]
    maps = [AR.block_map(z[a - p:b], p, beta, p, q) for a, b in zip(cuts, cuts[1:])]
    joined = maps[0].then(maps[1]).then(maps[2].then(maps[3]))
    assert np.allclose(joined.gram, whole.gram) and np.allclose(joined.b, whole.b) and joined.n == whole.n
    assert np.allclose(joined.a, whole.a) and np.allclose(joined.x, whole.x)
    e = plain(z, 0, beta[0], beta[1:1 + p], beta[1 + p:])
    assert math.isclose(whole.gram[0, 0], e @ e, rel_tol=1e-12)
    for i in range(len(beta)):  # derivatives, by small steps
        h = np.zeros(len(beta))
        h[i] = 1e-6
        up, down = (plain(z, 0, b[0], b[1:1 + p], b[1 + p:]) for b in (beta + h, beta - h))
        assert math.isclose(whole.gram[1 + i, 0], ((up - down) / 2e-6) @ e, rel_tol=1e-5, abs_tol=1e-5)


def sse_of(y, d, r):
    e = plain(y, d, r.intercept, r.ar, r.ma)
    return e @ e


@pytest.mark.parametrize("p,d,q,phi,theta", [(1, 0, 1, [0.6], [0.4]), (2, 1, 0, [0.5, -0.3], []), (0, 1, 2, [], [-0.5, 0.2])])
def test_one_long_series(spark, p, d, q, phi, theta):
    y = simulated(1500, d, 0.2, phi, theta, 4)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)] + [(9999, None)], "t int, y double").repartition(5)
    fit = AR.arima_fit(df, "y", "t", (p, d, q), block_rows=100)
    r = fit.coefficients.first()
    assert np.allclose(r.ar, phi, atol=0.12) and np.allclose(r.ma, theta, atol=0.12) and abs(r.sigma2 - 1) < 0.15
    assert math.isclose(r.sse, sse_of(y, d, r), rel_tol=1e-9) and r.n == 1500 - d - p and math.isclose(r.sigma2, r.sse / r.n)
    base = np.array([r.intercept, *r.ar, *r.ma])  # a least sum: no small step lowers it
    for i in range(len(base)):
        for h in (1e-4, -1e-4):
            b = base.copy()
            b[i] += h
            e = plain(y, d, b[0], b[1:1 + p], b[1 + p:])
            assert e @ e >= r.sse
    got = fit.fitted().toPandas().sort_values("t")
    e = plain(y, d, r.intercept, r.ar, r.ma)
    assert got["t"].tolist() == list(range(d, 1500)) and got["resid"].isna().sum() == p
    assert np.allclose(got["resid"].to_numpy()[p:], e, atol=1e-9) and np.allclose((got["y"] - got["resid"]).to_numpy()[p:], got["fitted"].to_numpy()[p:])


def test_many_series_with_their_own_orders(spark):
    """A long series beside short ones, a null key, one too short to fit."""
    day = lambda t: datetime.date(2001, 1, 1) + datetime.timedelta(days=t)
    series = {"a": (simulated(900, 0, 1.0, [0.7], [], 1), (1, 0, 0)), "b": (simulated(300, 1, 0.0, [], [0.5], 2), (0, 1, 1)),
              None: (simulated(250, 0, -1.0, [0.4], [0.3], 3), (1, 0, 1)), "short": (np.array([1.0, 2.0]), (2, 0, 0))}
    df = spark.createDataFrame([(k, day(t), float(v)) for k, (y, _) in series.items() for t, v in enumerate(y)], "k string, ds date, y double")
    orders = spark.createDataFrame([(k, *o) for k, (_, o) in series.items()], "k string, p int, d int, q int")
    fit = AR.arima_fit(df, "y", "ds", orders, "k", block_rows=128)
    got = {r.k: r for r in fit.coefficients.collect()}
    assert set(got) == {"a", "b", None}
    rows = fit.fitted().toPandas()
    for k, r in got.items():
        y, (p, d, q) = series[k]
        assert (r.p, r.d, r.q) == (p, d, q) and math.isclose(r.sse, sse_of(y, d, r), rel_tol=1e-9)
        mine = rows[rows.k.isna() if k is None else rows.k == k].sort_values("ds")
        assert mine["ds"].tolist() == [day(t) for t in range(d, len(y))]
        assert np.allclose(mine["resid"].to_numpy()[p:], plain(y, d, r.intercept, r.ar, r.ma), atol=1e-9)


def test_residual_panels(spark):
    rng = np.random.default_rng(6)
    e = rng.normal(2, 3, 2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(e)], "t int, resid double").repartition(4)
    got = AR.residual_panels(df, "t").toPandas()
    m = got[got.panel == "moments"].sort_values("x")["y"].tolist()
    s = pd.Series(e)
    assert np.allclose(m[:2], [s.mean(), s.var()]) and abs(m[2]) < 0.2 and abs(m[3]) < 0.4
    for r in got[got.panel == "correlogram"].itertuples():
        assert math.isclose(r.y, s.corr(s.shift(int(r.x))), abs_tol=1e-12)
    q = got[got.panel == "quantiles"].sort_values("x")
    want = (np.percentile(e, np.arange(1, 100)) - s.mean()) / s.std()
    assert np.allclose(q["y"], want) and np.allclose(q["x"], [NormalDist().inv_cdf(i / 100) for i in range(1, 100)])
    d = got[got.panel == "density"]
    assert math.isclose(d["y"].sum() * 0.25, 1) and abs(d[(d.x - 0.125).abs() < 1e-9]["y"].iloc[0] - 0.396) < 0.08
