"""Property tests: invariants and brute-force cross-checks on small inputs."""

import datetime
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loupe.operators import aggregate as A
from loupe.operators import models as MD
from loupe.operators import series as S
from loupe.operators import stats as ST
from tests.conftest import SF_SMALL
import __spark_entry__ as E


def _ar2(n=2000, seed=7):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for t in range(2, n):
        x[t] = 0.6 * x[t - 1] - 0.3 * x[t - 2] + rng.normal()
    return x


def test_shares_sum_to_one(spark):
    vc = A.value_counts(spark.read.parquet(f"{SF_SMALL}/orders.parquet"), "o_orderpriority")
    s = A.share_of_total(vc, "count", "share").agg(F.sum("share")).first()[0]
    assert math.isclose(s, 1.0)


def test_ecdf_monotone_ending_at_one(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    e = S.ecdf(li, "l_extendedprice").orderBy("l_extendedprice").collect()
    vals = [r["ecdf"] for r in e]
    assert all(a <= b for a, b in zip(vals, vals[1:]))
    assert math.isclose(vals[-1], 1.0)
    assert e[-1]["cum_n"] == li.count()


def test_cumulative_sum_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, 500)
    order = rng.permutation(500)
    vals = rng.integers(0, 10, 500)
    df = spark.createDataFrame([(int(k), int(o), int(v)) for k, o, v in zip(keys, order, vals)], "k int, o int, v int")
    got = {(r["k"], r["o"]): r["cum"] for r in S.cumulative_sum(df, "o", "v", keys="k").collect()}
    for k in range(3):
        idx = sorted(np.where(keys == k)[0], key=lambda i: order[i])
        c = np.cumsum(vals[idx])
        for j, i in enumerate(idx):
            assert got[(k, int(order[i]))] == c[j]


def test_kde_integrates_to_one(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    k = ST.kde_grid(li, "l_quantity").orderBy("grid_i").collect()
    xs = np.array([r["x"] for r in k])
    ys = np.array([r["density"] for r in k])
    area = float(np.sum((ys[1:] + ys[:-1]) / 2 * np.diff(xs)))
    assert abs(area - 1.0) < 0.01


def test_pacf_matches_least_squares(spark):
    x = _ar2()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, y double")
    p = {r["lag"]: (r["acf"], r["pacf"]) for r in ST.pacf(df, "y", "t", 6).collect()}
    assert math.isclose(p[1][0], p[1][1])
    # PACF(k) ~ last coefficient of an OLS AR(k) fit
    for k in (1, 2, 3):
        X = np.column_stack([np.ones(len(x) - k)] + [x[k - j - 1:len(x) - j - 1] for j in range(k)])
        b = np.linalg.lstsq(X, x[k:], rcond=None)[0]
        assert abs(p[k][1] - b[-1]) < 0.01
    assert abs(p[2][1] + 0.3) < 0.06


def test_adf_matches_numpy_regression(spark):
    rng = np.random.default_rng(1)
    walk = np.cumsum(rng.normal(size=400))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(walk)], "t int, y double")
    res = MD.adf_test(df, "y", "t", maxlag=2, autolag=None)
    dx = np.diff(walk)
    n = len(dx) - 2
    X = np.column_stack([np.ones(n), walk[2:-1], dx[1:-1], dx[:-2]])
    yv = dx[2:]
    b, ssr = np.linalg.lstsq(X, yv, rcond=None)[:2]
    se = math.sqrt(ssr[0] / (n - 4) * np.linalg.inv(X.T @ X)[1, 1])
    assert math.isclose(res["adf_stat"], b[1] / se, rel_tol=1e-6)
    assert res["pvalue"] > 0.05  # a random walk has a unit root
    stat = MD.adf_test(spark.createDataFrame([(i, float(v)) for i, v in enumerate(_ar2(600))], "t int, y double"),
                       "y", "t")
    assert stat["pvalue"] < 0.01


def test_arima_recovers_ar_order(spark):
    x = _ar2(1500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, y double")
    rows = MD.arima_select(df, "y", "t")
    best = [r for r in rows if r["chosen"]][0]
    assert best["d"] == 0 and best["p"] >= 2


def test_auc_matches_pairs(spark):
    rng = np.random.default_rng(5)
    s = rng.integers(0, 20, 300)
    y = (rng.random(300) < 0.3 + s / 40).astype(int)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y)], "score int, label int")
    got = MD.auc_rank(df, "score", "label").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert math.isclose(got, brute, rel_tol=1e-12)


def test_lowess_binned_matches_numpy(spark):
    rng = np.random.default_rng(2)
    xv = rng.random(300)
    yv = np.sin(3 * xv) + rng.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xv, yv)], "x double, y double")
    got = {r["centre_bin"]: r["fitted"] for r in ST.lowess_binned(df, "x", "y", bins=20).collect()}
    lo, hi = xv.min(), xv.max()
    b = np.minimum(np.floor((xv - lo) / ((hi - lo) / 20)), 19).astype(int)
    k = math.ceil(300 * 2 / 3)
    for cb in np.unique(b):
        c = xv[b == cb].mean()
        centres = {bb: xv[b == bb].mean() for bb in np.unique(b)}
        ds = sorted((abs(centres[bb] - c), bb) for bb in centres)
        cum, h = 0, None
        for dd, bb in ds:
            cum += np.sum(b == bb)
            if cum >= k:
                h = dd
                break
        d = np.abs(np.array([centres[bb] for bb in b]) - c)
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        W = np.diag(w)
        X = np.column_stack([np.ones(300), xv])
        beta = np.linalg.solve(X.T @ W @ X, X.T @ W @ yv)
        assert math.isclose(got[int(cb)], beta[0] + beta[1] * c, rel_tol=1e-8, abs_tol=1e-10)


def test_additive_components_sum_to_forecast(spark):
    q = E.queries()["forecast_components"](spark, SF_SMALL).collect()
    assert len(q) > 364
    for r in q[:50]:
        assert math.isclose(r["trend"] + r["weekly"] + r["yearly"] + r["holidays"], r["yhat"], rel_tol=1e-9, abs_tol=1e-9)
    f = E.queries()["additive_forecast"](spark, SF_SMALL).collect()
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in f)


def test_seeded_sample_is_stable_under_repartition(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang", "n_chars")
    key = [F.xxhash64("doc_id", F.lit(42)), F.col("doc_id")]
    a = [r[0] for r in A.top_k(docs.withColumn("_h", key[0]), [F.col("_h"), key[1]], 5).collect()]
    b = [r[0] for r in A.top_k(docs.repartition(7).withColumn("_h", key[0]), [F.col("_h"), key[1]], 5).collect()]
    assert a == b
    s = E.queries()["split_random"](spark, SF_SMALL)
    share = s.where("split = 'train'").count() / s.count()
    assert 0.7 < share < 0.9


def test_periodogram_finds_the_period(spark):
    n = 730
    t = np.arange(n)
    y = 0.01 * t + np.sin(2 * np.pi * t / 7)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, y)], "t int, y double")
    p = ST.periodogram(df, "y", "t", fs=1.0).orderBy(F.col("power").desc()).first()
    assert abs(p["freq"] - 1 / 7) < 1 / n


def test_distributed_exact_quantiles_match_numpy(spark):
    from loupe.operators import profile as P
    rng = np.random.default_rng(11)
    a = rng.normal(size=2000).round(3)
    b = rng.integers(0, 5, 2000).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = {r["column"]: (r["p25"], r["p50"], r["p75"]) for r in P.describe_numeric(df).collect()}
    for name, arr in (("a", a), ("b", b)):
        for g, e in zip(got[name], np.percentile(arr, [25, 50, 75])):
            assert math.isclose(g, e, rel_tol=1e-12, abs_tol=1e-12)


def test_grouped_cross_products_match_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), float(a), float(b)) for a, b in rng.normal(size=(400, 2))]
    df = spark.createDataFrame(rows, "k int, a double, b double").repartition(5)
    out = {r["k"]: r for r in MD.cross_products(df, ["a", "b"], keys="k").collect()}
    for k in range(3):
        m = np.array([(a, b) for kk, a, b in rows if kk == k])
        G, n = MD.gram_from_row(out[k], 2)
        assert n == len(m)
        assert np.allclose(G, m.T @ m)


def test_hot_key_operators_stay_exact(spark):
    """One key holds a third of the rows: the key-partitioned operators
    (running sums split into ranges, pre-aggregated joins, pre-limited top-n)
    still give exact answers."""
    from loupe.operators import relate as R
    from loupe.operators.nested import spans_from_pieces
    rng = np.random.default_rng(9)
    n = 3000
    keys = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 200, n))
    order = rng.permutation(n)
    lens = rng.integers(1, 50, n)
    rows = [(int(k), int(o), "x" * int(ln), "r") for k, o, ln in zip(keys, order, lens)]
    df = spark.createDataFrame(rows, "doc int, turn int, text string, role string").repartition(8)
    sp = {(r["doc"], r["turn"]): (r["piece_no"], r["start"], r["end"])
          for r in spans_from_pieces(df, "doc", "turn", "text", "role").collect()}
    idx = sorted(np.where(keys == 0)[0], key=lambda i: order[i])
    pos = 0
    for j, i in enumerate(idx):
        assert sp[(0, int(order[i]))] == (j + 1, pos, pos + int(lens[i]))
        pos += int(lens[i]) + 1
    facts = df.select(F.col("doc").alias("k"), F.length("text").alias("v"))
    dim = spark.createDataFrame([(k,) for k in range(0, 205)], "k int")
    cc = {r["k"]: r["long"] for r in R.conditional_counts_by_dim(dim, facts, "k", {"long": F.col("v") > 25}).collect()}
    assert cc[0] == int(np.sum(lens[keys == 0] > 25)) and cc[204] == 0
    top = A.top_n_per_group(facts, "k", [F.col("v").desc()], 2, "rk").where("k = 0").collect()
    assert sorted(r["v"] for r in top) == sorted(lens[keys == 0])[-2:]
    lj = R.left_join_skew_safe(dim, facts, "k")
    assert lj.count() == n + 5  # every fact row, plus dimension keys 200..204 without facts


def test_adf_pvalue_surface():
    # constant-term Dickey-Fuller distribution: p at the 1/5/10 % critical
    # values, and known mid-range points
    crit = MD.adf_critical(10 ** 9)
    assert abs(MD.adf_pvalue(crit["5%"]) - 0.05) < 0.005
    assert abs(MD.adf_pvalue(crit["10%"]) - 0.10) < 0.01
    assert abs(MD.adf_pvalue(crit["1%"]) - 0.01) < 0.002
    assert abs(MD.adf_pvalue(-1.0) - 0.753) < 0.01
    assert MD.adf_pvalue(3.0) == 1.0 and MD.adf_pvalue(-20.0) == 0.0
    ps = [MD.adf_pvalue(x / 10) for x in range(-60, 20)]
    assert all(a <= b for a, b in zip(ps, ps[1:]))


def test_halo_windows_equal_single_window(spark, monkeypatch):
    """Windows and lags over several blocks and ranges equal pandas' over the
    whole series."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(12)
    n = 1500
    rows = [(int(k), int(t), float(v)) for k, t, v in zip(rng.integers(0, 2, n), rng.permutation(n), rng.normal(size=n))]
    pdf = pd.DataFrame(rows, columns=["k", "t", "y"]).sort_values("t").reset_index(drop=True)
    df = spark.createDataFrame(rows, "k int, t int, y double").repartition(6)
    for keys in (None, "k"):
        parts = [pdf] if keys is None else [g.reset_index(drop=True) for _, g in pdf.groupby("k")]
        for nwin, centered, mp in (((5, 30), False, None), (30, False, 1), (7, True, 4), (12, True, None)):
            got = S.rolling(df, "y", "t", nwin, keys=keys, min_periods=mp, centered=centered, stats=("mean", "std")).toPandas().sort_values("t")
            for g in parts:
                mine = got[got.t.isin(g.t)].reset_index(drop=True)
                for m in [nwin] if isinstance(nwin, int) else nwin:
                    w = g.y.rolling(m, min_periods=mp, center=centered)
                    assert np.allclose(mine[f"y_roll{m}_mean"], w.mean(), rtol=1e-9, atol=1e-12, equal_nan=True)
                    assert np.allclose(mine[f"y_roll{m}_std"], w.std(), rtol=1e-9, atol=1e-9, equal_nan=True)
        got = S.with_lags(df, "y", "t", [1, 24], keys).toPandas().sort_values("t")
        for g in parts:
            mine = got[got.t.isin(g.t)].reset_index(drop=True)
            assert all(mine[f"y_lag_{k}"].equals(g.y.shift(k).rename(f"y_lag_{k}")) for k in (1, 24))


def test_ranks_and_fill_over_many_ranges(spark):
    """Ranks of a hot and a short series; gaps longer than a range are filled
    from an earlier one, and nulls inside present rows stay."""
    rng = np.random.default_rng(13)
    rows = [("hot", int(t), float(t)) for t in rng.permutation(2000)] + [("b", int(t), None) for t in range(7)] + [(None, 3, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, y double").repartition(5)
    for keys in (None, "k"):
        got = S.position(df, ["t", "k"] if keys is None else "t", keys, "rank").toPandas()
        for _, g in got.groupby("k", dropna=False) if keys else [(0, got)]:
            g = g.sort_values(["t", "k"], na_position="first")
            assert g["rank"].tolist() == list(range(len(g)))
    day = lambda t: datetime.date(2000, 1, 1) + datetime.timedelta(days=t)
    have = sorted({0, 1, 2, 900, 1999, *rng.integers(0, 60, 20).tolist()})
    facts = [("x", day(t), float(t) if t % 2 else None, t) for t in have] + [("y", day(t), 1.0, t) for t in (5, 700)]
    df = spark.createDataFrame(facts, "k string, ds date, y double, n int")
    for keys in (None, "k"):
        src = df.where("k = 'x'") if keys is None else df
        got = S.asfreq_pad(src, "ds", ["y", "n"], keys).toPandas()
        for k, g in got.groupby("k") if keys else [("x", got)]:
            g = g.sort_values("ds")
            days = [t for t in (have if k == "x" else [5, 700])]
            want = [max(d for d in days if d <= t) for t in range(days[0], days[-1] + 1)]
            assert g["n"].tolist() == want and g["present"].tolist() == [t in days for t in range(days[0], days[-1] + 1)]
            y = [1.0 if k == "y" else float(t) if t % 2 else None for t in want]
            assert g["y"].astype(object).where(g["y"].notna(), None).tolist() == y


def test_ols_by_key_matches_numpy(spark):
    rng = np.random.default_rng(21)
    rows = []
    for k in range(4):
        x = rng.normal(size=200)
        y = 2.0 * k + (k + 1) * x + rng.normal(scale=0.1, size=200)
        rows += [(k, float(a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "series int, x double, y double").repartition(5)
    got = {r["series"]: r for r in MD.ols_by_key(df, "series", ["x"], "y").collect()}
    for k in range(4):
        m = np.array([(a, b) for s, a, b in rows if s == k])
        X = np.column_stack([np.ones(len(m)), m[:, 0]])
        beta = np.linalg.lstsq(X, m[:, 1], rcond=None)[0]
        assert math.isclose(got[k]["coef_intercept"], beta[0], rel_tol=1e-8, abs_tol=1e-9)
        assert math.isclose(got[k]["coef_x"], beta[1], rel_tol=1e-8)
        resid = m[:, 1] - X @ beta
        r2 = 1 - resid @ resid / np.sum((m[:, 1] - m[:, 1].mean()) ** 2)
        assert got[k]["n"] == 200 and math.isclose(got[k]["r2"], r2, rel_tol=1e-8)


def test_adf_by_key_matches_single_series(spark):
    rng = np.random.default_rng(31)
    walk = np.cumsum(rng.normal(size=300))
    ar = _ar2(300, seed=3)
    rows = [(0, i, float(v)) for i, v in enumerate(walk)] + [(1, i, float(v)) for i, v in enumerate(ar)]
    df = spark.createDataFrame(rows, "s int, t int, y double").repartition(4)
    got = {r["s"]: r for r in MD.adf_by_key(df, "y", "t", "s", maxlag=6).collect()}
    for s_ in (0, 1):
        one = MD.adf_test(df.where(F.col("s") == s_).select("t", "y"), "y", "t", maxlag=6)
        assert got[s_]["usedlag"] == one["usedlag"] and got[s_]["nobs"] == one["nobs"]
        assert math.isclose(got[s_]["adf_stat"], one["adf_stat"], rel_tol=1e-7)
        assert math.isclose(got[s_]["pvalue"], one["pvalue"], rel_tol=1e-7, abs_tol=1e-12)
    assert got[0]["pvalue"] > 0.05 and got[1]["pvalue"] < 0.01


def test_arima_by_key_matches_single_series(spark):
    rng = np.random.default_rng(41)
    walk = np.cumsum(rng.normal(size=300))
    ar = _ar2(300, seed=5)
    rows = [(0, i, float(v)) for i, v in enumerate(walk)] + [(1, i, float(v)) for i, v in enumerate(ar)]
    df = spark.createDataFrame(rows, "s int, t int, y double").repartition(4)
    got = {}
    for r_ in MD.arima_select_by_key(df, "y", "t", "s", adf_maxlag=16).collect():
        got.setdefault(r_["s"], {})[(r_["p"], r_["q"])] = r_
    for s_ in (0, 1):
        one = MD.arima_select(df.where(F.col("s") == s_).select("t", "y"), "y", "t")
        for r1 in one:
            r2 = got[s_][(r1["p"], r1["q"])]
            assert r2["d"] == r1["d"] and r2["nobs"] == r1["nobs"] and r2["chosen"] == r1["chosen"]
            assert math.isclose(r2["aic"], r1["aic"], rel_tol=1e-7, abs_tol=1e-7)
    assert [k for k, v in got[0].items() if v["chosen"]] and next(iter(got[0].values()))["d"] >= 1
