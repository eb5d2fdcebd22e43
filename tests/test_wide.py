"""Correlations and distinct values of wide tables."""

import numpy as np
import pandas as pd

from loupe.operators import comoments as C
from loupe.operators import profile as P


def frame(spark, pdf):
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(4)


def test_285_columns_pairwise_complete(spark):
    rng, n = np.random.default_rng(3), 300
    base = rng.normal(size=(n, 5))
    pdf = pd.DataFrame({f"f{i}": base @ rng.normal(size=5) + rng.normal(size=n) + (1e9 if i % 10 == 0 else 0) for i in range(285)})
    for i in range(0, 285, 3):
        pdf.loc[rng.random(n) < 0.2, f"f{i}"] = np.nan
    pdf["f7"], pdf["f8"] = 3.1, np.nan
    pdf.loc[1:, "f9"] = np.nan
    df = frame(spark, pdf)
    plan = C.correlations(df, df.columns)._jdf.queryExecution().toString()
    assert plan.count("corr(") == 0
    got = C.correlations(df, df.columns).toPandas()
    assert len(got) == 285 * 284 // 2
    shifted = pdf - pdf.mean()
    want, has = shifted.corr(), pdf.notna().astype(int)
    both = has.T @ has
    for r in got.itertuples():
        w = want.loc[r.feature_i, r.feature_j]
        assert r.n == both.loc[r.feature_i, r.feature_j]
        if "f7" in (r.feature_i, r.feature_j) or r.n < 2:
            assert pd.isna(r.corr)
        else:
            assert abs(r.corr - w) < 1e-6 if 1e9 in (round(pdf[r.feature_i].mean(), -9), round(pdf[r.feature_j].mean(), -9)) else abs(r.corr - w) < 1e-12


def test_means_far_from_zero_do_not_cancel(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 100, 500).astype(float)
    pdf = pd.DataFrame({"a": a, "b": a + rng.integers(0, 10, 500) + 2.0**50, "c": a.max() - a - 2.0**40})
    got = {(r.feature_i, r.feature_j): r.corr for r in C.correlations(frame(spark, pdf), ["a", "b", "c"]).collect()}
    exact = pd.DataFrame({"a": a, "b": pdf.b - 2.0**50, "c": pdf.c + 2.0**40}).corr()
    assert all(abs(v - exact.loc[i, j]) < 1e-12 for (i, j), v in got.items())


def test_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD", 64)  # a task passes values on more than once
    n = 4000
    rows = [(i, i % 49, i % 50, None if i % 2 else "x", float("nan") if i % 3 else (-0.0 if i % 2 else 0.0), [i % 5, None], bytes([i % 7]), None) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a int, b int, s string, z double, l array<int>, y binary, e string").repartition(6)
    got = {r["column"]: r["nunique"] for r in P.nunique(df).collect()}
    assert got == {"id": n, "a": 49, "b": 50, "s": 1, "z": 2, "l": 5, "y": 7, "e": 0}
    assert "Expand" not in P.nunique(df)._jdf.queryExecution().toString()
    low = P.low_cardinality_values(df.select("id", "a", "b", "s", "e")).toPandas()
    assert low.groupby("column").size().to_dict() == {"a": 49, "s": 2, "e": 1}
    assert P.low_cardinality_values(df.select("a").limit(0)).count() == 0 and P.nunique(df.select("a").limit(0)).first()["nunique"] == 0
