"""Values of the model queries: held-out accuracy of the trees, reports
against plain computations, and orders of known series."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as E
from loupe.operators import models as MD
from loupe.operators import stats as ST
from tests.conftest import SF_SMALL


def test_tree_classifier_on_unseen_rows(spark):
    """Rule: high a, or colour red with b above 0; some numbers are missing
    (filled with the most frequent one), and unseen rows have a new colour."""
    rng, n = np.random.default_rng(1), 3000
    a, b, colour = rng.normal(size=n).round(2), rng.normal(size=n).round(2), rng.choice(["red", "blue", "green"], n)
    y = ((a > 0.8) | ((colour == "red") & (b > 0))).astype(float)
    rows = [(int(i), None if i % 50 == 0 else float(a[i]), float(b[i]), str(colour[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double, colour string, label double")
    model = MD.gbt_classifier_pipeline(["a", "b"], ["colour"], "label", max_iter=10).fit(df.where("id < 2200"))
    unseen = df.where("id >= 2200").withColumn("colour", F.when(F.col("id") % 97 == 0, "violet").otherwise(F.col("colour")))
    got = model.transform(unseen).select("id", "prediction", "label").toPandas()
    assert len(got) == 800 and (got.prediction == got.label).mean() > 0.95
    scored = model.transform(unseen.drop("label"))  # a table without the label
    assert scored.select("id", "prediction").count() == 800


def test_tree_regressor_on_unseen_rows(spark):
    rng, n = np.random.default_rng(2), 3000
    x, kind = rng.uniform(0, 10, n), rng.choice(["p", "q"], n)
    y = np.where(kind == "p", 3 * x, 30 - x) + rng.normal(size=n) * 0.3
    df = spark.createDataFrame([(int(i), float(x[i]), str(kind[i]), float(y[i])) for i in range(n)], "id int, x double, kind string, y double")
    model = MD.gbt_regressor_pipeline(["x"], ["kind"], "y", max_iter=15).fit(df.where("id < 2400"))
    got = model.transform(df.where("id >= 2400")).select("prediction", "y").toPandas()
    assert ((got.prediction - got.y) ** 2).mean() < 0.05 * got.y.var()


def test_tree_regressor_equals_trees_over_all_rows_and_reads_few(spark, monkeypatch):
    """Up to 32 values: the trees are those over the rows.  More: bins bound the counted rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    rng, n = np.random.default_rng(5), 4000
    x, kind = rng.integers(0, 20, n) / 4, rng.integers(0, 3, n)
    y = np.where(kind == 1, x * x, 9 - x) + rng.normal(size=n)
    df = spark.createDataFrame([(float(x[i]), str(kind[i]), float(kind[i]), float(y[i]), float(rng.normal())) for i in range(n)], "x double, kind string, k double, y double, z double")
    counts, real = [], MD.materialize
    monkeypatch.setattr(MD, "materialize", lambda t: (counts.append((u := real(t)).count()), u)[1])
    got = MD.gbt_regressor_pipeline(["x"], ["kind"], "y", max_iter=8).fit(df).transform(df).select("x", "k", "prediction").distinct().toPandas()
    rows = VectorAssembler(inputCols=["x", "k"], outputCol="f").transform(df)
    want = GBTRegressor(featuresCol="f", labelCol="y", maxIter=8, maxDepth=5, seed=42).fit(rows).transform(rows).select("x", "k", "prediction").distinct().toPandas()
    both = got.merge(want, on=["x", "k"])
    assert len(both) == 60 and np.allclose(both.prediction_x, both.prediction_y) and counts == [60]
    MD.gbt_regressor_pipeline(["z"], ["kind"], "y", max_iter=2).fit(df)
    assert 60 < counts[1] <= 32 * 3


def test_tabular_regress_on_unseen_rows(spark):
    """The generated prices do not depend on the features: the trees must not
    do worse than the mean, and stay in the allowed range."""
    got = E.queries()["tabular_regress"](spark, "/root/testdata/sf0.01").toPandas()
    err = ((got.prediction - got.l_extendedprice) ** 2).mean()
    assert err < 1.02 * got.l_extendedprice.var() and got.prediction.between(0, 125000).all()


def daily(spark, scale=1.0):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(F.to_date("o_orderdate").alias("ds"), "o_totalprice").toPandas()
    return o.groupby("ds").o_totalprice.sum().sort_index() / scale


def test_stationarity_report_values(spark):
    s, got = daily(spark), E.queries()["stationarity_report"](spark, SF_SMALL).toPandas().sort_values("ds")
    assert np.allclose(got.y, s) and np.allclose(got.roll_mean, s.rolling(12).mean(), equal_nan=True)
    assert np.allclose(got.roll_std, s.rolling(12).std(), equal_nan=True)
    one = MD.adf_test(spark.createDataFrame([(k, float(v)) for k, v in enumerate(s)], "t int, y double"), "y", "t")
    assert np.allclose(got.adf_stat, one["adf_stat"]) and np.allclose(got.adf_pvalue, one["pvalue"]) and (got.stationary == (one["pvalue"] < 0.05)).all()


def test_series_report_values(spark):
    s, got = daily(spark, 1e6), E.queries()["series_report"](spark, SF_SMALL).toPandas().sort_values("ds").reset_index(drop=True)
    n = len(s)
    hist, ahead = got[~got.is_forecast], got[got.is_forecast]
    assert len(hist) == n and len(ahead) == 30 and np.allclose(hist.y, s) and np.allclose(hist.y_lag_1, s.shift(1), equal_nan=True)
    b, a = np.polyfit(np.arange(1, n + 1), s, 1)
    assert np.allclose(got.y_fit, a + b * np.arange(1, n + 31)) and got.trend.tolist() == list(range(1, n + 31))
    assert ahead.ds.tolist() == [s.index[-1] + pd.Timedelta(days=k).to_pytimedelta() for k in range(1, 31)]


def test_orders_of_known_series(spark):
    """The search finds the difference order of a random walk and of noise
    around a level, and prefers the true lag of an autoregression."""
    rng = np.random.default_rng(5)
    e = rng.normal(size=1500)
    ar = np.zeros(1500)
    for t in range(2, 1500):
        ar[t] = 0.5 * ar[t - 1] + 0.3 * ar[t - 2] + e[t]
    series = {"walk": np.cumsum(rng.normal(size=1500)), "noise": rng.normal(size=1500) + 3, "ar": ar}
    df = spark.createDataFrame([(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y)], "k string, t int, y double")
    best = {r.k: r for r in MD.arima_select_by_key(df, "y", "t", "k").where("chosen").collect()}
    assert best["walk"].d == 1 and best["noise"].d == 0 and best["ar"].d == 0 and best["ar"].p + best["ar"].q >= 2
    one = [r for r in MD.arima_select(df.where("k = 'ar'"), "y", "t") if r["chosen"]][0]
    assert (one["p"], one["d"], one["q"]) == (best["ar"].p, best["ar"].d, best["ar"].q) and math.isclose(one["aic"], best["ar"].aic, rel_tol=1e-9)


def test_tag_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ST, "TAG_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(sorted({f"t{i:02d}" for i in rng.integers(0, 18, rng.integers(1, 6))}),) for _ in range(400)]
    df = spark.createDataFrame(rows, "tags array<string>")
    tags = sorted({t for r in rows for t in r[0]})
    want = pd.DataFrame([[float(t in r[0]) for t in tags] for r in rows], columns=tags).corr()
    got = ST.tag_pairs(df, "tags").collect()
    assert len(got) == len(tags) * (len(tags) - 1) // 2
    assert all(r.feature_i > r.feature_j and abs(r["corr"] - want.loc[r.feature_i, r.feature_j]) < 1e-12 for r in got)


def test_kernel_density_of_many_values(spark):
    """Against the sum over all values, for skewed groups, one value, and two."""
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=700), "b": rng.lognormal(0, 1.5, 400), "one": np.array([2.0]), "same": np.full(5, 3.0), "two": np.array([0.0, 1.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None)], "k string, x double").repartition(4)
    got = ST.kde_grid(df, "x", "k").toPandas()
    for k, v in groups.items():
        g = got[got.k == k].sort_values("grid_i")
        assert len(g) == 200
        if k in ("one", "same"):
            assert g.density.isna().all()
            continue
        h = v.std(ddof=1) * len(v) ** -0.2
        x = v.min() - 3 * h + np.arange(200) * (v.max() - v.min() + 6 * h) / 199
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.allclose(g.x, x) and np.abs(g.density - want).max() < 1e-12
    whole = ST.kde_grid(df.where("k = 'a'"), "x").toPandas().sort_values("grid_i")
    assert np.allclose(whole.density, got[got.k == "a"].sort_values("grid_i").density)
