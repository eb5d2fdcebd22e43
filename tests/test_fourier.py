"""Blocked Fourier transform against numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.operators import fourier as FT
from loupe.operators import stats as ST


@pytest.mark.parametrize("n", [1, 2, 3, 5, 31, 64, 97, 1000, 2399, 4096])
def test_any_length(spark, n, monkeypatch):
    monkeypatch.setattr(FT, "WIDTH", 8)
    x = np.random.default_rng(n).normal(size=n) * 10
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, x double").repartition(3)
    got = FT.transform(df, "t", "x", n).toPandas().sort_values("k")
    assert got["k"].tolist() == list(range(n))
    want = np.fft.fft(x)
    assert np.abs(got["re"] + 1j * got["im"] - want).max() < 1e-12 * max(np.abs(want).max(), 1) * np.sqrt(n)


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (3, 2.0), (4, None)], "t long, x double")
    got = FT.transform(df, "t", "x", 6).toPandas().sort_values("k")
    assert np.allclose(got["re"] + 1j * got["im"], np.fft.fft([1, 0, 0, 2, 0, 0]))
    assert FT.transform(df.limit(0), "t", "x", 0).count() == 0


def test_a_million_points(spark):
    n = 1_000_003
    df = spark.range(n).select(F.col("id").alias("t"), (3 * F.sin(F.lit(2 * np.pi * 1234 / n) * F.col("id")) + 0.001 * F.pmod(F.xxhash64("id"), F.lit(1000))).alias("y"))
    p = ST.periodogram(df, "y", "t", fs=1.0)
    top = p.orderBy(F.col("power").desc()).first()
    assert p.count() == n // 2 + 1 and top["k"] == 1234 and abs(top["power"] - 4.5) < 1e-2
    y = np.array([r.y for r in df.orderBy("t").select("y").collect()])
    t = np.arange(n)
    b, a = np.polyfit(t, y, 1)
    want = np.abs(np.fft.rfft(y - a - b * t)) ** 2 / n**2 * 2
    got = p.orderBy("k").toPandas()["power"].to_numpy()
    assert np.abs(got[1:] - want[1:]).max() < 1e-9
