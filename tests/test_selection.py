"""Order statistics by histograms over the bits of doubles."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loupe.operators import profile as P
from loupe.operators import selection as S


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=50))
def test_bits_keep_the_order(xs):
    x = np.array(xs)
    k = S.ordered_bits(x)
    assert (S.from_bits(k) == x).all()
    assert (np.argsort(k, kind="stable") == np.argsort(x + 0.0, kind="stable")).all()


def test_nan_is_largest():
    k = S.ordered_bits(np.array([np.inf, np.nan, -np.nan, -np.inf]))
    assert k[1] == k[2] > k[0] > k[3]


def test_285_columns_match_pandas(spark):
    """Normal, skewed, whole, constant, negative and mostly null columns."""
    rng, n = np.random.default_rng(5), 1500
    kinds = [lambda: rng.normal(size=n), lambda: rng.lognormal(3, 4, n), lambda: rng.integers(-5, 5, n).astype(float), lambda: np.full(n, 7.25),
             lambda: np.where(rng.random(n) < 0.97, np.nan, rng.normal(size=n)), lambda: 1e15 + rng.integers(0, 9, n), lambda: -rng.random(n) * 1e-300]
    pdf = pd.DataFrame({f"f{i}": kinds[i % 7]() for i in range(285)})
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    df = spark.createDataFrame(rows, ", ".join(f"f{i} double" for i in range(285))).repartition(5)
    want = pdf.describe().T
    got = {r["column"]: r for r in P.describe_numeric(df).collect()}
    assert len(got) == 285
    for c in pdf.columns:
        g, w = got[c], want.loc[c]
        assert g["count"] == w["count"] and g["min"] == w["min"] and g["max"] == w["max"]
        for a, b in ((g["p25"], w["25%"]), (g["p50"], w["50%"]), (g["p75"], w["75%"]), (g["mean"], w["mean"])):
            assert math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-320), c
        assert math.isclose(g["std"], (pdf[c] - pdf[c].min()).std(), rel_tol=1e-9, abs_tol=1e-320), c  # shifted: pandas itself cancels at 1e15


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    a, b = S.describe_columns(df, ["a", "b"])
    assert (a["count"], a["mean"], a["std"], a["min"], a["quantiles"]) == (0, None, None, None, [None] * 3)
    assert (b["count"], b["mean"], b["std"], b["min"], b["quantiles"]) == (1, 1.0, None, 1.0, [1.0] * 3)
    assert S.describe_columns(df.limit(0), ["a"])[0]["count"] == 0


@pytest.mark.parametrize("keys", [["k"], ["k", "j"], []])
def test_groups_match_pandas(spark, keys):
    """A hot group, a null key, a group with one value and one without."""
    rng = np.random.default_rng(8)
    rows = [("hot", int(i % 2), float(x)) for i, x in enumerate(rng.normal(size=3000))]
    rows += [(f"k{rng.integers(0, 40)}", int(rng.integers(0, 2)), float(x)) for x in rng.lognormal(0, 3, 2000)]
    rows += [(None, 0, float(x)) for x in rng.integers(0, 3, 50)] + [("one", 1, 4.5), ("none", 0, None)]
    pdf = pd.DataFrame(rows, columns=["k", "j", "v"])
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(6)
    got = S.quantiles_by(df, keys, "v", [0, 0.1, 0.5, 0.999, 1], ["a", "b", "c", "d", "e"]).collect()
    groups = pdf.dropna(subset="v").groupby(keys, dropna=False)["v"] if keys else [((), pdf["v"].dropna())]
    want = {tuple(None if isinstance(x, float) and math.isnan(x) else x for x in (k if isinstance(k, tuple) else (k,))): np.percentile(v, [0, 10, 50, 99.9, 100]) for k, v in groups}
    assert {tuple(r[k] for k in keys) for r in got} == set(want)
    for r in got:
        assert np.allclose([r.a, r.b, r.c, r.d, r.e], want[tuple(r[k] for k in keys)], rtol=1e-12, atol=0)
