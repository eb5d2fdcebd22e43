"""Past the limits that earlier versions had."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loupe.operators import models as MD
from loupe.operators import series as S
from loupe.operators import stats as ST
from loupe.functions import text as T
from loupe.sources.html import parse_tables


def test_tag_pairs_of_1500_tags(spark):
    df = spark.range(3000).select(F.array_sort(F.array_distinct(F.array(*[
        F.format_string("t%04d", F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1500))) for k in range(4)]))).alias("tags"))
    got = ST.tag_pairs(df, "tags")
    k = df.select(F.explode("tags")).distinct().count()
    assert k > 1001 and got.count() == k * (k - 1) // 2
    x = pd.DataFrame({t: [0.0] * 3000 for t in ("t0000", "t0001", "t0700", "t1400")})
    for i, r in enumerate(df.collect()):
        for t in x.columns:
            x.loc[i, t] = float(t in r.tags)
    want = x.corr()
    for r in got.where(F.col("feature_i").isin(*x.columns) & F.col("feature_j").isin(*x.columns)).collect():
        assert abs(r["corr"] - want.loc[r.feature_i, r.feature_j]) < 1e-9


def test_adf_by_key_uses_each_series_own_lag_limit(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=700)
    y = e.copy()
    for i in range(16, 700):
        y[i] += 0.7 * y[i - 16]
    rows = [("long", i, float(v)) for i, v in enumerate(np.cumsum(y[100:]) * 0.01 + y[100:])] + [
        ("short", i, float(v)) for i, v in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "s string, t int, y double")
    by = {r["s"]: r for r in MD.adf_by_key(df, "y", "t", "s").collect()}
    for s in ("long", "short"):
        one = MD.adf_test(df.where(F.col("s") == s), "y", "t")
        one = one if isinstance(one, dict) else one.first().asDict()
        assert by[s]["usedlag"] == one["usedlag"] and abs(by[s]["adf_stat"] - one["adf_stat"]) < 1e-6


def test_even_centred_window_matches_pandas(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "t int, y double")
    for rows in (1 << 16, 4):  # in one block, and in two
        monkeypatch.setattr(S, "BLOCK_ROWS", rows)
        got = S.rolling(df, "y", "t", 4, min_periods=1, stats=("sum",), centered=True).orderBy("t")
        assert [r["y_roll4_sum"] for r in got.collect()] == [3, 6, 10, 14, 18, 15] == list(
            pd.Series(range(1, 7)).rolling(4, center=True, min_periods=1).sum())


def test_unicode_space_separates_words(spark):
    df = spark.createDataFrame([("a\u00a0b\u3000c",)], "t string")
    assert df.select(T.word_count("t")).first()[0] == 3


def test_tables_nested_and_without_end_tags():
    assert parse_tables("<table><tr><td>a<table><tr><td>x</td></tr></table> b</td><td>c</td></tr></table>") == [[["a b", "c"]], [["x"]]]
    assert parse_tables("<table><tr><td>a<td>b<tr><td>c<td>d</table>") == [[["a", "b"], ["c", "d"]]]


def test_reports_keep_every_category(spark, tmp_path):
    from loupe.plans import q_relational as R
    from loupe.plans import q_reports as P
    orders = [("F", "1-URGENT"), ("F", "6-NEW.ER"), ("F", "6-NEW.ER"), ("X", "5-LOW")]
    spark.createDataFrame(orders, "o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([("A", "F"), ("Z", "Q")], "l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "BUILDING", 1), (2, "SPACE", 1), (3, "SPACE", 1), (4, "SPACE", 1)],
                          "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "PERU")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    rows = lambda f, k: {x[k]: x.asDict() for x in f(spark, str(tmp_path)).collect()}
    assert rows(R.pivot_counts, "o_orderstatus")["F"] == {"o_orderstatus": "F", "1-URGENT": 1, "5-LOW": 0, "6-NEW.ER": 2}
    assert rows(R.row_share, "o_orderstatus")["F"]["total"] == 3 and rows(R.row_share, "o_orderstatus")["F"]["6-NEW.ER"] == 0.666667
    assert rows(R.crosstab_normalized, "o_orderpriority")["5-LOW"] == {"o_orderpriority": "5-LOW", "F": None, "X": 1.0}
    assert rows(R.transpose_small, "l_linestatus") == {"F": {"l_linestatus": "F", "A": 1, "Z": 0}, "Q": {"l_linestatus": "Q", "A": 0, "Z": 1}}
    assert rows(P.share_by_top_group, "n_name") == {"PERU": {"n_name": "PERU", "total": 4, "BUILDING": 0.25, "SPACE": 0.75}}
