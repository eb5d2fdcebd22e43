"""Ordered and time-series queries (WIN*, PRJ10, TSF1-2, DTE7, FIL10,
SRC7, UDF12, CMP1-2).  The price-series analogue is the daily total of
``orders``; the second series is the daily shipped quantity of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators import series as S
from loupe.operators.aggregate import value_counts
from loupe.plans.common import r
from loupe.plans.registry import query
from loupe.sources.tables import Tables

DAILY_SQL = "(SELECT CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS y FROM orders GROUP BY 1)"
SHIP_SQL = "(SELECT CAST(l_shipdate AS DATE) AS ds, sum(l_quantity) AS q FROM lineitem GROUP BY 1)"


def daily_orders(t: Tables):
    return S.daily(t.orders, "o_orderdate", F.sum("o_totalprice"))


def daily_ships(t: Tables):
    return S.daily(t.lineitem, "l_shipdate", F.sum("l_quantity"), out="q")


def _win(n_pre, n_post=0):
    pre = f"{n_pre} PRECEDING" if n_pre else "CURRENT ROW"
    post = f"{n_post} FOLLOWING" if n_post else "CURRENT ROW"
    return f"ORDER BY ds ROWS BETWEEN {pre} AND {post}"


@query("time_dummy", oracle=f"""
SELECT ds, round(y, 6) AS y, row_number() OVER (ORDER BY ds) - 1 AS t FROM {DAILY_SQL}""")
def time_dummy(spark, d):
    """A counter along the daily series."""
    s = S.position(daily_orders(Tables(spark, d)), "ds")
    return s.select("ds", r("y", 6).alias("y"), "t")


@query("lag_feature", oracle=f"""
SELECT ds, round(y, 6) AS y, round(lag(y, 1) OVER (ORDER BY ds), 6) AS y_lag_1 FROM {DAILY_SQL}""")
def lag_feature(spark, d):
    """The value one day before."""
    s = S.with_lags(daily_orders(Tables(spark, d)), "y", "ds", [1])
    return s.select("ds", r("y", 6).alias("y"), r("y_lag_1", 6).alias("y_lag_1"))


@query("rolling_mean_partial", oracle=f"""
SELECT ds, q, """ + ", ".join(
    f"round(avg(q) OVER ({_win(n - 1)}), 6) AS q_roll{n}_mean" for n in (4, 16, 28, 40, 52)) + f" FROM {SHIP_SQL}")
def rolling_mean_partial(spark, d):
    """Trailing means with partial windows allowed (min_periods=1)."""
    s = daily_ships(Tables(spark, d))
    s = S.rolling(s, "q", "ds", (4, 16, 28, 40, 52), min_periods=1)
    return s.select("ds", "q", *[r(f"q_roll{n}_mean").alias(f"q_roll{n}_mean") for n in (4, 16, 28, 40, 52)])


@query("rolling_mean_std_full", oracle=f"""
SELECT ds, round(y, 6) AS y,
       round(CASE WHEN count(y) OVER ({_win(11)}) >= 12 THEN avg(y) OVER ({_win(11)}) END, 6) AS y_roll12_mean,
       round(CASE WHEN count(y) OVER ({_win(11)}) >= 12 THEN stddev_samp(y) OVER ({_win(11)}) END, 6) AS y_roll12_std
FROM {DAILY_SQL}""")
def rolling_mean_std_full(spark, d):
    """rolling(12).mean()/.std(): NULL until 12 values are in the window."""
    s = S.rolling(daily_orders(Tables(spark, d)), "y", "ds", 12, stats=("mean", "std"))
    return s.select("ds", r("y", 6).alias("y"), r("y_roll12_mean", 6).alias("y_roll12_mean"),
                    r("y_roll12_std", 6).alias("y_roll12_std"))


@query("rolling_centered", oracle=f"""
SELECT ds, round(CASE WHEN count(y) OVER ({_win(182, 182)}) >= 183 THEN avg(y) OVER ({_win(182, 182)}) END, 6)
       AS y_roll365_mean FROM {DAILY_SQL}""")
def rolling_centered(spark, d):
    """365-row centred mean, at least 183 values."""
    s = S.rolling(daily_orders(Tables(spark, d)), "y", "ds", 365, min_periods=183, centered=True)
    return s.select("ds", r("y_roll365_mean", 6).alias("y_roll365_mean"))


@query("resample_weekly", oracle=f"""
WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week, avg(o_totalprice) AS y
           FROM orders GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM w)
SELECT cal.week, round(w.y, 6) AS y FROM cal LEFT JOIN w USING (week)""")
def resample_weekly(spark, d):
    """Weekly mean (weeks end Sunday, labelled by it); empty weeks are NULL rows."""
    w = S.resample_weekly(Tables(spark, d).orders, "o_orderdate", "o_totalprice")
    return w.select("week", r("y").alias("y"))


@query("asfreq_daily_pad", oracle="""
WITH s AS (SELECT o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS ds, round(sum(o_totalprice), 6) AS y, count(*) AS n
           FROM orders GROUP BY 1, 2, 3),
cal AS (SELECT o_orderpriority, o_orderstatus, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM s GROUP BY 1, 2)
SELECT cal.*, EXISTS (SELECT 1 FROM s t WHERE t.o_orderpriority = cal.o_orderpriority AND t.o_orderstatus = cal.o_orderstatus AND t.ds = cal.ds) AS present, s.y, s.n
FROM cal ASOF LEFT JOIN s ON cal.o_orderpriority = s.o_orderpriority AND cal.o_orderstatus = s.o_orderstatus AND cal.ds >= s.ds""")
def asfreq_daily_pad(spark, d):
    """Every calendar day of each priority and status; missing days repeat the
    last present day's row."""
    keys = ["o_orderpriority", "o_orderstatus"]
    s = Tables(spark, d).orders.groupBy(*keys, F.to_date("o_orderdate").alias("ds")).agg(
        r(F.sum("o_totalprice"), 6).alias("y"), F.count(F.lit(1)).alias("n"))
    return S.asfreq_pad(s, "ds", ["y", "n"], keys)


@query("ecdf", oracle="""
WITH c AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_quantity, n, CAST(sum(n) OVER (ORDER BY l_quantity) AS BIGINT) AS cum_n,
       round(sum(n) OVER (ORDER BY l_quantity) / sum(n) OVER (), 9) AS ecdf FROM c""")
def ecdf(spark, d):
    """Share of rows up to each value."""
    e = S.ecdf(Tables(spark, d).lineitem, "l_quantity")
    return e.select("l_quantity", "n", "cum_n", r("ecdf", 9).alias("ecdf"))


_STATUS_YEAR_SQL = """(SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n
  FROM orders GROUP BY 1, 2)"""


def _status_year(t):
    o = t.orders.withColumn("year", F.year("o_orderdate"))
    return value_counts(o, ["year", "o_orderstatus"], "n", ordered=False)


@query("stacked_cumsum", oracle=f"""
WITH c AS {_STATUS_YEAR_SQL},
g AS (SELECT y.year, s.o_orderstatus, s.pos FROM (SELECT DISTINCT year FROM c) y,
      (VALUES ('F', 0), ('O', 1), ('P', 2)) s(o_orderstatus, pos))
SELECT g.year, g.o_orderstatus, coalesce(c.n, 0) AS n,
       CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.year ORDER BY g.pos) AS BIGINT) AS stacked
FROM g LEFT JOIN c USING (year, o_orderstatus)""")
def stacked_cumsum(spark, d):
    """Per year, statuses stacked in list order (F, then F+O, then F+O+P)."""
    return S.stacked_cumsum(_status_year(Tables(spark, d)), "year", "o_orderstatus", "n", ["F", "O", "P"])


@query("running_total", oracle=f"""
SELECT year, o_orderstatus, n, CAST(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY year) AS BIGINT) AS running
FROM {_STATUS_YEAR_SQL}""")
def running_total(spark, d):
    """True running total over time per status."""
    return S.running_total(_status_year(Tables(spark, d)), "year", "n", "o_orderstatus")


@query("streamgraph_baseline", oracle=f"""
WITH c AS {_STATUS_YEAR_SQL},
g AS (SELECT y.year, s.layer, s.pos FROM (SELECT DISTINCT year FROM c) y,
      (VALUES ('base', 0), ('F', 1), ('O', 2), ('P', 3)) s(layer, pos)),
v AS (SELECT g.year, g.layer, g.pos, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON c.year = g.year AND c.o_orderstatus = g.layer)
SELECT year, layer, CAST(sum(n) OVER (PARTITION BY year ORDER BY pos) AS DOUBLE)
       - sum(n) OVER (PARTITION BY year) / 2.0 AS value FROM v""")
def streamgraph_baseline(spark, d):
    """Stream-graph layers: a zero 'base' layer inserted first, layers
    stacked, then shifted down by half of each year's total (symmetric)."""
    c = _status_year(Tables(spark, d))
    st = S.stacked_cumsum(c.withColumnRenamed("o_orderstatus", "layer"), "year", "layer", "n",
                          ["base", "F", "O", "P"])
    tot = c.groupBy("year").agg(F.sum("n").alias("_tot"))
    j = st.join(tot, "year")
    return j.select("year", "layer", (F.col("stacked") - F.col("_tot") / 2.0).alias("value"))


@query("future_calendar", oracle=f"""
SELECT ds, round(y, 6) AS y, false AS is_future FROM {DAILY_SQL}
UNION ALL
SELECT CAST(unnest(generate_series((SELECT max(ds) FROM {DAILY_SQL}) + 1, (SELECT max(ds) FROM {DAILY_SQL}) + 30,
       INTERVAL 1 DAY)) AS DATE), NULL, true""")
def future_calendar(spark, d):
    """History plus the next 30 days (keys for forecasting)."""
    s = daily_orders(Tables(spark, d))
    fut = S.future_dates(s, "ds", 30)
    return (s.select("ds", r("y", 6).alias("y"), F.lit(False).alias("is_future"))
            .unionByName(fut.select("ds", F.lit(None).cast("double").alias("y"), F.lit(True).alias("is_future"))))


@query("split_ordered", oracle=f"""
WITH s AS (SELECT ds, y, row_number() OVER (ORDER BY ds) - 1 AS p, count(*) OVER () AS n FROM {DAILY_SQL})
SELECT ds, round(y, 6) AS y, CASE WHEN p < floor(0.9 * n) THEN 'train' ELSE 'test' END AS split
FROM s WHERE p >= 3""")
def split_ordered(spark, d):
    """Ordered split: rows [3, 0.9n) train, [0.9n, n) test."""
    s = S.ordered_split(daily_orders(Tables(spark, d)), "ds", 0.9, skip=3)
    return s.select("ds", r("y", 6).alias("y"), "split")


@query("two_series_cut", oracle=f"""
SELECT coalesce(a.ds, b.ds) AS ds, round(a.y, 6) AS orders_total, b.q AS shipped_qty
FROM {DAILY_SQL} a FULL OUTER JOIN {SHIP_SQL} b ON a.ds = b.ds
WHERE coalesce(a.ds, b.ds) <= DATE '2000-06-14'""")
def two_series_cut(spark, d):
    """Two daily series aligned on date and cut at a stated date."""
    t = Tables(spark, d)
    a = daily_orders(t).where(F.col("ds") <= F.lit("2000-06-14").cast("date"))
    b = daily_ships(t).where(F.col("ds") <= F.lit("2000-06-14").cast("date"))
    return a.join(b, "ds", "full").select("ds", r("y", 6).alias("orders_total"), F.col("q").alias("shipped_qty"))


@query("series_slice", oracle="""
SELECT CAST(o_orderdate AS DATE) AS ds, o_totalprice FROM orders WHERE o_custkey = 10""")
def series_slice(spark, d):
    """Keyed slice of a stored series (one customer's orders), time ordered."""
    o = Tables(spark, d).orders.where(F.col("o_custkey") == 10)
    return o.select(F.to_date("o_orderdate").alias("ds"), "o_totalprice").orderBy("ds")


@query("trend_features", oracle=f"""
SELECT ds, 1.0::DOUBLE AS const, row_number() OVER (ORDER BY ds) AS trend FROM {DAILY_SQL}""")
def trend_features(spark, d):
    """Constant and linear trend along the series."""
    s = S.position(daily_orders(Tables(spark, d)), "ds", out="trend", start=1)
    return s.select("ds", F.lit(1.0).alias("const"), "trend")


@query("fourier_features", oracle=f"""
WITH s AS (SELECT ds, CAST(row_number() OVER (ORDER BY ds) - 1 AS DOUBLE) AS t FROM {DAILY_SQL})
SELECT ds, """ + ", ".join(
    f"round(sin({2 * 3.141592653589793 * i / f!r} * t), 9) AS sin_{f}_{i}, "
    f"round(cos({2 * 3.141592653589793 * i / f!r} * t), 9) AS cos_{f}_{i}"
    for f, o in ((7, 3), (365, 2)) for i in range(1, o + 1)) + " FROM s")
def fourier_features(spark, d):
    """sin/cos terms of orders 3 (weekly) and 2 (yearly) over the time dummy."""
    s = S.position(daily_orders(Tables(spark, d)), "ds")
    t = F.col("t").cast("double")
    cols = S.fourier_terms(t, 7, 3) + S.fourier_terms(t, 365, 2)
    out = s.select("ds", *cols)
    return out.select("ds", *[r(c, 9).alias(c) for c in out.columns if c != "ds"])


@query("weekly_moving_averages", oracle=f"""
WITH w AS (SELECT CAST(date_trunc('week', ds) AS DATE) + 6 AS week, avg(y) AS y FROM {DAILY_SQL} GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM w),
x AS (SELECT cal.week, w.y FROM cal LEFT JOIN w USING (week))
SELECT week, round(y, 6) AS y, """ + ", ".join(
    f"round(avg(y) OVER (ORDER BY week ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS ma_{n}"
    for n in (4, 16, 28, 40, 52)) + " FROM x")
def weekly_moving_averages(spark, d):
    """Weekly mean of the daily series, then 4/16/28/40/52-week trailing
    means with partial windows."""
    w = S.resample_weekly(daily_orders(Tables(spark, d)), "ds", "y")
    w = S.rolling(w, "y", "week", (4, 16, 28, 40, 52), min_periods=1)
    return w.select("week", r("y", 6).alias("y"), *[r(f"y_roll{n}_mean", 6).alias(f"ma_{n}") for n in (4, 16, 28, 40, 52)])


@query("daily_moving_averages", oracle=f"""
SELECT ds, round(y, 6) AS y, round(avg(y) OVER ({_win(9)}), 6) AS ma_10,
       round(avg(y) OVER ({_win(49)}), 6) AS ma_50 FROM {DAILY_SQL}""")
def daily_moving_averages(spark, d):
    """Daily series with 10- and 50-day trailing means."""
    s = daily_orders(Tables(spark, d))
    s = S.rolling(s, "y", "ds", (10, 50), min_periods=1)
    return s.select("ds", r("y", 6).alias("y"), r("y_roll10_mean", 6).alias("ma_10"), r("y_roll50_mean", 6).alias("ma_50"))
