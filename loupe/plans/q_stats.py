"""Statistics queries (STA*, CMP19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.functions.text import word_count
from loupe.operators import series as S
from loupe.operators.comoments import correlations
from loupe.operators import stats as ST
from loupe.plans.common import r
from loupe.plans.q_series import DAILY_SQL, daily_orders
from loupe.plans.registry import query
from loupe.sources.tables import Tables

_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", oracle="\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, round(corr({a}, {b}), 9) AS corr FROM lineitem"
    for i, a in enumerate(_CORR_COLS) for j, b in enumerate(_CORR_COLS) if i > j))
def corr_matrix(spark, d):
    """Correlation of every pair of measures, lower triangle."""
    c = correlations(Tables(spark, d).lineitem, _CORR_COLS)
    return c.select("feature_i", "feature_j", r("corr", 9).alias("corr"))


@query("corr_wide", oracle="""
WITH long AS (SELECT vec_id, i - 1 AS i, CASE WHEN (vec_id + i) % 13 <> 0 THEN CAST(embedding[i] AS DOUBLE) END AS v FROM embeddings, range(1, 65) AS t(i))
SELECT 'f' || a.i AS feature_i, 'f' || b.i AS feature_j, count(*) AS n, round(corr(a.v, b.v), 9) AS corr
FROM long a JOIN long b USING (vec_id) WHERE a.i > b.i AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2""")
def corr_wide(spark, d):
    """Correlation of every pair of 64 columns, each blank in every thirteenth
    row, over the rows that have both."""
    e = Tables(spark, d).embeddings
    wide = e.select(*[F.when((F.col("vec_id") + i + 1) % 13 != 0, F.get("embedding", F.lit(i)).cast("double")).alias(f"f{i}") for i in range(64)])
    c = correlations(wide, wide.columns)
    return c.select("feature_i", "feature_j", "n", r("corr", 9).alias("corr"))


@query("lag_correlation", oracle=f"""
WITH s AS (SELECT ds, y, """ + ", ".join(f"lag(y, {k}) OVER (ORDER BY ds) AS l{k}" for k in range(1, 25)) +
       f""" FROM {DAILY_SQL})
""" + "\nUNION ALL\n".join(f"SELECT {k} AS lag, round(corr(y, l{k}), 9) AS corr FROM s" for k in range(1, 25)))
def lag_correlation(spark, d):
    """corr(y_t, y_{t-k}), k = 1..24, in one window + one aggregate."""
    c = ST.lag_correlation(daily_orders(Tables(spark, d)), "y", "ds", 24)
    return c.select("lag", r("corr", 9).alias("corr"))


@query("pacf", oracle=f"""
WITH RECURSIVE s AS (SELECT ds, y - avg(y) OVER () AS d, count(*) OVER () AS n FROM {DAILY_SQL}),
g AS (SELECT [{", ".join(f"sum(d * l{k}) / max(n)" for k in range(25))}] AS a
      FROM (SELECT n, d, {", ".join(f"lag(d, {k}) OVER (ORDER BY ds) AS l{k}" for k in range(25))} FROM s)),
rho AS (SELECT list_transform(a, lambda x: x / a[1]) AS r FROM g),
dl(k, phi, pacf) AS (
  SELECT 1, [r[2]], r[2] FROM rho
  UNION ALL
  SELECT k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - nxt * phi[k + 1 - j]), nxt), nxt
  FROM (SELECT k, phi, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
                       / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS nxt FROM dl, rho WHERE k < 24))
SELECT CAST(k AS INTEGER) AS lag, round(r[k + 1], 9) AS acf, round(pacf, 9) AS pacf FROM dl, rho
UNION ALL SELECT 0, 1.0, 1.0""")
def pacf(spark, d):
    """ACF and PACF up to lag 24 (Yule-Walker / Durbin-Levinson on the
    autocovariances, which come from one Spark aggregate)."""
    p = ST.pacf(daily_orders(Tables(spark, d)), "y", "ds", 24)
    return p.select("lag", r("acf", 9).alias("acf"), r("pacf", 9).alias("pacf"))


@query("autocovariance", oracle=f"""
WITH s AS (SELECT ds, y - avg(y) OVER () AS d, count(*) OVER () AS n FROM {DAILY_SQL}),
l AS (SELECT d, n, """ + ", ".join(f"lag(d, {k}) OVER (ORDER BY ds) AS l{k}" for k in range(1, 25)) + """ FROM s)
SELECT 0 AS lag, round(sum(d * d) / max(n) / 1e12, 9) AS acov FROM l
""" + "".join(f"UNION ALL SELECT {k}, round(sum(d * l{k}) / max(n) / 1e12, 9) FROM l\n" for k in range(1, 25)))
def autocovariance(spark, d):
    """Biased autocovariances gamma_0..gamma_24 of the daily series (in
    units of 1e12), the aggregate behind ``pacf``."""
    a = ST.autocovariances(daily_orders(Tables(spark, d)), "y", "ds", 24)
    return a.select("lag", r(F.col("acov") / 1e12, 9).alias("acov"))


@query("zscore", oracle=f"""
SELECT ds, round((y - avg(y) OVER ()) / stddev_samp(y) OVER (), 9) AS z FROM {DAILY_SQL}""")
def zscore(spark, d):
    """Distance from the mean in standard deviations."""
    z = ST.zscore(daily_orders(Tables(spark, d)), "y")
    return z.select("ds", r("z", 9).alias("z"))


_DAILY_T_SQL = f"(SELECT ds, y / 1e6 AS y, row_number() OVER (ORDER BY ds) - 1 AS t FROM {DAILY_SQL})"


def _daily_t(t):
    s = daily_orders(t).withColumn("y", F.col("y") / 1e6)
    return S.position(s, "ds")


@query("ols_line", oracle=f"""
SELECT round(regr_slope(y, t), 9) AS slope, round(regr_intercept(y, t), 9) AS intercept,
       round(regr_r2(y, t), 9) AS r2, CAST(regr_count(y, t) AS BIGINT) AS n FROM {_DAILY_T_SQL}""")
def ols_line(spark, d):
    """Least-squares line of the daily series (millions) on time."""
    o = ST.ols_line(_daily_t(Tables(spark, d)), "y", "t")
    return o.select(r("slope", 9).alias("slope"), r("intercept", 9).alias("intercept"), r("r2", 9).alias("r2"),
                    F.col("n").cast("long").alias("n"))


@query("periodogram", oracle=f"""
WITH s AS {_DAILY_T_SQL},
st AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a, count(*) AS n FROM s),
x AS (SELECT CAST(t AS DOUBLE) AS t, y - a - b * t AS r, n FROM s, st),
k AS (SELECT range AS k FROM range(0, (SELECT n FROM st) // 2 + 1)),
g AS (SELECT k, sum(r * cos(2 * pi() * k * t / n)) AS re, sum(r * sin(2 * pi() * k * t / n)) AS im, max(n) AS n
      FROM x, k GROUP BY k)
SELECT k, round(k * (365.2425 / n), 9) AS freq,
       round(CASE WHEN k = 0 OR (n % 2 = 0 AND k = n // 2) THEN 1.0 ELSE 2.0 END * (re * re + im * im) / (n * n), 9) AS power
FROM g""")
def periodogram(spark, d):
    """Power spectrum of the detrended daily series (millions), fs = 365.2425."""
    p = ST.periodogram(_daily_t(Tables(spark, d)), "y", "t")
    return p.select(F.col("k").cast("long").alias("k"), r("freq", 9).alias("freq"), r("power", 9).alias("power"))


@query("kde_grid", oracle="""
WITH v AS (SELECT l_returnflag, l_quantity AS x FROM lineitem),
st AS (SELECT l_returnflag, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi
       FROM v GROUP BY 1),
grid AS (SELECT l_returnflag, i AS grid_i, lo - 3 * h + i * ((hi - lo + 2 * 3 * h) / 199) AS gx, n, h
         FROM st, range(0, 200) AS r(i))
SELECT grid.l_returnflag, grid_i, round(gx, 9) AS x,
       round(sum(exp(-0.5 * ((gx - v.x) / h) * ((gx - v.x) / h))) / (max(n) * max(h) * sqrt(2 * pi())), 9) AS density
FROM grid JOIN v USING (l_returnflag) GROUP BY grid.l_returnflag, grid_i, gx""")
def kde_grid(spark, d):
    """Gaussian KDE of quantity per return flag on a 200-point grid."""
    k = ST.kde_grid(Tables(spark, d).lineitem, "l_quantity", "l_returnflag")
    return k.select("l_returnflag", F.col("grid_i").cast("long").alias("grid_i"), r("x", 9).alias("x"),
                    r("density", 9).alias("density"))


@query("histogram_percent", oracle="""
WITH v AS (SELECT lang, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS DOUBLE) AS x
           FROM documents),
st AS (SELECT min(x) AS lo, 2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / pow(count(*), 1.0 / 3) AS w0 FROM v),
st2 AS (SELECT lo, CASE WHEN w0 > 0 THEN w0 ELSE 1.0 END AS w FROM st),
b AS (SELECT lang, CAST(floor((x - lo) / w) AS BIGINT) AS bin, lo, w FROM v, st2),
c AS (SELECT lang, bin, count(*) AS count, round(max(lo + bin * w), 6) AS bin_start FROM b GROUP BY 1, 2)
SELECT lang, bin, bin_start, count, round(100.0 * count / sum(count) OVER (PARTITION BY lang), 6) AS percent FROM c""")
def histogram_percent(spark, d):
    """Word-count distribution per language as percent histograms
    with shared Freedman-Diaconis bins."""
    docs = Tables(spark, d).documents.select("lang", word_count("text").alias("n_words"))
    h = ST.fd_histogram(docs, "n_words", "lang")
    return h.select("lang", "bin", r("bin_start").alias("bin_start"), "count", r("percent").alias("percent"))


@query("seasonal_means", oracle=f"""
WITH s AS (SELECT CAST(week(ds) AS INTEGER) AS week, CAST(isodow(ds) - 1 AS INTEGER) AS weekday,
                  CAST(year(ds) AS INTEGER) AS year, CAST(dayofyear(ds) AS INTEGER) AS dayofyear, y FROM {DAILY_SQL})
SELECT 'week' AS kind, week AS period, weekday AS position, round(avg(y), 6) AS mean, count(y) AS n FROM s GROUP BY 2, 3
UNION ALL
SELECT 'year', year, dayofyear, round(avg(y), 6), count(y) FROM s GROUP BY 2, 3""")
def seasonal_means(spark, d):
    """Mean of the daily series by (week, weekday) and (year, day of year)."""
    m = ST.seasonal_means(daily_orders(Tables(spark, d)), "y", "ds")
    return m.select("kind", "period", "position", r("mean").alias("mean"), "n")


@query("lowess_binned", oracle=f"""
WITH v AS (SELECT * FROM (SELECT y / 1e6 AS y, lag(y / 1e6) OVER (ORDER BY ds) AS x FROM {DAILY_SQL}) WHERE x IS NOT NULL AND y IS NOT NULL),
st AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM v),
b AS (SELECT least(floor((x - lo) / ((hi - lo) / 200)), 199) AS b, x, y, n FROM v, st),
g AS (SELECT CAST(b AS BIGINT) AS b, count(*) AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, max(n) AS n, sum(x) / count(*) AS c FROM b GROUP BY 1),
p AS (SELECT c.b AS centre_bin, c.c AS centre, c.n, g.b, g.m, g.sx, g.sy, g.sxx, g.sxy, abs(g.c - c.c) AS d FROM g c, g),
q AS (SELECT *, sum(m) OVER (PARTITION BY centre_bin ORDER BY d, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM p),
h AS (SELECT centre_bin, min(d) AS h FROM q WHERE cum >= ceil(n * (2.0 / 3.0)) GROUP BY 1),
w AS (SELECT p.*, CASE WHEN u < 1 THEN pow(1 - pow(u, 3), 3) ELSE 0 END AS w FROM (SELECT p.*, CASE WHEN h > 0 THEN d / h ELSE 0 END AS u FROM p JOIN h USING (centre_bin)) p),
s AS (SELECT centre_bin, centre, sum(w * m) AS s0, sum(w * sx) AS s1, sum(w * sxx) AS s2, sum(w * sy) AS t0, sum(w * sxy) AS t1 FROM w GROUP BY 1, 2),
l AS (SELECT *, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS slope FROM s)
SELECT centre_bin, round(centre, 6) AS centre, round((t0 - slope * s1) / s0 + slope * centre, 6) AS fitted FROM l""")
def lowess_binned(spark, d):
    """Lag plot smoother: locally weighted fit of y_t on y_{t-1} (millions),
    200 bins."""
    s = S.with_lags(daily_orders(Tables(spark, d)).withColumn("y", F.col("y") / 1e6), "y", "ds", [1])
    f = ST.lowess_binned(s, "y_lag_1", "y")
    return f.select(F.col("centre_bin").cast("long").alias("centre_bin"), r("centre").alias("centre"), r("fitted").alias("fitted"))
