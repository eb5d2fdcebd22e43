"""Model and evaluation queries (MDL*, EVL*, STA5-6, SNK2, CMP17, CMP21)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from loupe.functions.text import word_count
from loupe.operators import arima as AR
from loupe.operators import forecast as FC
from loupe.operators import models as MD
from loupe.operators import series as S
from loupe.operators import stats as ST
from loupe.operators.scalars import with_scalars
from loupe.operators.relate import fill_template
from loupe.session import materialize, stored
from loupe.plans.common import r
from loupe.plans.q_series import DAILY_SQL, daily_orders
from loupe.plans.registry import query
from loupe.sources import files as FS
from loupe.sources.tables import Tables

_TREND_SQL = f"(SELECT ds, y / 1e6 AS y, row_number() OVER (ORDER BY ds) AS trend FROM {DAILY_SQL})"


def _trend(t):
    s = daily_orders(t).withColumn("y", F.col("y") / 1e6)
    return S.position(s, "ds", out="trend", start=1)


@query("linear_trend_fit", oracle=f"""
WITH s AS {_TREND_SQL}, c AS (SELECT regr_slope(y, trend) AS b, regr_intercept(y, trend) AS a FROM s)
SELECT ds, trend, round(y, 9) AS y, round(a + b * trend, 9) AS y_fit, round(y - (a + b * trend), 9) AS resid
FROM s, c""")
def linear_trend_fit(spark, d):
    """y (millions) on a time trend: fitted line and residuals."""
    s = _trend(Tables(spark, d))
    c = ST.ols_line(s, "y", "trend").select("slope", "intercept")
    j = with_scalars(s, c)
    fit = F.col("intercept") + F.col("slope") * F.col("trend")
    return j.select("ds", "trend", r("y", 9).alias("y"), r(fit, 9).alias("y_fit"),
                    r(F.col("y") - fit, 9).alias("resid"))


@query("linear_trend_forecast", oracle=f"""
WITH s AS {_TREND_SQL}, c AS (SELECT regr_slope(y, trend) AS b, regr_intercept(y, trend) AS a,
                                     max(ds) AS last, max(trend) AS n FROM s)
SELECT CAST(last + CAST(h AS INTEGER) AS DATE) AS ds, n + h AS trend, round(a + b * (n + h), 9) AS y_pred
FROM c, range(1, 31) AS r(h)""")
def linear_trend_forecast(spark, d):
    """30 steps ahead on the fitted trend (future trend values n+1..n+30)."""
    s = _trend(Tables(spark, d))
    c = s.agg(F.regr_slope("y", "trend").alias("b"), F.regr_intercept("y", "trend").alias("a"),
              F.max("ds").alias("last"), F.max("trend").alias("n"))
    h = spark.range(1, 31).withColumnRenamed("id", "h")
    j = with_scalars(h, c)
    return j.select(F.date_add("last", F.col("h").cast("int")).alias("ds"), (F.col("n") + F.col("h")).alias("trend"),
                    r(F.col("a") + F.col("b") * (F.col("n") + F.col("h")), 9).alias("y_pred"))


@query("residual_diagnostics", oracle=f"""
WITH s AS {_TREND_SQL}, c AS (SELECT regr_slope(y, trend) AS b, regr_intercept(y, trend) AS a FROM s),
e AS (SELECT ds, y - (a + b * trend) AS e FROM s, c),
l AS (SELECT e, """ + ", ".join(f"lag(e, {k}) OVER (ORDER BY ds) AS l{k}" for k in range(1, 6)) + """ FROM e)
SELECT 'mean' AS metric, round(avg(e), 9) AS value FROM l
UNION ALL SELECT 'variance', round(var_samp(e), 9) FROM l
""" + "".join(f"UNION ALL SELECT 'acf_{k}', round(corr(e, l{k}), 9) FROM l\n" for k in range(1, 6)))
def residual_diagnostics(spark, d):
    """Residuals of the trend fit: mean, variance and lag-1..5 correlation."""
    s = _trend(Tables(spark, d))
    c = ST.ols_line(s, "y", "trend").select("slope", "intercept")
    e = with_scalars(s, c).select(
        "ds", (F.col("y") - F.col("intercept") - F.col("slope") * F.col("trend")).alias("e"))
    m = e.agg(F.avg("e").alias("mean"), F.var_samp("e").alias("variance"))
    a = m.select(F.explode(F.array(F.struct(F.lit("mean").alias("metric"), F.col("mean").alias("value")),
                                   F.struct(F.lit("variance").alias("metric"), F.col("variance").alias("value")))).alias("s"))
    lc = ST.lag_correlation(e, "e", "ds", 5).select(F.concat(F.lit("acf_"), F.col("lag").cast("string")).alias("metric"),
                                                    F.col("corr").alias("value"))
    return a.select("s.*").unionByName(lc).select("metric", r("value", 9).alias("value"))


@query("adf_test")
def adf_test(spark, d):
    """ADF unit-root test of the daily series (constant, AIC lag choice)."""
    res = MD.adf_test(materialize(daily_orders(Tables(spark, d))), "y", "ds")
    return spark.createDataFrame([res], "adf_stat double, pvalue double, usedlag int, nobs int, crit_1 double, "
                                        "crit_5 double, crit_10 double, icbest double")


_ADF0_SQL = """c AS (SELECT {k}regr_slope(dx, x) AS b, regr_sxx(dx, x) AS sxx, regr_syy(dx, x) AS syy, regr_sxy(dx, x) AS sxy, count(*) AS n FROM l {g}),
t AS (SELECT *, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS stat FROM c)
SELECT {k}round(stat, 6) AS adf_stat, CAST(n AS BIGINT) AS nobs, round(-3.43035 - 6.5393 / n - 16.786 / n / n - 79.433 / n / n / n, 6) AS crit_1,
       round(-2.86154 - 2.8903 / n - 4.234 / n / n - 40.040 / n / n / n, 6) AS crit_5, round(-2.56677 - 1.5384 / n - 2.809 / n / n, 6) AS crit_10 FROM t"""


@query("adf_without_lags", oracle=f"""
WITH s AS (SELECT ds, y - lag(y) OVER (ORDER BY ds) AS dx, lag(y) OVER (ORDER BY ds) AS x FROM {DAILY_SQL}), l AS (SELECT * FROM s WHERE x IS NOT NULL),
""" + _ADF0_SQL.format(k="", g=""))
def adf_without_lags(spark, d):
    """Unit-root test of the daily series without lagged differences."""
    res = MD.adf_test(materialize(daily_orders(Tables(spark, d))), "y", "ds", maxlag=0)
    out = spark.createDataFrame([res], "adf_stat double, nobs long, crit_1 double, crit_5 double, crit_10 double")
    return out.select(r("adf_stat").alias("adf_stat"), "nobs", *[r(c).alias(c) for c in ("crit_1", "crit_5", "crit_10")])


@query("adf_by_series_without_lags", oracle="""
WITH s AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1, 2),
p AS (SELECT o_orderpriority, y - lag(y) OVER w AS dx, lag(y) OVER w AS x FROM s WINDOW w AS (PARTITION BY o_orderpriority ORDER BY ds)),
l AS (SELECT * FROM p WHERE x IS NOT NULL),
""" + _ADF0_SQL.format(k="o_orderpriority, ", g="GROUP BY o_orderpriority"))
def adf_by_series_without_lags(spark, d):
    """The same test for every order priority's daily totals at once."""
    s = S.daily(Tables(spark, d).orders, "o_orderdate", F.sum("o_totalprice") / 1e6, keys="o_orderpriority")
    out = MD.adf_by_key(s, "y", "ds", "o_orderpriority", maxlag=0)
    return out.select("o_orderpriority", r("adf_stat").alias("adf_stat"), "nobs", *[r(c).alias(c) for c in ("crit_1", "crit_5", "crit_10")])


@query("stationarity_report")
def stationarity_report(spark, d):
    """Rolling 12-row mean/std of the series plus the ADF verdict."""
    s = materialize(daily_orders(Tables(spark, d)))  # one scan of the facts
    res = MD.adf_test(s, "y", "ds")
    roll = S.rolling(s, "y", "ds", 12, stats=("mean", "std"))
    return roll.select("ds", "y", F.col("y_roll12_mean").alias("roll_mean"), F.col("y_roll12_std").alias("roll_std"),
                       F.lit(res["adf_stat"]).alias("adf_stat"), F.lit(res["pvalue"]).alias("adf_pvalue"),
                       F.lit(res["pvalue"] < 0.05).alias("stationary"))


@query("arima_select")
def arima_select(spark, d):
    """(p, d, q) search with p, q <= 3 by AIC on the daily series."""
    s = materialize(daily_orders(Tables(spark, d)).withColumn("y", F.col("y") / 1e6))
    rows = MD.arima_select(s, "y", "ds")
    return spark.createDataFrame(rows, "p int, d int, q int, aic double, nobs int, chosen boolean")


def holiday_calendar(spark, lo, hi):
    """Fixed-rule holidays for every year in [lo, hi]: Jan 1, Jul 4, Dec 25."""
    years = spark.range(lo.year, hi.year + 1).withColumnRenamed("id", "yr")
    md = [(1, 1, "New Year"), (7, 4, "Midsummer"), (12, 25, "Christmas")]
    rows = None
    for m, dd, name in md:
        x = years.select(F.make_date(F.col("yr").cast("int"), F.lit(m), F.lit(dd)).alias("ds"),
                         F.lit(name).alias("holiday"))
        rows = x if rows is None else rows.unionByName(x)
    return rows


def _forecast(spark, d):
    t = Tables(spark, d)
    o = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.to_date("o_orderdate").alias("ds"), (F.col("o_totalprice") / 1e3).alias("y"))
    b = o.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")).first()
    hol = holiday_calendar(spark, b["lo"], b["hi"] + datetime.timedelta(days=365))
    return FC.additive_forecast(o, "ds", "y", horizon=364, holidays=hol)


@query("additive_forecast")
def additive_forecast(spark, d):
    """Trend + weekly + yearly + holiday model fitted on every order row
    of one priority (several rows per date), 364 days ahead, 95 % interval."""
    f = _forecast(spark, d)
    return f.select("ds", "yhat", "yhat_lower", "yhat_upper")


@query("forecast_components")
def forecast_components(spark, d):
    """Per-date contributions (trend, weekly, yearly, holidays) of the forecast."""
    return _forecast(spark, d).select("ds", "trend", "weekly", "yearly", "holidays", "yhat")


def _doc_features(t):
    docs = t.documents.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
                              word_count("text").cast("double").alias("n_words"))
    return docs


@query("gbt_classify")
def gbt_classify(spark, d):
    """Impute -> scale -> boosted trees on labelled documents
    (id not used as a feature), then score the unlabelled documents with the
    fitted pipeline."""
    feats, train, unseen = _labelled_and_unseen(spark, d)
    model = MD.gbt_classifier_pipeline(["n_chars", "n_words"], ["lang", "source"], "label", max_iter=10).fit(train)
    return model.transform(unseen).select("doc_id", F.col("prediction").cast("int").alias("quality_pred"))


def _labelled_and_unseen(spark, d):
    """Document features (word counts over whole texts, derived once), those
    with a label, and those without."""
    t = Tables(spark, d)
    feats = stored(_doc_features(t), "features")
    train = feats.join(t.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    return feats, train, feats.join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("ml_submission")
def ml_submission(spark, d):
    """Unseen documents scored and filled into a submission template by
    position: predictions in the unseen table's order go to the template's rows
    in its own order, and the filled template is written as one CSV and read
    back."""
    _, train, unseen = _labelled_and_unseen(spark, d)
    model = MD.gbt_classifier_pipeline(["n_chars", "n_words"], ["lang", "source"], "label", max_iter=10).fit(train)
    pred = model.transform(unseen).select("doc_id", F.col("prediction").cast("int").alias("quality"))
    template = unseen.select("doc_id", F.lit(0).alias("quality"))
    filled = fill_template(template, "doc_id", pred, "doc_id", {"quality": "quality"})
    path = FS.new_scratch(spark, "submission")
    FS.write_csv(filled.orderBy("doc_id"), path, single_file=True)
    return FS.read_csv(spark, path, "doc_id long, quality int")


@query("template_by_position", oracle="""
WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
p AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey, o_totalprice AS score FROM t LEFT JOIN p USING (n)""")
def template_by_position(spark, d):
    """A template in key order filled with values in another table's order,
    row by row; the template's last rows, beyond the values, stay empty."""
    o = Tables(spark, d).orders
    values = o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice")
    filled = fill_template(o.select("o_orderkey", F.lit(0.0).alias("score")), "o_orderkey", values, [F.col("o_totalprice").desc(), F.col("o_orderkey")], {"score": "o_totalprice"})
    return filled.select("o_orderkey", "score")


@query("tabular_regress")
def tabular_regress(spark, d):
    """Categorical (return flag, line status, ship mode stand-ins),
    numeric (discount) -> sales (extended price), clipped to (0, 125000);
    80/20 split by a stable hash; reports validation predictions."""
    li = Tables(spark, d).lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
        F.col("l_linenumber").cast("string").alias("line_no"), "l_discount", "l_quantity", "l_extendedprice")
    li = li.withColumn("is_valid", F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(42)), F.lit(100)) >= 80)
    model = MD.gbt_regressor_pipeline(["l_discount", "l_quantity"], ["l_returnflag", "l_linestatus", "line_no"],
                                      "l_extendedprice", max_iter=10).fit(li.where(~F.col("is_valid")))
    pred = model.transform(li.where(F.col("is_valid")))
    clip = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(125000.0))
    return pred.select("l_orderkey", "l_linenumber", "l_extendedprice", clip.alias("prediction"))


_PRED_SQL = """(SELECT l.l_returnflag, l.l_extendedprice AS target, l.l_quantity * p.p_retailprice AS pred
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def _pred(t):
    li = t.lineitem.select("l_partkey", "l_returnflag", F.col("l_extendedprice").alias("target"), "l_quantity")
    j = li.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return j.withColumn("pred", F.col("l_quantity") * F.col("p_retailprice"))


@query("rmsle", oracle=f"""
SELECT l_returnflag, round(sqrt(avg(pow(ln(1 + target) - ln(1 + pred), 2))), 9) AS rmsle FROM {_PRED_SQL} GROUP BY 1""")
def rmsle(spark, d):
    """Root mean squared log error of a price estimate (quantity x list price)."""
    m = MD.rmsle(_pred(Tables(spark, d)), "target", "pred", "l_returnflag")
    return m.select("l_returnflag", r("rmsle", 9).alias("rmsle"))


@query("mae_mse", oracle=f"""
SELECT l_returnflag, round(avg(abs(target - pred)) / 1e3, 9) AS mae_k, round(avg(pow(target - pred, 2)) / 1e6, 6) AS mse_m
FROM {_PRED_SQL} GROUP BY 1""")
def mae_mse(spark, d):
    """MAE (thousands) and MSE (millions) of the same estimate."""
    m = MD.mae_mse(_pred(Tables(spark, d)), "target", "pred", "l_returnflag")
    return m.select("l_returnflag", r(F.col("mae") / 1e3, 9).alias("mae_k"), r(F.col("mse") / 1e6, 6).alias("mse_m"))


@query("auc_rank", oracle="""
WITH j AS (SELECT d.n_chars AS score, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
      FROM j GROUP BY score),
c AS (SELECT *, sum(neg) OVER (ORDER BY score) AS cneg FROM g)
SELECT round(sum(pos * (cneg - neg + neg / 2.0)) / (sum(pos) * sum(neg)), 9) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c""")
def auc_rank(spark, d):
    """ROC AUC of document length as a score for the quality label."""
    t = Tables(spark, d)
    j = t.documents.select("doc_id", F.col("n_chars").alias("score")).join(
        t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    a = MD.auc_rank(j, "score", "label")
    return a.select(r("auc", 9).alias("auc"), F.col("n_pos").cast("long"), F.col("n_neg").cast("long"))


@query("series_report")
def series_report(spark, d):
    """Lag, trend features, linear fit, 30-step forecast and
    stationarity of one daily series, as one table (history + forecast)."""
    t = Tables(spark, d)
    s = materialize(_trend(t))  # the daily series is read by every step below: one scan of the facts
    s = S.with_lags(s, "y", "ds", [1])
    c = ST.ols_line(s, "y", "trend").agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"))
    cv = c.first()
    res = MD.adf_test(s, "y", "ds")
    fit = F.lit(cv["intercept"]) + F.lit(cv["slope"]) * F.col("trend")
    hist = s.select("ds", "trend", "y", "y_lag_1", fit.alias("y_fit"), F.lit(False).alias("is_forecast"))
    last = s.agg(F.max("ds").alias("last"), F.max("trend").alias("n")).first()
    h = spark.range(1, 31).select(F.col("id").cast("int").alias("h"))
    fc = h.select(F.date_add(F.lit(last["last"]), F.col("h")).alias("ds"), (F.lit(last["n"]) + F.col("h")).alias("trend"),
                  F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("y_lag_1"),
                  (F.lit(cv["intercept"]) + F.lit(cv["slope"]) * (F.lit(last["n"]) + F.col("h"))).alias("y_fit"),
                  F.lit(True).alias("is_forecast"))
    return hist.unionByName(fc).withColumn("adf_pvalue", F.lit(res["pvalue"]))


@query("linear_trend_by_series", oracle="""
WITH s AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) / 1e6 AS y
           FROM orders GROUP BY 1, 2),
x AS (SELECT o_orderpriority, (ds - DATE '1995-01-01') / 365.25 AS t, y FROM s)
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(regr_intercept(y, t), 9) AS coef_intercept,
       round(regr_slope(y, t), 9) AS coef_t, round(regr_r2(y, t), 9) AS r2
FROM x GROUP BY 1""")
def linear_trend_by_series(spark, d):
    """A linear trend per order priority of its
    daily totals (millions) on years since 1995-01-01.  One grouped
    cross-product aggregate; the per-series solves run on executors."""
    o = Tables(spark, d).orders
    s = S.daily(o, "o_orderdate", F.sum("o_totalprice") / 1e6, keys="o_orderpriority")
    x = s.select("o_orderpriority", (F.datediff("ds", F.lit("1995-01-01").cast("date")) / 365.25).alias("t"), "y")
    fit = MD.ols_by_key(x, "o_orderpriority", ["t"], "y")
    return fit.select("o_orderpriority", "n", r("coef_intercept", 9).alias("coef_intercept"),
                      r("coef_t", 9).alias("coef_t"), r("r2", 9).alias("r2"))


@query("adf_by_series")
def adf_by_series(spark, d):
    """ADF of each order priority's daily totals
    (two grouped cross-product passes; solves on executors)."""
    o = Tables(spark, d).orders
    s = S.daily(o, "o_orderdate", F.sum("o_totalprice") / 1e6, keys="o_orderpriority")
    return MD.adf_by_key(s, "y", "ds", "o_orderpriority")


@query("arima_by_series")
def arima_by_series(spark, d):
    """MDL3 for many series at once: (p, d, q) search for each order
    priority's daily totals (grouped passes, executor-side solves)."""
    o = Tables(spark, d).orders
    s = S.daily(o, "o_orderdate", F.sum("o_totalprice") / 1e6, keys="o_orderpriority")
    return MD.arima_select_by_key(s, "y", "ds", "o_orderpriority")


_MILLIONS_SQL = f"(SELECT ds, y / 1e6 AS y FROM {DAILY_SQL})"
_AR_SQL = f"""z AS (SELECT ds, y, y - lag(y) OVER (ORDER BY ds) AS z FROM {_MILLIONS_SQL}),
l AS (SELECT ds, y, z, lag(z) OVER (ORDER BY ds) AS z1 FROM z),
c AS (SELECT regr_slope(z, z1) AS b, regr_intercept(z, z1) AS a FROM l),
f AS (SELECT ds, y, z - (a + b * z1) AS resid FROM l, c WHERE z IS NOT NULL)"""


def _millions(t):
    return daily_orders(t).withColumn("y", F.col("y") / 1e6)


@query("arima_fitted", oracle=f"""
WITH {_AR_SQL} SELECT ds, round(y, 6) AS y, round(y - resid, 6) AS fitted, round(resid, 6) AS resid FROM f""")
def arima_fitted(spark, d):
    """One-step fitted values and residuals of an ARIMA(1,1,0) of the daily
    series (without moving-average terms its fit is a plain regression, which
    the SQL states)."""
    f = AR.arima_fit(_millions(Tables(spark, d)), "y", "ds", (1, 1, 0)).fitted()
    return f.select("ds", *[r(c).alias(c) for c in ("y", "fitted", "resid")])


@query("arima_diagnostics", oracle=f"""
WITH {_AR_SQL},
g AS (SELECT resid AS e, """ + ", ".join(f"lag(resid, {k}) OVER (ORDER BY ds) AS l{k}" for k in range(1, 11)) + """ FROM f),
m AS (SELECT avg(resid) AS mu, var_pop(resid) AS v FROM f),
n AS (SELECT avg(pow(resid - mu, 3)) / pow(max(v), 1.5) AS skew, avg(pow(resid - mu, 4)) / pow(max(v), 2) - 3 AS kurt FROM f, m)
SELECT 'moments' AS panel, CAST(1 AS DOUBLE) AS x, round(avg(resid), 6) AS y FROM f
UNION ALL SELECT 'moments', 2, round(var_samp(resid), 6) FROM f
UNION ALL SELECT 'moments', 3, round(skew, 6) FROM n
UNION ALL SELECT 'moments', 4, round(kurt, 6) FROM n
""" + "".join(f"UNION ALL SELECT 'correlogram', {k}, round(corr(e, l{k}), 6) FROM g\n" for k in range(1, 11)))
def arima_diagnostics(spark, d):
    """Moments and correlogram of the residuals of that model."""
    f = AR.arima_fit(_millions(Tables(spark, d)), "y", "ds", (1, 1, 0)).fitted()
    p = AR.residual_panels(f, "ds").where(F.col("panel").isin("moments", "correlogram"))
    return p.select("panel", "x", r("y").alias("y"))


@query("arima_panels")
def arima_panels(spark, d):
    """All four panels (moments, correlogram, normal quantiles, density) of the
    residuals of an ARIMA(1,1,1)."""
    return AR.residual_panels(AR.arima_fit(_millions(Tables(spark, d)), "y", "ds", (1, 1, 1)).fitted(), "ds")


@query("arima_coefficients", oracle=f"""
WITH s AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1, 2),
z AS (SELECT k, ds, y - lag(y) OVER (PARTITION BY k ORDER BY ds) AS z FROM s),
l AS (SELECT k, z, lag(z) OVER (PARTITION BY k ORDER BY ds) AS z1 FROM z),
c AS (SELECT k, regr_slope(z, z1) AS b, regr_intercept(z, z1) AS a FROM l GROUP BY k)
SELECT k AS o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(max(a), 6) AS intercept, round(max(b), 6) AS ar1,
       round(avg(pow(z - a - b * z1, 2)), 6) AS sigma2 FROM l JOIN c USING (k) WHERE z1 IS NOT NULL GROUP BY k""")
def arima_coefficients(spark, d):
    """ARIMA(1,1,0) of every order priority's daily totals at once."""
    s = S.daily(Tables(spark, d).orders, "o_orderdate", F.sum("o_totalprice") / 1e6, keys="o_orderpriority")
    c = AR.arima_fit(s, "y", "ds", (1, 1, 0), "o_orderpriority").coefficients
    return c.select("o_orderpriority", "n", r("intercept").alias("intercept"), r(F.col("ar")[0]).alias("ar1"), r("sigma2").alias("sigma2"))


@query("arima_auto")
def arima_auto(spark, d):
    """The chosen model of every order priority, fitted: orders by the search,
    coefficients, innovation variance."""
    s = S.daily(Tables(spark, d).orders, "o_orderdate", F.sum("o_totalprice") / 1e6, keys="o_orderpriority")
    chosen = MD.arima_select_by_key(s, "y", "ds", "o_orderpriority").where("chosen").select("o_orderpriority", "p", "d", "q")
    return AR.arima_fit(s, "y", "ds", chosen, "o_orderpriority").coefficients
