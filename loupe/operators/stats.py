"""Statistics on columns and series (STA*).

Pattern: all data-sized work is one Spark aggregate (correlations, lagged
cross products, autocovariances, kernel sums against a broadcast grid);
the driver only receives fixed-size vectors (a few dozen numbers) when a
small linear solve or recursion is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.operators.fourier import transform
from loupe.operators.scalars import scalars, with_scalars
from loupe.operators.selection import describe_columns
from loupe.operators.series import _keys, ranked, with_lags
from loupe.session import stored


def lag_correlation(df: DataFrame, value: str, order: str, max_lag: int, other: str | None = None,
                    keys=None) -> DataFrame:
    """corr(y_t, x_{t-k}) for k = 1..max_lag: all lags in one pass over blocks,
    then one aggregate (pairs with a null are skipped by ``corr``)."""
    ks = _keys(keys)
    x = other or value
    lagged = with_lags(df.select(*ks, order, F.col(value).alias("_y"), F.col(x).alias("_x")), "_x", order, range(1, max_lag + 1), ks, "_l{k}")
    g = lagged.groupBy(*ks) if ks else lagged
    row = g.agg(*[F.corr("_y", f"_l{k}").alias(f"c{k}") for k in range(1, max_lag + 1)])
    structs = [F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("corr")) for k in range(1, max_lag + 1)]
    return row.select(*ks, F.explode(F.array(*structs)).alias("s")).select(*ks, "s.*")


def autocovariances(df: DataFrame, value: str, order: str, max_lag: int, keys=None) -> DataFrame:
    """gamma_k = (1/n) sum (y_t - mean)(y_{t-k} - mean), k = 0..max_lag, in one
    window + one aggregate (mean from a first aggregate)."""
    ks = _keys(keys)
    mu = df.groupBy(*ks).agg(F.avg(value).alias("_mu"), F.count(value).alias("_n"))
    x = df.join(mu, ks) if ks else with_scalars(df, mu)
    x = x.withColumn("_d", F.col(value) - F.col("_mu"))
    x = with_lags(x.select(*ks, order, "_n", "_d"), "_d", order, range(1, max_lag + 1), ks, "_l{k}")
    g = x.groupBy(*ks) if ks else x
    row = g.agg(F.first("_n").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("s0"),
                *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    structs = [F.struct(F.lit(k).alias("lag"), (F.col(f"s{k}") / F.col("n")).alias("acov"))
               for k in range(0, max_lag + 1)]
    return row.select(*ks, F.explode(F.array(*structs)).alias("s")).select(*ks, "s.*")


def durbin_levinson(acov: Sequence[float]) -> list[float]:
    """PACF from autocovariances gamma_0..gamma_K (Yule-Walker recursion)."""
    K = len(acov) - 1
    rho = [a / acov[0] for a in acov]
    pacf = [1.0]
    phi_prev: list[float] = []
    v = 1.0
    for k in range(1, K + 1):
        num = rho[k] - sum(phi_prev[j] * rho[k - 1 - j] for j in range(k - 1))
        den = 1.0 - sum(phi_prev[j] * rho[j + 1] for j in range(k - 1))
        a = num / den if den != 0 else float("nan")
        phi = [phi_prev[j] - a * phi_prev[k - 2 - j] for j in range(k - 1)] + [a]
        phi_prev = phi
        pacf.append(a)
        v *= (1 - a * a)
    return pacf


def pacf(df: DataFrame, value: str, order: str, max_lag: int = 24) -> DataFrame:
    """Partial autocorrelation (Yule-Walker, biased autocovariances): the
    autocovariances are one Spark aggregate; the recursion runs on the
    max_lag+1 numbers it returns."""
    ac = autocovariances(df, value, order, max_lag).orderBy("lag").collect()
    g = [row_["acov"] for row_ in ac]
    pa = durbin_levinson(g)
    spark = df.sparkSession
    return spark.createDataFrame([(k, g[k] / g[0], pa[k]) for k in range(len(g))],
                                 "lag int, acf double, pacf double")


def zscore(df: DataFrame, value: str, out: str = "z", keys=None) -> DataFrame:
    """(x - mean) / sample std, per group if keys are given."""
    ks = _keys(keys)
    st = df.groupBy(*ks).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    x = df.join(st, ks) if ks else with_scalars(df, st)
    return x.withColumn(out, F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd"))).drop("_mu", "_sd")


def ols_line(df: DataFrame, y: str, x: str, keys=None) -> DataFrame:
    """Least-squares line y = intercept + slope * x (and R^2)."""
    ks = _keys(keys)
    g = df.groupBy(*ks) if ks else df
    return g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                 F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


REACH = 8.5  # bandwidths


def kde_grid(df: DataFrame, value: str, group: str | None = None, gridsize: int = 200,
             cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on a grid, Scott bandwidth h = std * n^(-1/5).

    Rows are first reduced to (value, multiplicity).  A value meets only the
    grid points within REACH bandwidths, beyond which the kernel is below
    3e-16: some points each, fewer the more rows there are.  Every grid point is
    returned, also those that no value reaches; without spread (one value) the
    density is null."""
    ks = [group] if group else []
    v = df.where(F.col(value).isNotNull()).select(*ks, F.col(value).cast("double").alias("_x"))
    pts = stored(v.groupBy(*ks, "_x").agg(F.count(F.lit(1)).alias("_m")), "values")
    # moments of the values with their multiplicities, centred at the mean
    mean = pts.groupBy(*ks).agg(F.sum("_m").alias("_n"), (F.sum(F.col("_x") * F.col("_m")) / F.sum("_m")).alias("_mu"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    c = pts.join(mean, ks) if ks else with_scalars(pts, mean)
    off = F.col("_x") - F.col("_mu")
    st = c.groupBy(*ks, "_n", "_lo", "_hi").agg(F.sqrt(F.try_divide(F.sum(off * off * F.col("_m")), F.col("_n") - 1)).alias("_sd"))
    st = stored(st.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))), "bandwidths")
    step = (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")) / (gridsize - 1)
    st = st.withColumn("_step", step).withColumn("_at", F.col("_lo") - cut * F.col("_h"))
    j = pts.join(st, ks) if ks else with_scalars(pts, st)
    near = lambda side: F.try_divide(F.col("_x") + side * REACH * F.col("_h") - F.col("_at"), F.col("_step"))
    first, last = F.greatest(F.lit(0), F.ceil(near(-1))).cast("int"), F.least(F.lit(gridsize - 1), F.floor(near(1))).cast("int")
    j = j.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("grid_i"))
    x = F.col("_at") + F.col("grid_i") * F.col("_step")
    u = F.try_divide(x - F.col("_x"), F.col("_h"))
    sums = j.groupBy(*ks, "grid_i").agg(F.sum(F.col("_m") * F.exp(-0.5 * u * u)).alias("_sum"))
    grid = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("grid_i"))
    density = F.try_divide(F.coalesce("_sum", F.lit(0.0)), F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    return grid.join(sums, [*ks, "grid_i"], "left").select(*ks, "grid_i", x.alias("x"), density.alias("density"))


def fd_histogram(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Histogram with Freedman-Diaconis bins shared by all groups:
    width = 2 * IQR / n^(1/3); bin = floor((x - min) / width); count and
    percent of the group's rows per bin."""
    ks = [group] if group else []
    # the value may be costly to derive (word counts of texts) and is read by
    # the statistics and by the counts: only the two columns are stored
    v = stored(df.where(F.col(value).isNotNull()).select(*ks, F.col(value).cast("double").alias("_x")), "values")
    o = describe_columns(v, ["_x"], [0.25, 0.75])[0]
    width = 2 * (o["quantiles"][1] - o["quantiles"][0]) / o["count"] ** (1.0 / 3) if o["count"] else 1.0
    low, width = F.lit(o["min"]).cast("double"), F.lit(float(width) if width > 0 else 1.0)
    b = v.withColumn("_lo", low).withColumn("_w", width).withColumn("bin", F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")))
    c = b.groupBy(*ks, "bin").agg(F.count(F.lit(1)).alias("count"),
                                  F.first(F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"))
    tot = c.groupBy(*ks).agg(F.sum("count").alias("_t"))
    c = c.join(tot, ks) if ks else with_scalars(c, tot)
    return c.select(*ks, "bin", "bin_start", "count", (100.0 * F.col("count") / F.col("_t")).alias("percent"))


def periodogram(df: DataFrame, value: str, t: str, fs: float = 365.2425) -> DataFrame:
    """One-sided power spectrum (linear detrend, boxcar window,
    scaling='spectrum'): power_k = c_k |X_k|^2 / n^2 at f_k = k fs / n,
    k = 0..n//2, with c_k = 2 except at 0 and Nyquist.  The transform is
    ``fourier.transform``: n log n work in blocks, any n."""
    sv = scalars(df.agg(F.regr_slope(value, t).alias("_b"), F.regr_intercept(value, t).alias("_a"), F.count(F.lit(1)).alias("_n")))
    n = int(sv["_n"])
    x = df.select(F.col(t).alias("_t"), (F.col(value) - F.lit(sv["_a"]) - F.lit(sv["_b"]) * F.col(t)).alias("_r"))
    g = transform(x, "_t", "_r", n, n // 2)
    scale = F.when((F.col("k") == 0) | ((F.lit(n % 2) == 0) & (F.col("k") == n // 2)), 1.0).otherwise(2.0)
    return g.select("k", (F.col("k") * F.lit(fs / max(n, 1))).alias("freq"),
                    (scale * (F.col("re") ** 2 + F.col("im") ** 2) / F.lit(float(max(n, 1)) ** 2)).alias("power"))


def seasonal_means(df: DataFrame, value: str, ds: str) -> DataFrame:
    """Mean of y by (week of year, weekday) and by (year, day of year) in one
    GROUPING SETS pass; long form (kind, period, position, mean, n)."""
    d = F.to_date(F.col(ds))
    x = df.select(F.weekofyear(d).alias("week"), F.weekday(d).alias("weekday"),
                  F.year(d).alias("year"), F.dayofyear(d).alias("dayofyear"), F.col(value).alias("_v"))
    g = x.groupingSets([["week", "weekday"], ["year", "dayofyear"]], "week", "weekday", "year", "dayofyear").agg(
        F.avg("_v").alias("mean"), F.count("_v").alias("n"), F.grouping_id().alias("_g"))
    weekly = F.col("_g") == 3  # (week, weekday) grouped; year, dayofyear rolled up
    return g.select(F.when(weekly, "week").otherwise("year").alias("kind"),
                    F.when(weekly, F.col("week")).otherwise(F.col("year")).alias("period"),
                    F.when(weekly, F.col("weekday")).otherwise(F.col("dayofyear")).alias("position"),
                    "mean", "n")


def lowess_binned(df: DataFrame, x: str, y: str, frac: float = 2.0 / 3.0, bins: int = 200) -> DataFrame:
    """Locally weighted linear fit (tricube weights, no robustness passes)
    evaluated at up to ``bins`` centres.

    1. One aggregate bins x into ``bins`` equal-width bins and keeps each
       bin's count and sums (x, y, x^2, xy) — the only pass over the rows.
    2. Each non-empty bin's mean x is a centre.  For a centre, bins are
       ranked by distance; the bandwidth h is the distance at which the
       cumulative count first reaches ceil(frac * n).
    3. Weights w = (1 - (d/h)^3)^3 (d < h) apply to every point of a bin;
       the weighted least-squares line from the bin sums gives the fit.
    Steps 2-3 work on at most bins x bins rows."""
    v = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    st = v.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = with_scalars(v, st).withColumn(
        "_b", F.least(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), width)), F.lit(bins - 1)))
    b = b.withColumn("_b", F.coalesce(F.col("_b"), F.lit(0)))
    g = b.groupBy("_b").agg(F.count(F.lit(1)).alias("m"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"),
                            F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_x") * F.col("_y")).alias("sxy"),
                            F.first("_n").alias("n"))
    g = stored(g.withColumn("c", F.col("sx") / F.col("m")), "bins")
    # g has at most ``bins`` rows: fetch them and give each centre the full
    # bin list as a literal array (bins x bins rows in total).
    bl = [(int(x_["_b"]), int(x_["m"]), float(x_["sx"]), float(x_["sy"]), float(x_["sxx"]), float(x_["sxy"]),
           float(x_["c"])) for x_ in g.drop("n").limit(bins + 1).collect()]
    arr = F.array(*[F.struct(F.lit(b_).alias("_b"), F.lit(m_).alias("m"), F.lit(a1).alias("sx"), F.lit(a2).alias("sy"),
                             F.lit(a3).alias("sxx"), F.lit(a4).alias("sxy"), F.lit(c_).alias("c"))
                    for b_, m_, a1, a2, a3, a4, c_ in bl])
    cen = g.select(F.col("_b").alias("centre_bin"), F.col("c").alias("centre"), F.col("n"))
    pairs = cen.select("*", F.explode(arr).alias("_bin")).select("centre_bin", "centre", "n", "_bin.*")
    pairs = pairs.withColumn("d", F.abs(F.col("c") - F.col("centre")))
    w_rank = Window.partitionBy("centre_bin").orderBy("d", "_b").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("cum", F.sum("m").over(w_rank))
    need = F.ceil(F.col("n") * F.lit(frac))
    h = (pairs.where(F.col("cum") >= need).groupBy("centre_bin").agg(F.min("d").alias("h")))
    p = pairs.join(h, "centre_bin")
    u = F.when(F.col("h") > 0, F.col("d") / F.col("h")).otherwise(F.lit(0.0))
    w = F.when(u < 1, F.pow(1 - F.pow(u, 3), 3)).otherwise(F.lit(0.0))
    p = p.withColumn("w", w)
    s = p.groupBy("centre_bin", "centre").agg(
        F.sum(F.col("w") * F.col("m")).alias("s0"), F.sum(F.col("w") * F.col("sx")).alias("s1"),
        F.sum(F.col("w") * F.col("sxx")).alias("s2"), F.sum(F.col("w") * F.col("sy")).alias("t0"),
        F.sum(F.col("w") * F.col("sxy")).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    slope = F.when(det != 0, (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / det).otherwise(F.lit(0.0))
    inter = (F.col("t0") - slope * F.col("s1")) / F.col("s0")
    return s.select("centre_bin", "centre", (inter + slope * F.col("centre")).alias("fitted"))


TAG_BLOCK = 256


def tag_pairs(df: DataFrame, tags: str) -> DataFrame:
    """Pearson correlation of 0/1 tag indicators for every pair of tags:
    ``feature_i > feature_j, corr``.

    ``tags`` holds each row's distinct tags in order.  Pairs that occur are
    counted from the pairs inside each row; the tag counts, one row per tag,
    give the rest, so no indicator column is built and the number of tags has
    no limit."""
    df = stored(df.select(tags), "tags")
    n = F.lit(df.count())
    t = df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("k"))
    inside = df.select(F.posexplode(tags).alias("p", "feature_i"), F.col(tags).alias("_t")).select(
        "feature_i", F.explode(F.slice("_t", F.lit(1), F.col("p"))).alias("feature_j"))
    both = inside.groupBy("feature_i", "feature_j").agg(F.count("*").alias("kab"))
    # tags are numbered and dealt in blocks; all tasks make the pairs of two blocks
    t = ranked(t, "tag", out="no").withColumn("block", F.floor(F.col("no") / TAG_BLOCK))
    blocks = stored(t.groupBy("block").agg(F.collect_list(F.struct("no", "tag", "k")).alias("v")), "tag-blocks")
    low = blocks.select(F.col("block").alias("other"), F.col("v").alias("w"))
    two = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("other")).join(low, "other").repartition("block", "other")
    pairs = two.select("w", F.explode("v").alias("a")).select("a", F.explode("w").alias("b")).where("a.no > b.no")
    pairs = pairs.select(F.col("a.tag").alias("feature_i"), F.col("b.tag").alias("feature_j"), F.col("a.k").alias("ki"), F.col("b.k").alias("kj"))
    x = pairs.join(both, ["feature_i", "feature_j"], "left").fillna(0, ["kab"])
    ki, kj = F.col("ki"), F.col("kj")
    corr = (n * F.col("kab") - ki * kj) / F.sqrt((ki * (n - ki)).cast("double") * (kj * (n - kj)))
    return x.select("feature_i", "feature_j", corr.alias("corr"))
