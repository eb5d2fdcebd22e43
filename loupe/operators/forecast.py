"""Additive forecast: piecewise linear trend, weekly and yearly seasons and
holidays, with an interval that widens over the horizon.

The facts are reduced to one row a date (count, sum, sum of squares); the
normal equations of those rows are the facts' own.  Intercept, trend and
holidays are not penalised, seasons lightly by squares, and slope changes by
their absolute values, so that most are exactly 0.  That small problem is
solved from the Gram matrix: the freely or squarely penalised columns are
eliminated, and the changes found by coordinate descent on what is left."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.operators.models import cross_products, gram_from_row
from loupe.session import stored

PERIODS = (("weekly", 7.0, 3), ("yearly", 365.25, 10))


def additive_design(dates: DataFrame, ds: str, t0, span_days: float, changepoints: Sequence[float],
                    holidays: DataFrame | None = None, names: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Columns of the model at each date, and their groups: trend (t, scaled to
    [0, 1] over the history, and a hinge at each changepoint), sine and cosine
    terms of each period, one indicator a holiday name."""
    day = F.datediff(F.col(ds), F.lit(t0).cast("date")).cast("double")
    t = day / F.lit(span_days)
    groups: dict[str, list[str]] = {"trend": ["_t"], "changes": [], "holidays": []}
    cols = [t.alias("_t")]
    for j, c in enumerate(changepoints):
        cols.append(F.greatest(F.lit(0.0), t - F.lit(float(c))).alias(f"_cp{j}"))
        groups["changes"].append(f"_cp{j}")
    for name, period, order in PERIODS:
        groups[name] = []
        for i in range(1, order + 1):
            angle = F.lit(2 * math.pi * i / period) * day
            cols += [F.sin(angle).alias(f"_{name}_s{i}"), F.cos(angle).alias(f"_{name}_c{i}")]
            groups[name] += [f"_{name}_s{i}", f"_{name}_c{i}"]
    x = dates.select("*", F.lit(1.0).alias("_one"), *cols)
    if names:
        on = holidays.select(F.col("ds").alias(ds), "holiday").groupBy(ds).agg(F.collect_set("holiday").alias("_names"))
        x = x.join(on, ds, "left")
        for j, name in enumerate(names):
            x = x.withColumn(f"_hol{j}", F.coalesce(F.array_contains("_names", name), F.lit(False)).cast("double"))
            groups["holidays"].append(f"_hol{j}")
        x = x.drop("_names")
    return x, groups


def sparse_ridge(gram: np.ndarray, xy: np.ndarray, squares: np.ndarray, sparse: Sequence[int], penalty: float) -> np.ndarray:
    """Minimise b'Gb/2 - b'xy + sum squares_i b_i^2 / 2 + penalty * sum |b_j|
    over j in ``sparse``."""
    k = len(xy)
    sparse = list(sparse)
    rest = [i for i in range(k) if i not in set(sparse)]
    a = gram + np.diag(squares)
    inner = np.linalg.pinv(a[np.ix_(rest, rest)], rcond=1e-12)
    cross = a[np.ix_(sparse, rest)]
    g = a[np.ix_(sparse, sparse)] - cross @ inner @ cross.T
    c = xy[sparse] - cross @ inner @ xy[rest]
    b = np.zeros(len(sparse))
    for _ in range(20_000):
        before = b.copy()
        for j in range(len(b)):
            if g[j, j] > 0:
                left = c[j] - g[j] @ b + g[j, j] * b[j]
                b[j] = math.copysign(max(abs(left) - penalty, 0.0), left) / g[j, j]
        if np.abs(b - before).max(initial=0) <= 1e-10 * max(1.0, np.abs(b).max(initial=0)):
            break
    out = np.zeros(k)
    out[sparse], out[rest] = b, inner @ (xy[rest] - cross.T @ b)
    return out


def additive_forecast(history: DataFrame, ds: str, y: str, horizon: int = 364, n_changepoints: int = 25, changepoint_range: float = 0.8,
                      holidays: DataFrame | None = None, flexibility: float = 0.05, season_scale: float = 10.0, z: float = 1.96) -> DataFrame:
    """``ds, trend, weekly, yearly, holidays, yhat, yhat_lower, yhat_upper``
    for the history's dates and ``horizon`` days after them.

    Several rows a date are fine; null dates and values are left out.
    ``holidays`` has ``ds`` and, where holidays have effects of their own,
    ``holiday``; their names are few and are listed on the driver.  With y
    scaled to 1, slope changes have a Laplace prior of scale ``flexibility``
    and seasons a normal one of ``season_scale``; the noise they are weighed
    against is that of the fit.

    The interval's variance is the noise's, and beyond the history that of
    slope changes to come, as frequent and on average as large as those found:
    it grows with the third power of the horizon."""
    spark = history.sparkSession
    v = F.col(y).cast("double")
    daily = stored(history.where(F.col(ds).isNotNull() & v.isNotNull()).groupBy(F.col(ds)).agg(
        F.count("*").cast("double").alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_ss")), "daily")
    b = daily.agg(F.min(ds).alias("lo"), F.max(ds).alias("hi"), F.sum("_n").alias("n"), F.max(F.abs(F.col("_s") / F.col("_n"))).alias("size"), F.sum("_ss").alias("ss")).first()
    kinds = f"{ds} date, trend double, weekly double, yearly double, holidays double, yhat double, yhat_lower double, yhat_upper double"
    if b["lo"] is None:
        return spark.createDataFrame([], kinds)
    if holidays is not None:
        holidays = holidays.select("ds", F.col("holiday") if "holiday" in holidays.columns else F.lit("holiday").alias("holiday")).where("ds is not null and holiday is not null")
    names = sorted(r[0] for r in holidays.select("holiday").distinct().collect()) if holidays is not None else []
    span, size = float(max((b["hi"] - b["lo"]).days, 1)), b["size"] or 1.0
    points = [changepoint_range * (j + 1) / (n_changepoints + 1) for j in range(n_changepoints)]
    x, groups = additive_design(daily, ds, b["lo"], span, points, holidays, names)
    cols = ["_one", *groups["trend"], *groups["changes"], *(c for name, _, _ in PERIODS for c in groups[name]), *groups["holidays"]]
    root = F.sqrt("_n")
    g, _ = gram_from_row(cross_products(x.select(*[(F.col(c) * root).alias(c) for c in cols], (F.col("_s") / root / size).alias("_y")), [*cols, "_y"]).first(), len(cols) + 1)
    gram, xy, yy, n = g[:-1, :-1], g[:-1, -1], b["ss"] / size**2, b["n"]
    seasons = np.array([any(c in groups[name] for name, _, _ in PERIODS) for c in cols], float)
    changes = [cols.index(c) for c in groups["changes"]]
    beta, noise = np.zeros(len(cols)), max(yy / n - (xy[0] / n) ** 2, 1e-12)
    for _ in range(30):  # penalties are weighed against the noise that the fit leaves
        beta = sparse_ridge(gram, xy, seasons * noise / season_scale**2 + 1e-9, changes, noise / flexibility)
        new = max((yy - 2 * beta @ xy + beta @ gram @ beta) / max(n - np.count_nonzero(beta), 1), 1e-12)
        if abs(new - noise) <= 1e-8 * noise:
            break
        noise = new
    beta, sigma2 = beta * size, noise * size**2
    future = spark.range(1, horizon + 1).select(F.date_add(F.lit(b["hi"]), F.col("id").cast("int")).alias(ds))
    grid, _ = additive_design(daily.select(ds).unionByName(future), ds, b["lo"], span, points, holidays, names)
    value = dict(zip(cols, beta))

    def part(of: Sequence[str]) -> Column:
        e = F.lit(0.0)
        for c in of:
            if value[c]:
                e = e + F.lit(float(value[c])) * F.col(c)
        return e
    found = [value[c] for c in groups["changes"] if value[c]]
    rate, mean = len(found) / changepoint_range, float(np.mean(np.abs(found))) if found else 0.0  # per unit of t
    ahead = F.greatest(F.lit(0.0), F.col("_t") - 1)
    sd = F.sqrt(F.lit(float(sigma2)) + F.lit(2 * rate * mean**2 / 3) * F.pow(ahead, F.lit(3.0)))
    out = grid.select(ds, part(["_one", *groups["trend"], *groups["changes"]]).alias("trend"), part(groups["weekly"]).alias("weekly"),
                      part(groups["yearly"]).alias("yearly"), part(groups["holidays"]).alias("holidays"), sd.alias("_sd"))
    yhat = F.col("trend") + F.col("weekly") + F.col("yearly") + F.col("holidays")
    return out.withColumn("yhat", yhat).withColumn("yhat_lower", F.col("yhat") - z * F.col("_sd")).withColumn("yhat_upper", F.col("yhat") + z * F.col("_sd")).drop("_sd")
