"""Models and evaluation (MDL*, EVL*, CLN10).

Heavy work runs on executors as aggregates (cross products X'X / X'y,
tree statistics inside ``pyspark.ml``); only coefficient vectors and other
fixed-size results reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.operators.scalars import with_scalars
from loupe.operators.series import halo_window, position
from loupe.session import materialize


def tabular_prepare(df: DataFrame, cat_cols: Sequence[str], num_cols: Sequence[str],
                    train_flag: str) -> DataFrame:
    """Categorify + FillMissing(median, with flag) + Normalize(z, population),
    statistics fitted on the rows where ``train_flag`` is true.

    Category codes are 1..k in sorted order of the training values, 0 for
    unseen or null.  The code tables have one row per category."""
    train = df.where(F.col(train_flag))
    out = df
    for c in cat_cols:
        codes = position(train.select(c).where(F.col(c).isNotNull()).distinct(), c, out=f"{c}_code", start=1)
        out = out.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(0)))
    if num_cols:
        from loupe.operators.selection import describe_columns
        for o in describe_columns(train, num_cols, [0.5]):
            out = out.withColumn(f"_med_{o['column']}", F.lit(o["quantiles"][0]).cast("double"))
        for c in num_cols:
            out = (out.withColumn(f"{c}_na", F.col(c).isNull())
                   .withColumn(f"_f_{c}", F.coalesce(F.col(c), F.col(f"_med_{c}"))))
        st = out.where(F.col(train_flag)).agg(
            *[x for c in num_cols for x in (F.avg(f"_f_{c}").alias(f"_mu_{c}"),
                                            F.stddev_pop(f"_f_{c}").alias(f"_sd_{c}"))])
        out = with_scalars(out, st)
        for c in num_cols:
            out = out.withColumn(f"{c}_norm", F.try_divide(F.col(f"_f_{c}") - F.col(f"_mu_{c}"),
                                                           F.col(f"_sd_{c}")))
        out = out.drop(*[x for c in num_cols for x in (f"_med_{c}", f"_f_{c}", f"_mu_{c}", f"_sd_{c}")])
    return out


# ----------------------------------------------------------------- OLS core
class _no_constraint_inference:
    """Plan wide lag designs without Catalyst's constraint inference, which
    grows combinatorially with dozens of lag columns and their null filters.
    It only adds inferred filters, never changes results; the previous
    setting is restored on exit."""

    KEY = "spark.sql.constraintPropagation.enabled"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get(self.KEY, "true")
        self.spark.conf.set(self.KEY, "false")
        return self

    def __exit__(self, *exc):
        self.spark.conf.set(self.KEY, self.old)
        return False



def cross_products(df: DataFrame, cols: Sequence[str], keys=None) -> DataFrame:
    """ONE pass computing all pairwise sums sum(c_i * c_j), i <= j (the
    normal equations' X'X with y included as a column) and the row count.

    Each partition multiplies its Arrow batches as a matrix (numpy BLAS) and
    emits one partial upper triangle per key; ``Summarizer.sum`` then adds the
    partials (partial aggregation, so a hot key is split across all tasks
    that hold it).  Rows with a null in any column are left out (listwise)."""
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    ks = [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))
    k = len(cols)
    iu = np.triu_indices(k)
    x = df.dropna(subset=list(cols)).select(*ks, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    key_types = dict(x.dtypes)

    def partial(batches):
        acc: dict = {}
        key_arrow_types = None
        for b in batches:
            if key_arrow_types is None:
                key_arrow_types = [b.schema.field(i).type for i in range(len(ks))]
            if b.num_rows == 0:
                continue
            m = np.column_stack([b.column(len(ks) + i).to_numpy(zero_copy_only=False) for i in range(k)])
            if ks:
                kv = list(zip(*[b.column(i).to_pylist() for i in range(len(ks))]))
                groups: dict = {}
                for r_, kk in enumerate(kv):
                    groups.setdefault(kk, []).append(r_)
                items = [(kk, m[idx]) for kk, idx in groups.items()]
            else:
                items = [((), m)]
            for kk, sub in items:
                g, n = acc.get(kk, (np.zeros((k, k)), 0))
                acc[kk] = (g + sub.T @ sub, n + sub.shape[0])
        if acc:
            arrays = [pa.array([kk[i] for kk in acc], type=key_arrow_types[i]) for i in range(len(ks))]
            arrays.append(pa.array([n for _, n in acc.values()], type=pa.int64()))
            arrays.append(pa.array([g[iu].tolist() for g, _ in acc.values()], type=pa.list_(pa.float64())))
            names = [f"_k{i}" for i in range(len(ks))] + ["_n", "_g"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = ", ".join([f"_k{i} {key_types[kname]}" for i, kname in enumerate(ks)] + ["_n long", "_g array<double>"])
    parts = x.mapInArrow(partial, schema)
    parts = parts.select(*[F.col(f"_k{i}").alias(kname) for i, kname in enumerate(ks)], "_n",
                         array_to_vector("_g").alias("_v"))
    g = parts.groupBy(*ks) if ks else parts
    return g.agg(F.sum("_n").alias("_n"), Summarizer.sum(F.col("_v")).alias("_xp"))


def gram_from_row(row, k: int):
    """Rebuild the symmetric k x k matrix from a ``cross_products`` row."""
    import numpy as np
    m = np.zeros((k, k))
    n = int(row["_n"] or 0)
    if n == 0 or row["_xp"] is None:
        return m, n
    v = row["_xp"].toArray()
    p = 0
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = v[p]
            p += 1
    return m, n


def ols_from_gram(G, xi, yi, ridge: float = 0.0):
    """Least squares from a Gram matrix G (columns: regressors ``xi``, target
    ``yi``): coefficients, SSR, standard errors."""
    import numpy as np
    XtX = G[np.ix_(xi, xi)]
    Xty = G[xi, yi]
    yty = G[yi, yi]
    A = XtX + ridge * np.eye(len(xi))
    b = np.linalg.solve(A, Xty)
    ssr = float(yty - 2 * b @ Xty + b @ XtX @ b)
    return b, max(ssr, 0.0), A


# --------------------------------------------------------- ADF unit root test
# MacKinnon (2010) critical-value response surface and
# MacKinnon (1994) p-value polynomials for the constant-only ADF regression,
# one series (published tables).
ADF_CRIT_C = {"1%": (-3.43035, -6.5393, -16.786, -79.433),
              "5%": (-2.86154, -2.8903, -4.234, -40.040),
              "10%": (-2.56677, -1.5384, -2.809, 0.0)}
ADF_P_SMALL_C = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE_C = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_TAU_MAX_C, ADF_TAU_MIN_C, ADF_TAU_STAR_C = 2.74, -18.83, -1.61


def _norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def adf_pvalue(stat: float) -> float:
    if stat > ADF_TAU_MAX_C:
        return 1.0
    if stat < ADF_TAU_MIN_C:
        return 0.0
    coef = ADF_P_SMALL_C if stat <= ADF_TAU_STAR_C else ADF_P_LARGE_C
    return _norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def adf_critical(nobs: int) -> dict:
    return {k: sum(c / nobs ** i for i, c in enumerate(v)) for k, v in ADF_CRIT_C.items()}


def _adf_design(df: DataFrame, value: str, order: str, maxlag: int, keys=()) -> DataFrame:
    """Level, difference and lagged differences of each series, with its row
    number: one pass over blocks of the order."""
    x = df.withColumn("_x", F.col(value).cast("double"))

    def lagged(w):
        lag = [F.col("_x")] + [F.lag("_x", k).over(w) for k in range(1, maxlag + 2)]
        return [lag[1].alias("_lvl"), (lag[0] - lag[1]).alias("_dx"), *[(lag[k] - lag[k + 1]).alias(f"_dx{k}") for k in range(1, maxlag + 1)],
                (F.col("_g") + 1).alias("_rn")]
    return halo_window(x, order, keys, -(maxlag + 1), 0, lagged).withColumn("_one", F.lit(1.0))


def adf_test(df: DataFrame, value: str, order: str, maxlag: int | None = None,
             autolag: str = "AIC") -> dict:
    """Augmented Dickey-Fuller test with a constant, lag length by AIC.

    The ordered series is one row per time point; the regressions use two
    Spark aggregates of cross products (one on the common sample for the lag
    search, one for the chosen lag), solved on the driver."""
    n_obs = df.where(F.col(value).isNotNull()).count()
    if maxlag is None:
        maxlag = int(math.ceil(12.0 * (n_obs / 100.0) ** 0.25))
        maxlag = max(0, min(n_obs // 2 - 2, maxlag))
    from loupe.session import materialize
    x = materialize(_adf_design(df.where(F.col(value).isNotNull()), value, order, maxlag))
    cols = ["_one", "_lvl"] + [f"_dx{k}" for k in range(1, maxlag + 1)] + ["_dx"]
    yi = len(cols) - 1
    best = (0, None)
    if autolag and maxlag > 0:
        row = cross_products(x.where(F.col("_rn") > maxlag + 1), cols).first()
        G, n = gram_from_row(row, len(cols))
        best_aic = None
        for lag in range(0, maxlag + 1):
            xi = list(range(0, 2 + lag))
            _, ssr, _ = ols_from_gram(G, xi, yi)
            aic = n * math.log(2 * math.pi) + n * math.log(ssr / n) + n + 2 * len(xi)
            if best_aic is None or aic < best_aic:
                best_aic, best = aic, (lag, aic)
        used = best[0]
    else:
        used = maxlag
    cols2 = ["_one", "_lvl"] + [f"_dx{k}" for k in range(1, used + 1)] + ["_dx"]
    row = cross_products(x.where(F.col("_rn") > used + 1), cols2).first()
    G, n = gram_from_row(row, len(cols2))
    import numpy as np
    xi = list(range(0, len(cols2) - 1))
    b, ssr, A = ols_from_gram(G, xi, len(cols2) - 1)
    sigma2 = ssr / (n - len(xi))
    se = math.sqrt(sigma2 * np.linalg.inv(A)[1, 1])
    stat = float(b[1] / se)
    crit = adf_critical(n)
    return {"adf_stat": stat, "pvalue": adf_pvalue(stat), "usedlag": used, "nobs": n,
            "crit_1": crit["1%"], "crit_5": crit["5%"], "crit_10": crit["10%"],
            "icbest": best[1]}


# ------------------------------------------------------------ ARIMA search
def _lag_block(df: DataFrame, col: str, order: str, lags: int, prefix: str, keys=()) -> DataFrame:
    """Lags 1..``lags`` of a column and the row number, in blocks of the order."""
    return halo_window(df, order, keys, -lags, 0, lambda w: [
        *[F.lag(col, k).over(w).alias(f"{prefix}{k}") for k in range(1, lags + 1)], (F.col("_g") + 1).alias("_rn")])


def _differenced(df: DataFrame, col: str, order: str, keys=(), when=None) -> DataFrame:
    """First differences of a column (of rows that meet ``when``); a series
    loses its first row."""
    x = halo_window(df, order, keys, -1, 0, lambda w: [F.lag(col, 1).over(w).alias("_before")])
    new = F.col(col) - F.col("_before")
    return x.withColumn(col, new if when is None else F.when(when, new).otherwise(F.col(col))).drop("_before").where(F.col(col).isNotNull())


def arima_select(df: DataFrame, value: str, order: str, max_p: int = 3, max_q: int = 3,
                 max_d: int = 2, long_ar: int = 10, alpha: float = 0.05) -> list[dict]:
    """Choose (p, d, q) by AIC.

    d: difference until the ADF test rejects a unit root (at most ``max_d``).
    AR and MA terms: Hannan-Rissanen — a long AR(``long_ar``) fit gives
    innovation estimates e_t; then z_t is regressed on p lags of z and q lags
    of e.  All candidates are solved from ONE cross-product aggregate on a
    common sample; AIC = n log(SSR/n) + 2 (p + q + 1)."""
    import numpy as np
    z = df.select(order, F.col(value).cast("double").alias("z")).where(F.col("z").isNotNull())
    d = 0
    while d < max_d and adf_test(z, "z", order)["pvalue"] >= alpha:
        z = _differenced(z, "z", order)
        d += 1
    # Stage 1: long autoregression -> innovations.
    z1 = _lag_block(z, "z", order, long_ar, "_z").withColumn("_one", F.lit(1.0))
    from loupe.session import materialize
    z1 = materialize(z1)
    c1 = ["_one"] + [f"_z{k}" for k in range(1, long_ar + 1)] + ["z"]
    G, _ = gram_from_row(cross_products(z1.where(F.col("_rn") > long_ar), c1).first(), len(c1))
    b1, _, _ = ols_from_gram(G, list(range(len(c1) - 1)), len(c1) - 1)
    fit = F.lit(float(b1[0]))
    for k in range(1, long_ar + 1):
        fit = fit + F.lit(float(b1[k])) * F.col(f"_z{k}")
    z2 = z1.withColumn("_e", F.when(F.col("_rn") > long_ar, F.col("z") - fit)).drop("_rn")
    z2 = _lag_block(z2, "_e", order, max_q, "_e")
    start = long_ar + max(max_p, max_q)
    c2 = ["_one"] + [f"_z{k}" for k in range(1, max_p + 1)] + [f"_e{k}" for k in range(1, max_q + 1)] + ["z"]
    G2, n = gram_from_row(cross_products(z2.where(F.col("_rn") > start), c2).first(), len(c2))
    out = []
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            xi = [0] + list(range(1, p + 1)) + list(range(1 + max_p, 1 + max_p + q))
            _, ssr, _ = ols_from_gram(G2, xi, len(c2) - 1)
            aic = n * math.log(ssr / n) + 2 * (p + q + 1) if ssr > 0 else float("-inf")
            out.append({"p": p, "d": d, "q": q, "aic": aic, "nobs": n})
    best = min(out, key=lambda r_: (r_["aic"], r_["p"] + r_["q"]))
    for r_ in out:
        r_["chosen"] = r_ is best
    return out


# ------------------------------------------------------------ ML pipelines
def gbt_classifier_pipeline(num_cols: Sequence[str], cat_cols: Sequence[str], label: str,
                            max_iter: int = 20, seed: int = 42):
    """Imputer(most frequent) -> StandardScaler -> GBTClassifier, with
    categorical columns indexed first (unseen -> extra index)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
    stages = []
    idx_cols = []
    for c in cat_cols:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        idx_cols.append(f"{c}_idx")
    imp_out = [f"{c}_imp" for c in num_cols]
    stages.append(Imputer(inputCols=list(num_cols), outputCols=imp_out, strategy="mode"))
    stages.append(VectorAssembler(inputCols=imp_out + idx_cols, outputCol="_raw", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    stages.append(GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=4,
                                seed=seed, checkpointInterval=10))
    return Pipeline(stages=stages)


BINS = 32  # of a numeric column, as many as a tree's split search takes


def bin_splits(df: DataFrame, col: str, most: int = BINS) -> list[float]:
    """Edges that give each value its own bin, or with more than ``most``
    values, bins of about equal counts."""
    few = sorted(r[0] for r in df.select(col).distinct().limit(most + 1).collect())
    cuts = few[1:] or few if len(few) <= most else df.approxQuantile(col, [k / most for k in range(1, most)], 0.001)
    return [-math.inf, *sorted({c for c in cuts if math.isfinite(c)} or {0.0}), math.inf]


class CountedTrees:
    """Boosted regression trees over counted rows: the rows are binned as the
    split search does it, and those alike in all features become one row with
    their mean label, weighed by their number.  Squared error splits these as
    it splits the rows, so the passes of the boosting read a table bounded by
    the bins and not the input.  Fitted, it is a plain pipeline model."""

    def __init__(self, num_cols: Sequence[str], cat_cols: Sequence[str], label: str, max_iter: int, seed: int):
        self.num_cols, self.cat_cols, self.label, self.max_iter, self.seed = list(num_cols), list(cat_cols), label, max_iter, seed

    def fit(self, df: DataFrame):
        from pyspark.ml import Pipeline, PipelineModel
        from pyspark.ml.feature import Bucketizer, Imputer, StandardScaler, StringIndexer, VectorAssembler
        from pyspark.ml.regression import GBTRegressor
        imp, idx, binned = ([f"{c}_{x}" for c in cols] for cols, x in ((self.num_cols, "imp"), (self.cat_cols, "idx"), (self.num_cols, "bin")))
        stages = [StringIndexer(inputCols=self.cat_cols, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc")] if idx else []
        stages += [Imputer(inputCols=self.num_cols, outputCols=imp, strategy="median")] if imp else []
        ready = Pipeline(stages=stages).fit(df)
        x, bins = ready.transform(df), []
        if imp:
            bins = [Bucketizer(splitsArray=[bin_splits(x, c) for c in imp], inputCols=imp, outputCols=binned)]
            x = bins[0].transform(x)
        x = materialize(x.groupBy(*binned, *idx).agg(F.avg(self.label).alias(self.label), F.count("*").cast("double").alias("_rows")))
        trees = Pipeline(stages=[
            VectorAssembler(inputCols=binned + idx, outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
            GBTRegressor(featuresCol="features", labelCol=self.label, weightCol="_rows", maxIter=self.max_iter, maxDepth=5,
                         maxBins=BINS, seed=self.seed, checkpointInterval=10)]).fit(x)
        return PipelineModel([*ready.stages, *bins, *trees.stages])


def gbt_regressor_pipeline(num_cols: Sequence[str], cat_cols: Sequence[str], label: str,
                           max_iter: int = 20, seed: int = 42):
    """Categorify (index) + median fill + bins + scale -> GBTRegressor."""
    return CountedTrees(num_cols, cat_cols, label, max_iter, seed)


# ----------------------------------------------------------------- metrics
def rmsle(df: DataFrame, target: str, pred: str, keys=None) -> DataFrame:
    ks = [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))
    e = F.log1p(F.col(target)) - F.log1p(F.col(pred))
    g = df.groupBy(*ks) if ks else df
    return g.agg(F.sqrt(F.avg(e * e)).alias("rmsle"))


def mae_mse(df: DataFrame, target: str, pred: str, keys=None) -> DataFrame:
    ks = [] if keys is None else ([keys] if isinstance(keys, str) else list(keys))
    e = F.col(target) - F.col(pred)
    g = df.groupBy(*ks) if ks else df
    return g.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def auc_rank(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact ROC AUC by the rank-sum rule with tied scores sharing ranks:
    rows are grouped by score (pos/neg counts per distinct score), negatives
    below each score come from a distributed running sum, and
    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N)."""
    from loupe.operators.series import cumulative_sum
    from loupe.session import materialize
    g = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_neg"))
    g = materialize(g)  # one row per distinct score, read by several jobs
    g = cumulative_sum(g, score, "_neg", out="_cneg")
    contrib = F.col("_pos") * (F.col("_cneg") - F.col("_neg") + F.col("_neg") / 2.0)
    return g.agg((F.sum(contrib) / (F.sum("_pos") * F.sum("_neg"))).alias("auc"),
                 F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))


def ols_by_key(df: DataFrame, keys, x_cols: Sequence[str], y_col: str, ridge: float = 0.0,
               intercept: bool = True) -> DataFrame:
    """Least squares per series for any number of series.

    One grouped cross-product aggregate gives each series' (k+1)x(k+1) Gram
    matrix (partials from every partition, so a hot series is split); the
    small solves then run on executors, one row per series, in
    ``mapInPandas`` — nothing per series reaches the driver.
    Output: keys, n, coef_<name> ..., ssr, r2."""
    import numpy as np
    import pandas as pd
    ks = [keys] if isinstance(keys, str) else list(keys)
    xs = (["_one"] if intercept else []) + list(x_cols)
    src = df.withColumn("_one", F.lit(1.0)) if intercept else df
    g = cross_products(src, xs + [y_col], keys=ks)
    k = len(xs) + 1
    names = ["intercept" if c == "_one" else c for c in xs]
    key_types = dict(g.dtypes)

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r_ in pdf.iterrows():
                G, n = gram_from_row({"_n": r_["_n"], "_xp": _Vec(r_["_xp"])}, k)
                xi = list(range(k - 1))
                try:
                    b, ssr, _ = ols_from_gram(G, xi, k - 1, ridge)
                except np.linalg.LinAlgError:
                    b, ssr = np.full(k - 1, np.nan), float("nan")
                sy, syy = (G[0, k - 1], G[k - 1, k - 1]) if intercept else (np.nan, np.nan)
                sst = syy - sy * sy / n if intercept and n else float("nan")
                r2 = 1 - ssr / sst if intercept and sst and sst > 0 else float("nan")
                out.append([r_[c] for c in ks] + [n] + [float(v) for v in b] + [ssr, r2])
            yield pd.DataFrame(out, columns=ks + ["n"] + [f"coef_{c}" for c in names] + ["ssr", "r2"])

    schema = ", ".join([f"`{c}` {key_types[c]}" for c in ks] + ["n long"] + [f"`coef_{c}` double" for c in names]
                       + ["ssr double", "r2 double"])
    from pyspark.ml.functions import vector_to_array
    return g.select(*ks, "_n", vector_to_array("_xp").alias("_xp")).mapInPandas(solve, schema)


class _Vec:
    """Adapter so ``gram_from_row`` can read a plain array as a vector."""

    def __init__(self, arr):
        self._a = arr

    def toArray(self):
        import numpy as np
        return np.asarray(self._a, dtype=float)


def adf_by_key(df: DataFrame, value: str, order: str, keys, maxlag: int | None = None) -> DataFrame:
    """ADF test (constant, AIC lag choice up to ``maxlag``, by default each
    series' own limit as in ``adf_test``) for every series
    at once; see ``_adf_by_key``.  The per-series result (one row per series)
    is written out, so callers plan a simple leaf."""
    from loupe.session import materialize
    with _no_constraint_inference(df.sparkSession):
        return materialize(_adf_by_key(df, value, order, keys, maxlag))


def _adf_by_key(df: DataFrame, value: str, order: str, keys, maxlag: int | None = None) -> DataFrame:
    """ADF test (constant, AIC lag choice up to ``maxlag``) for every series
    at once.  Two grouped cross-product passes (lag search on each series'
    common sample, then the chosen lag on its own sample); all per-series
    solves run on executors, so the number of series is unbounded.
    Output: keys, adf_stat, pvalue, usedlag, nobs, crit_1, crit_5, crit_10."""
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import vector_to_array
    ks = [keys] if isinstance(keys, str) else list(keys)
    x = df.where(F.col(value).isNotNull()).select(*ks, order, F.col(value).cast("double").alias("_x"))
    # the lag limit follows the length of each series; the design is as wide as the largest
    n_obs = F.col("_n_obs")
    limit = F.lit(maxlag) if maxlag is not None else F.greatest(F.lit(0), F.least(
        F.floor(n_obs / 2) - 2, F.ceil(12.0 * F.pow(n_obs / 100.0, F.lit(0.25)))))
    x = x.join(x.groupBy(*ks).agg(F.count("*").alias("_n_obs")), ks).withColumn("_m", limit.cast("int")).drop("_n_obs")
    if maxlag is None:
        maxlag = x.agg(F.max("_m")).first()[0] or 0
    from loupe.session import materialize
    x = materialize(_adf_design(x, "_x", order, maxlag, ks))
    cols = ["_one", "_lvl"] + [f"_dx{k}" for k in range(1, maxlag + 1)] + ["_dx"]
    k = len(cols)
    key_types = dict(x.dtypes)

    def rows_of(pdf):
        for _, r_ in pdf.iterrows():
            G, n = gram_from_row({"_n": r_["_n"], "_xp": _Vec(r_["_xp"])}, k)
            yield r_, G, n

    def pick_lag(batches):
        for pdf in batches:
            out = []
            for r_, G, n in rows_of(pdf):
                best, best_aic = 0, None
                for lag in range(0, int(r_["_m"]) + 1):
                    try:
                        _, ssr, _ = ols_from_gram(G, list(range(2 + lag)), k - 1)
                    except np.linalg.LinAlgError:
                        continue
                    if ssr <= 0 or n <= 0:
                        continue
                    aic = n * math.log(2 * math.pi) + n * math.log(ssr / n) + n + 2 * (2 + lag)
                    if best_aic is None or aic < best_aic:
                        best, best_aic = lag, aic
                out.append([r_[c] for c in ks] + [best])
            yield pd.DataFrame(out, columns=ks + ["_used"])

    key_schema = [f"`{c}` {key_types[c]}" for c in ks]
    # lags past a series' own limit may be null on its first rows; the search does not read them
    first = x.where(F.col("_rn") > F.col("_m") + 1).select(*ks, "_m", "_one", "_lvl", "_dx", *[
        F.coalesce(F.col(f"_dx{i}"), F.lit(0.0)).alias(f"_dx{i}") for i in range(1, maxlag + 1)])
    g1 = cross_products(first, cols, keys=ks + ["_m"])
    used = g1.select(*ks, "_m", "_n", vector_to_array("_xp").alias("_xp")).mapInPandas(
        pick_lag, ", ".join(key_schema + ["_used int"]))
    # second pass: each series on its own sample for its chosen lag.  Lags the
    # series does not use may be null on its first rows; they are zeroed so
    # the rows are kept (the solve only reads the columns it uses, which are
    # never null on that sample).
    y = x.join(used, ks).where(F.col("_rn") > F.col("_used") + 1)
    y = y.select(*ks, "_used", *[F.coalesce(F.col(f"_dx{i}"), F.lit(0.0)).alias(f"_dx{i}")
                                 for i in range(1, maxlag + 1)], "_one", "_lvl", "_dx")
    g2 = cross_products(y, cols, keys=ks + ["_used"])

    def final(batches):
        for pdf in batches:
            out = []
            for r_, G, n in rows_of(pdf):
                u = int(r_["_used"])
                xi = list(range(2 + u))
                try:
                    b, ssr, A = ols_from_gram(G, xi, k - 1)
                    se = math.sqrt(ssr / (n - len(xi)) * np.linalg.inv(A)[1, 1])
                    stat = float(b[1] / se)
                except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
                    stat = float("nan")
                crit = adf_critical(n)
                p = adf_pvalue(stat) if stat == stat else float("nan")
                out.append([r_[c] for c in ks] + [stat, p, u, n, crit["1%"], crit["5%"], crit["10%"]])
            yield pd.DataFrame(out, columns=ks + ["adf_stat", "pvalue", "usedlag", "nobs", "crit_1", "crit_5", "crit_10"])

    schema = ", ".join(key_schema + ["adf_stat double", "pvalue double", "usedlag int", "nobs long",
                                     "crit_1 double", "crit_5 double", "crit_10 double"])
    return g2.select(*ks, "_used", "_n", vector_to_array("_xp").alias("_xp")).mapInPandas(final, schema)


def arima_select_by_key(df: DataFrame, value: str, order: str, keys, max_p: int = 3, max_q: int = 3,
                        max_d: int = 2, long_ar: int = 10, alpha: float = 0.05, adf_maxlag: int | None = None) -> DataFrame:
    """``arima_select`` for every series at once; see ``_arima_select_by_key``."""
    from loupe.session import materialize
    with _no_constraint_inference(df.sparkSession):
        return materialize(_arima_select_by_key(df, value, order, keys, max_p, max_q, max_d, long_ar, alpha,
                                                adf_maxlag))


def _arima_select_by_key(df: DataFrame, value: str, order: str, keys, max_p: int = 3, max_q: int = 3,
                         max_d: int = 2, long_ar: int = 10, alpha: float = 0.05, adf_maxlag: int | None = None) -> DataFrame:
    """``arima_select`` for every series at once (Hannan-Rissanen, AIC).

    d per series from repeated grouped ADF tests; the long-AR fit and the
    (p, q) scoring come from grouped cross-product passes whose small solves
    run on executors.  Output: keys, p, d, q, aic, nobs, chosen."""
    import numpy as np
    import pandas as pd
    from pyspark.ml.functions import vector_to_array
    from loupe.session import materialize
    ks = [keys] if isinstance(keys, str) else list(keys)
    z = df.where(F.col(value).isNotNull()).select(*ks, order, F.col(value).cast("double").alias("z"))
    key_types = dict(z.dtypes)
    key_schema = [f"`{c}` {key_types[c]}" for c in ks]
    # d per series: difference while the ADF test does not reject a unit root
    z = z.withColumn("_d", F.lit(0))
    for _ in range(max_d):
        t = adf_by_key(z, "z", order, ks, maxlag=adf_maxlag)  # all rows of a series share its d
        # one small row per series; written out so the next plan starts from a leaf
        more = materialize(t.where(F.col("pvalue") >= alpha).select(*ks, F.lit(True).alias("_more")))
        z = z.join(more, ks, "left")
        z = z.withColumn("_d", F.when(F.col("_more"), F.col("_d") + 1).otherwise(F.col("_d")))
        z = materialize(_differenced(z, "z", order, ks, F.col("_more")).drop("_more"))
    z = materialize(_lag_block(z.withColumn("_one", F.lit(1.0)), "z", order, long_ar, "_z", ks))
    c1 = ["_one"] + [f"_z{k}" for k in range(1, long_ar + 1)] + ["z"]
    k1 = len(c1)

    def long_fit(batches):
        for pdf in batches:
            out = []
            for _, r_ in pdf.iterrows():
                G, _n = gram_from_row({"_n": r_["_n"], "_xp": _Vec(r_["_xp"])}, k1)
                try:
                    b, _, _ = ols_from_gram(G, list(range(k1 - 1)), k1 - 1)
                except np.linalg.LinAlgError:
                    b = np.zeros(k1 - 1)
                out.append([r_[c] for c in ks] + [[float(v) for v in b]])
            yield pd.DataFrame(out, columns=ks + ["_b"])

    g1 = cross_products(z.where(F.col("_rn") > long_ar), c1, keys=ks)
    coef = g1.select(*ks, "_n", vector_to_array("_xp").alias("_xp")).mapInPandas(
        long_fit, ", ".join(key_schema + ["_b array<double>"]))
    fit = F.col("_b")[0]
    for j in range(1, long_ar + 1):
        fit = fit + F.col("_b")[j] * F.col(f"_z{j}")
    z2 = z.join(coef, ks).withColumn("_e", F.when(F.col("_rn") > long_ar, F.col("z") - fit)).drop("_rn", "_b")
    z2 = _lag_block(z2, "_e", order, max_q, "_e", ks)
    start = long_ar + max(max_p, max_q)
    c2 = ["_one"] + [f"_z{k}" for k in range(1, max_p + 1)] + [f"_e{k}" for k in range(1, max_q + 1)] + ["z"]
    k2 = len(c2)

    def score(batches):
        for pdf in batches:
            out = []
            for _, r_ in pdf.iterrows():
                G, n = gram_from_row({"_n": r_["_n"], "_xp": _Vec(r_["_xp"])}, k2)
                cand = []
                for p in range(max_p + 1):
                    for q in range(max_q + 1):
                        xi = [0] + list(range(1, p + 1)) + list(range(1 + max_p, 1 + max_p + q))
                        try:
                            _, ssr, _ = ols_from_gram(G, xi, k2 - 1)
                            aic = n * math.log(ssr / n) + 2 * (p + q + 1) if ssr > 0 and n else float("-inf")
                        except np.linalg.LinAlgError:
                            aic = float("nan")
                        cand.append([p, q, aic])
                ok = [c_ for c_ in cand if c_[2] == c_[2]]
                best = min(ok, key=lambda c_: (c_[2], c_[0] + c_[1])) if ok else None
                for p, q, aic in cand:
                    out.append([r_[c] for c in ks] + [p, int(r_["_d"]), q, aic, n, [p, q] == best[:2] if best else False])
            yield pd.DataFrame(out, columns=ks + ["p", "d", "q", "aic", "nobs", "chosen"])

    g2 = cross_products(z2.where(F.col("_rn") > start), c2, keys=ks + ["_d"])
    schema = ", ".join(key_schema + ["p int", "d int", "q int", "aic double", "nobs long", "chosen boolean"])
    return g2.select(*ks, "_d", "_n", vector_to_array("_xp").alias("_xp")).mapInPandas(score, schema)
