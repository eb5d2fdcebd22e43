"""Quality score: random Fourier features of document statistics (a Gaussian
kernel's approximation), ridge weights from partition-summed normal equations,
and isotonic calibration on rows the fit has not seen."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import crc_fold, written

LETTERS = re.compile(r"[^\W\d_]+")
STATS = 18


def statistics(text: str | None) -> list[float]:
    """Shape of a text: lengths, character classes, repetition.  Empty: zeros."""
    t = text or ""
    n = max(len(t), 1)
    words = t.split()
    k = max(len(words), 1)
    lines = [x for x in t.split("\n") if x.strip()]
    letters = sum(map(len, LETTERS.findall(t)))
    upper, digits = sum(map(str.isupper, t)), sum(map(str.isdigit, t))
    spaces = sum(map(str.isspace, t))
    other = n - letters - digits - spaces if t else 0
    plain = sum(t.count(c) for c in ".,;:'\"-()")
    distinct = len(set(words))
    tri = list(zip(words, words[1:], words[2:]))
    ends = sum(1 for x in words if x[-1] in ".!?")
    longest = max(map(len, words), default=0)
    single = sum(1 for x in words if len(x) == 1)
    return [np.log1p(len(t)), np.log1p(len(words)), letters / n, upper / n, digits / n, spaces / n, other / n, plain / n,
            (other - plain) / n, sum(map(len, words)) / k, distinct / k, 1 - len(set(tri)) / max(len(tri), 1),
            1 - len(set(lines)) / max(len(lines), 1), len(lines) / k, ends / k, np.log1p(longest), single / k,
            t.count("!") / k]


def _stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "no_id": b["no_id"], "text_hash": b["text_hash"], "x": [statistics(t) for t in b["text"]]})


class Features:
    """Standardised statistics -> sqrt(2/D) cos(x W + u), and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, dim: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), dim))
        self.u = rng.uniform(0, 2 * np.pi, dim)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6) @ self.w + self.u
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.u)), np.ones((len(x), 1))])


def _normal(f: Features):
    """Per partition one row per feature: its row of Z'Z and of Z'y."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = None
        for b in batches:
            if len(b):
                z = f(np.stack(b["x"].to_numpy()))
                part = z.T @ np.hstack([z, b[["y"]].to_numpy(dtype=float)])
                g = part if g is None else g + part
        if g is not None:
            yield pd.DataFrame({"i": range(len(g)), "v": list(g)})
    return run


def _raw(f: Features, beta: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = f(np.stack(b["x"].to_numpy())) @ beta if len(b) else []
            yield b.drop(columns="x").assign(raw=raw)
    return run


def isotonic(x: list[float], y: list[float], n: list[float]) -> list[float]:
    """Pool adjacent violators: the non-decreasing fit of means ``y`` with
    weights ``n`` in the order of ``x``."""
    blocks: list[list[float]] = []
    for yi, ni in zip(y, n):
        blocks.append([yi, ni, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [b[0] for b in blocks for _ in range(int(b[2]))]


def _calibrated(x: np.ndarray, y: np.ndarray):
    """Step fit made continuous; a thousandth of the raw order breaks ties."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = b["raw"].to_numpy(dtype=float)
            s = np.interp(r, x, y) if len(x) else np.clip(r, 0, 1)
            yield b.drop(columns="raw").assign(score=0.999 * s + 0.001 / (1 + np.exp(-r)))
    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  dim: int = 192, width: float = 4.0, ridge: float = 1e-3, cells: int = 400, seed: int = 11) -> DataFrame:
    """One row per document: ``doc_id, text_hash, held_out, score,
    predicted``.

    Folds by crc32(id) mod 5: 0 is never learned from, 1 calibrates, the rest
    fit; all labelled rows of these folds are used.  Null text counts as
    empty, with all statistics 0.  Several labels of one id: the largest
    counts; rows that share an id are scored apart; a null id is not held
    out.  Without labels every score is near 0.5.  Other columns are not
    read.  Only (D+1)^2 sums and ``cells`` calibration counts reach the
    driver."""
    # a null id goes through pandas as a mark: beside nulls whole numbers would become doubles
    d = docs.select(F.coalesce(F.col(id_col), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"),
                    F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    x = written(d.mapInPandas(_stats, "doc_id long, no_id boolean, text_hash long, x array<double>"), "stats")
    y = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("y"))
    fold = crc_fold(F.col("doc_id"), 5)
    known = written(x.where("not no_id").join(y.where(fold != 0), "doc_id").select("doc_id", "x", "y"), "known")
    fit = known.where(fold >= 2)
    m = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("j").collect()
    if m:
        f = Features(np.array([r["m"] for r in m]), np.array([r["s"] for r in m]), dim, width, seed)
        sums = fit.select("x", "y").mapInPandas(_normal(f), "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
        g = np.zeros((dim + 1, dim + 2))
        for r in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            g[r["i"], r["j"]] = r["v"]
        n = g[-1, -2]
        beta = np.linalg.solve(g[:, :-1] + ridge * n * np.diag([1.0] * dim + [0.0]) + 1e-9 * np.eye(dim + 1), g[:, -1])
    else:
        f, beta = Features(np.zeros(STATS), np.ones(STATS), dim, width, seed), np.append(np.zeros(dim), 0.5)
    cal = known.where(fold == 1).mapInPandas(_raw(f, beta), "doc_id long, y double, raw double")
    cell = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) * (cells / 2))
    pts = cal.groupBy(cell.alias("c")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("c").collect()
    px = [r["x"] for r in pts]
    py = isotonic(px, [r["y"] for r in pts], [r["n"] for r in pts])
    raw = x.mapInPandas(_raw(f, beta), "doc_id long, no_id boolean, text_hash long, raw double")
    out = raw.mapInPandas(_calibrated(np.array(px), np.array(py)), "doc_id long, no_id boolean, text_hash long, score double")
    out = out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id")))
    return out.select("doc_id", "text_hash", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))
