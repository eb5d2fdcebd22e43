"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is met by whole copies of all its documents plus a subset
whose sizes sum to the rest: documents are counted by exact token length, most
of the rest is taken proportionally from every length, a bounded-knapsack
dynamic program over the lengths fits what then remains, and the planned
number of documents of each length is chosen by a seeded hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loupe.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
DP_WIDTH = 1 << 17  # the dynamic program fits at most this many words


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """``(source, source_size)`` -> ``(skey, source, source_size, weight, target)``.

    Sources in code-point order (null last) get ``weights`` in turn and share
    ``share`` x all words; a target stops at ``limit`` x its source and the
    excess is shared again by weight until none is above.  The level is found
    by a loop of one-row aggregates (every round stops at least one source)."""
    spark = totals.sparkSession
    ranked = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(
        lambda x: (int(x[1]), x[0]["source"], int(x[0]["source_size"])))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("skey") % len(weights) + 1).cast("int"))
    s = written(spark.createDataFrame(ranked, "skey long, source string, source_size long").withColumn("weight", w), "sources")
    cap = F.col("source_size") * F.lit(float(limit))
    total = float(s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        n, held, free = s.agg(F.sum(full.cast("long")), F.sum(F.when(full, cap).otherwise(0.0)),
                              F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - held) / free
    return s.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0)))


def fit_lengths(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size to take so that the sizes sum to
    ``budget``, or as near below it as the sizes allow.

    A proportional part of every size first, then a largest-first fill down to
    DP_WIDTH, then an exact bounded knapsack for the rest: the reachable sums
    are the bits of one integer per step (counts in binary parts)."""
    whole = sum(s * c for s, c in zip(sizes, counts))
    if not whole or budget <= 0:
        return [0] * len(sizes)
    if budget >= whole:
        return list(counts)
    take = [c * budget // whole for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, take))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        if rest <= DP_WIDTH:
            break
        n = min(counts[i] - take[i], (rest - DP_WIDTH) // sizes[i] + 1, rest // sizes[i])
        take[i] += n
        rest -= n * sizes[i]
    rest_dp, mask = min(rest, DP_WIDTH), (1 << (min(rest, DP_WIDTH) + 1)) - 1
    reach, steps = 1, []
    for i in reversed(order):  # small sizes first: they reach most sums
        left, part = min(counts[i] - take[i], rest_dp // sizes[i]), 1
        while left > 0:
            n = min(part, left)
            nxt = (reach | reach << (n * sizes[i])) & mask
            if nxt != reach:
                steps.append((i, n, reach))
                reach = nxt
            left, part = left - n, part * 2
        if reach >> rest_dp & 1:
            break
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * sizes[i]
    return take


def _plan(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("size")
        size, budget = int(p["source_size"].iloc[0]), round(float(p["target"].iloc[0]))
        copies = budget // size if size else 0
        sizes, counts = [int(x) for x in p["size"]], [int(x) for x in p["n"]]
        extra = fit_lengths(sizes, counts, budget - copies * size)
        return pd.DataFrame({"skey": p["skey"], "size": p["size"], "copies": copies, "extra": extra})
    return one


def mix_to_weights(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
                   weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0,
                   seed: int = 7) -> DataFrame:
    """One row per document: ``doc_id, text_hash, size, source, source_size,
    target, copies, taken`` (``taken = copies * size``).

    Null or empty text: size 0, never taken.  A null source is a source of its
    own, after the others.  Repeated rows are separate documents.  An empty
    table gives an empty result.  Other columns are not read.

    Only ``(id, source, size)`` is kept after the scan.  The per-source
    program sees one row per distinct length.  Documents of one length are
    chosen by counting 4096 ranges of the seeded hash; only the range on the
    boundary is ranked, so a length shared by a third of all rows is never
    sorted in one task."""
    narrow = written(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"),
                                 word_count(F.col(text_col)).alias("size")), "sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, limit)
    rows = narrow.join(targets.select("skey", F.col("source").alias("_s"), "source_size", "target"),
                       F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash")).withColumn("cell", F.shiftrightunsigned("h", 52).cast("int"))
    rows = written(rows, "mixrows")
    cells = rows.where("size > 0").groupBy("skey", "source_size", "target", "size", "cell").agg(F.count("*").alias("n"))
    lengths = cells.groupBy("skey", "source_size", "target", "size").agg(F.sum("n").alias("n"))
    plan = written(lengths.groupBy("skey").applyInPandas(_plan(seed), "skey long, size long, copies int, extra long"), "mixplan")
    upto = W.partitionBy("skey", "size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = (cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
             .join(plan, ["skey", "size"])
             .select("skey", "size", "cell", "copies", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("more"), "n"))
    joined = rows.join(cells, ["skey", "size", "cell"], "left")
    whole = joined.where("coalesce(more, 0) = 0 or more = n").withColumn("plus", F.when(F.col("more") > 0, 1).otherwise(0))
    rank = F.row_number().over(W.partitionBy("skey", "size", "cell").orderBy("h", "doc_id", "text_hash"))
    edge = joined.where("more > 0 and more < n").withColumn("plus", F.when(rank <= F.col("more"), 1).otherwise(0))
    return whole.unionByName(edge).select(
        "doc_id", "text_hash", "size", "source", "source_size", "target",
        (F.coalesce("copies", F.lit(0)) + F.col("plus")).cast("int").alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size"))


def repeat_documents(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it,
    with its columns and ``copy`` (1, 2, ...).  Rows equal in id and text are
    one another's copies; those that the mix leaves out are gone."""
    picked = mix.groupBy("doc_id", "text_hash").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0").alias("p")
    d = docs.withColumn("_hash", F.xxhash64(text_col)).dropDuplicates([id_col, "_hash"]).alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("p.doc_id")) & (F.col("d._hash") == F.col("p.text_hash"))
    return d.join(picked, same).select(*[f"d.`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1), "p.copies")).alias("copy"))
