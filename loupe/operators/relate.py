"""Joins and set operations (JOI*, SET*).

Dimension tables are joined with a broadcast hint only where their size is
bounded by construction (a fixed code list, a top-k result); everything else
is left to Catalyst/AQE, which broadcasts only below
``spark.sql.autoBroadcastJoinThreshold`` after measuring the side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame) -> DataFrame:
    """Mark a side whose row count has a proven bound (top-k, code list,
    fixed-size dimension) as broadcastable."""
    return F.broadcast(df)


def join_on(left: DataFrame, right: DataFrame, on, how: str = "inner",
            null_safe: bool = False) -> DataFrame:
    """Equi-join on one or more same-named keys (SQL null semantics unless
    ``null_safe``, which matches null to null as pandas ``merge`` does)."""
    keys = [on] if isinstance(on, str) else list(on)
    if not null_safe:
        return left.join(right, keys, how)
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*[right[k] for k in keys])


def left_join_skew_safe(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """``left LEFT JOIN right`` written as (inner join) UNION ALL (left rows
    without a match, from an anti join).

    Adaptive execution can split a skewed partition of either side of an
    inner join, but only the preserved side of an outer join; when the hot
    key lives in ``right`` (facts under a dimension) this form keeps one key
    holding a third of the rows from landing in a single task.  The result
    equals the plain left join."""
    keys = [on] if isinstance(on, str) else list(on)
    matched = left.join(right, keys, "inner")
    unmatched = left.join(right.select(*keys).distinct(), keys, "left_anti")
    extra = [c for c in matched.columns if c not in unmatched.columns]
    types = dict(right.dtypes)
    unmatched = unmatched.select(*unmatched.columns, *[F.lit(None).cast(types[c]).alias(c) for c in extra])
    return matched.unionByName(unmatched)


def join_named(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
               how: str = "inner") -> DataFrame:
    """Join on differently named keys and keep both key columns."""
    return left.join(right, left[left_on] == right[right_on], how)


def semi_join_top_k(facts: DataFrame, key: str, k: int,
                    measure: Column | None = None) -> DataFrame:
    """Keep fact rows whose ``key`` is among the k largest groups.

    The top-k list has at most k rows, so it is broadcast; the semi join then
    runs map-side without shuffling the facts.
    """
    m = measure if measure is not None else F.count(F.lit(1))
    top = (facts.where(F.col(key).isNotNull()).groupBy(key).agg(m.alias("_m"))
           .orderBy(F.col("_m").desc(), F.col(key)).limit(k).select(key))
    return facts.join(bounded(top), key, "left_semi")


def align_arith(a: DataFrame, b: DataFrame, key: str, a_col: str, b_col: str,
                op: str = "+", out: str = "value") -> DataFrame:
    """Label-aligned arithmetic: full outer join on ``key``; null where one
    side is missing (pandas ``frame.add(series, axis=0)``)."""
    j = a.select(key, F.col(a_col).alias("_a")).join(
        b.select(key, F.col(b_col).alias("_b")), key, "full")
    expr = {"+": F.col("_a") + F.col("_b"), "-": F.col("_a") - F.col("_b"),
            "*": F.col("_a") * F.col("_b"),
            "/": F.try_divide(F.col("_a"), F.col("_b"))}[op]
    return j.select(key, "_a", "_b", expr.alias(out))


def conditional_counts_by_dim(dim: DataFrame, facts: DataFrame, key: str,
                              conditions: dict[str, Column]) -> DataFrame:
    """Per dimension key, count fact rows meeting each condition; keys
    without facts get 0.  The facts are aggregated per key first (partial
    aggregation absorbs a hot key), then the small per-key result is joined
    to the dimension keys."""
    aggs = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]
    per_key = facts.groupBy(key).agg(*aggs)
    j = dim.select(key).distinct().join(per_key, key, "left")
    return j.select(key, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in conditions])


def union_tagged(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Stack tables by column name with a source label (missing columns null)."""
    out = None
    for name, df in parts.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_members(df: DataFrame, list_col: Column, out: str = "member") -> DataFrame:
    """Flatten a list column and keep each member once."""
    return df.select(F.explode(list_col).alias(out)).where(F.col(out).isNotNull()).distinct()


def select_labels(df: DataFrame, key: str, labels: Sequence) -> DataFrame:
    """Pick rows whose ``key`` is in ``labels`` and carry the list position
    so callers can order by it (``.loc[[labels]]``)."""
    spark = df.sparkSession
    lab = spark.createDataFrame([(v, i) for i, v in enumerate(labels)], [key, "label_pos"])
    return df.join(bounded(lab), key, "inner")


def fill_template(template: DataFrame, template_order, values: DataFrame, values_order, columns: dict[str, str]) -> DataFrame:
    """``template`` with each column of ``columns`` replaced by a column of
    ``values``: the i-th row of one in its order takes the i-th of the other in
    its own (distributed ranks, then a join).  Rows beyond ``values`` are
    empty; values beyond the template are left out."""
    from loupe.operators.series import ranked
    b = ranked(values, values_order, out="_at").select("_at", *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns.values())])
    a = ranked(template, template_order, out="_at").drop("_part")
    j = a.join(b, "_at", "left")
    into = {c: F.col(f"_v{i}") for i, c in enumerate(columns)}
    return j.select(*[into[c].alias(c) if c in into else F.col(f"`{c}`") for c in template.columns])
