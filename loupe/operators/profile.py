"""Profiling (PRF*): every report is ONE aggregate pass over the table
(all columns' statistics in a single ``agg``) reshaped to long form, or a
long-form (column, value) aggregation for per-column distributions.

Exact quantiles come from ``selection`` (histograms over the bits of the
values), at every size.  ``exact=False`` asks for the sketch versions
(``percentile_approx``, ``approx_count_distinct``) instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.operators.aggregate import numeric_columns
from loupe.operators.selection import describe_columns, quantiles_by
from loupe.session import stored

NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def _long(row_df: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Reshape a one-row frame with columns ``{field}__{i}`` into one row per
    input column: (column, field1, field2, ...)."""
    structs = [F.struct(F.lit(c).alias("column"),
                        *[F.col(f"{f}__{i}").alias(f) for f in fields])
               for i, c in enumerate(cols)]
    return row_df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def info(df: DataFrame) -> DataFrame:
    """``info()``: column, dtype, non-null count, row count (one pass)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"non_null__{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    structs = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                        F.col(f"non_null__{i}").alias("non_null"), F.col("_rows").alias("rows"))
               for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))


def _q(c: Column, exact: bool) -> Column:
    ps = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return F.percentile(c, ps) if exact else F.percentile_approx(c, ps, 10000)


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None,
                     exact: bool = True) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear interpolation),
    max per numeric column, long output.

    Moments and exact quantiles share the scans of ``describe_columns``, for
    any number of columns; ``exact=False`` uses ``percentile_approx`` sketches
    in one pass."""
    cols = list(cols) if cols else numeric_columns(df)
    if not exact:
        aggs = []
        for i, c in enumerate(cols):
            x = F.col(f"`{c}`").cast("double")
            aggs += [F.count(x).alias(f"count__{i}"), F.avg(x).alias(f"mean__{i}"),
                     F.stddev_samp(x).alias(f"std__{i}"), F.min(x).alias(f"min__{i}"),
                     _q(x, False).alias(f"_q__{i}"), F.max(x).alias(f"max__{i}")]
        row = df.agg(*aggs)
        row = row.select("*", *[F.col(f"_q__{i}")[k].alias(f"{n}__{i}")
                                for i in range(len(cols)) for k, n in enumerate(("p25", "p50", "p75"))])
        return _long(row, cols, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])
    return _described(df, cols)


def _described(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = [(o["column"], o["count"], o["mean"], o["std"], o["min"], *o["quantiles"], o["max"]) for o in describe_columns(df, cols)]
    return df.sparkSession.createDataFrame(rows, "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def describe_long(long_df: DataFrame, key: str, value: str, exact: bool = True) -> DataFrame:
    """describe() for data in long form (key, value), any number of keys: one
    grouped aggregate for the moments, exact quantiles by ``quantiles_by``."""
    x = F.col(value).cast("double")
    moments = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    if not exact:
        g = long_df.groupBy(key).agg(*moments, _q(x, False).alias("_q"))
        return g.select(key, "count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
                        F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")
    g = long_df.groupBy(key).agg(*moments)
    q = quantiles_by(long_df, [key], value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"]).withColumnRenamed(key, "_key")
    q = g.join(q, F.col(key).eqNullSafe(F.col("_key")), "left")
    return q.select(key, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def top_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: most frequent value (ties -> smallest) and its frequency."""
    from loupe.operators.clean import modes
    return modes(df, cols).withColumnRenamed("mode", "top")


def describe_all(df: DataFrame, exact: bool = True) -> DataFrame:
    """describe(include='all'): numeric stats for numeric columns, unique /
    top / freq for the others; one row per column."""
    num = numeric_columns(df)
    txt = [c for c in df.columns if c not in num]
    base = _long(df.agg(*[F.count(F.col(f"`{c}`")).alias(f"count__{i}") for i, c in enumerate(df.columns)]), df.columns, ["count"])
    unique = nunique(df, txt, exact).withColumnRenamed("nunique", "unique") if txt else None
    base = base.join(unique, "column", "left") if txt else base.withColumn("unique", F.lit(None).cast("long"))
    stats = describe_numeric(df, num, exact).drop("count") if num else None
    tops = top_values(df, txt) if txt else None
    out = base
    if stats is not None:
        out = out.join(stats, "column", "left")
    if tops is not None:
        out = out.join(tops, "column", "left")
    return out


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, rows) in one pass."""
    cols = list(cols) if cols else df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls__{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"nulls__{i}").alias("nulls"),
                        F.col("_rows").alias("rows")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def nulls_in_row(cols: Sequence[str]) -> Column:
    """Number of null fields in a row, as one expression."""
    e = F.lit(0)
    for c in cols:
        e = e + F.col(f"`{c}`").isNull().cast("int")
    return e


def null_per_row_hist(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of rows having k missing values among ``cols``."""
    k = df.select(nulls_in_row(cols).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    k = stored(k, "null-counts")  # at most one row a column
    from loupe.operators.scalars import with_scalars
    return with_scalars(k, k.agg(F.sum("n").alias("_t"))).select("k", "n", (F.col("n") / F.col("_t")).alias("share"))


def columns_by_type(df: DataFrame) -> DataFrame:
    """Split columns: floating point -> 'numeric', everything else ->
    'categorical' (integer columns land in 'categorical', as in the
    notebook's rule).  Built on ``info`` so the non-null counts come along."""
    kind = F.when(F.col("dtype").isin("double", "float"), "numeric").otherwise("categorical")
    return info(df).select("column", "dtype", kind.alias("kind"), "non_null")


HELD = 1 << 20  # values of one column that a task holds before it passes them on


def _as_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as text that is equal where the values are."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        x, kind = F.col(f"`{c}`"), kinds[c]
        if kind in ("double", "float"):
            return (x + F.lit(0).cast(kind)).cast("string")  # -0.0 is 0.0
        if kind == "binary":
            return F.hex(x)
        return F.to_json(F.struct(x)) if kind.startswith(("array", "map", "struct")) else x.cast("string")
    return df.select(*[text(c).alias(f"c{i}") for i, c in enumerate(cols)])


def _task_values(width: int, most: int | None):
    """A task's distinct values of each column (with ``most``: until it has
    that many, then only a mark that it has too many)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array | None] = [None] * width
        full = [False] * width

        def out(i: int) -> pa.RecordBatch:
            v = pa.nulls(1, pa.string()) if full[i] else held[i]
            return pa.RecordBatch.from_arrays([pa.array([i] * len(v), pa.int32()), v, pa.array([full[i]] * len(v))], ["c", "value", "many"])
        for b in batches:
            for i in range(width):
                if full[i]:
                    continue
                new = pc.unique(b.column(i))
                held[i] = new if held[i] is None else pc.unique(pa.concat_arrays([held[i], new]))
                if most is not None and len(held[i]) - held[i].null_count > most:
                    full[i], held[i] = True, None
                elif len(held[i]) > HELD:
                    yield out(i)
                    held[i] = None
        for i in range(width):
            if full[i] or held[i] is not None and len(held[i]):
                yield out(i)
    return run


def nunique(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-null values of each column.

    Exact: one scan in which each task keeps its own distinct values, so that
    repeats are gone before the shuffle and the table is not expanded by its
    columns.  Otherwise a HyperLogLog++ sketch with 2 % relative error."""
    cols = list(cols) if cols else df.columns
    if not exact:
        row = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(f"nunique__{i}") for i, c in enumerate(cols)])
        return _long(row, cols, ["nunique"])
    v = _as_text(df, cols).mapInArrow(_task_values(len(cols), None), "c int, value string, many boolean")
    n = v.where("value is not null").groupBy("c", "value").agg(F.lit(1)).groupBy("c").agg(F.count("*").alias("nunique"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "c int, column string")
    return F.broadcast(names).join(n, "c", "left").select("column", F.coalesce("nunique", F.lit(0)).alias("nunique"))


def low_cardinality_values(df: DataFrame, max_distinct: int = 50) -> DataFrame:
    """Distinct values, as text, of the columns with fewer than
    ``max_distinct`` of them (nulls are listed, not counted).

    One scan: a task stops with a column at ``max_distinct`` values, so at
    most that many a column and task are shuffled."""
    cols = df.columns
    v = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    v = stored(v.mapInArrow(_task_values(len(cols), max_distinct - 1), "c int, value string, many boolean").distinct(), "values")
    many = v.groupBy("c").agg(F.max("many").alias("many"), F.count("value").alias("n")).where(~F.col("many") & (F.col("n") < max_distinct))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "c int, column string")
    return v.join(F.broadcast(many.select("c").join(names, "c")), "c").select("column", "value")
