"""Cleaning, imputation and recoding (CLN*).

Statistics used for filling (means, modes, medians) are computed by one
aggregate over the data and attached as a single broadcast row, so the fill
itself is a narrow, shuffle-free projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.operators.aggregate import numeric_columns
from loupe.operators.scalars import with_scalars


def fill_const(df: DataFrame, value, subset: Sequence[str] | None = None) -> DataFrame:
    """``fillna(value)`` on the columns whose type accepts ``value``."""
    return df.fillna(value, subset=list(subset) if subset else None)


def fill_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill each numeric column's nulls with that column's mean (one pass)."""
    cols = list(cols) if cols else numeric_columns(df)
    means = df.agg(*[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(cols)])
    j = with_scalars(df, means)
    out = []
    for c in df.columns:
        if c in cols:
            # as in pandas, a numeric column holding nulls is filled as double
            i = cols.index(c)
            out.append(F.coalesce(F.col(c).cast("double"), F.col(f"_m_{i}")).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


_NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column, ties -> smallest value in the
    column's own order (numbers numerically, text lexically).

    Long form: unpivot to (column, value, numeric sort key) -> count per pair
    (partial aggregation before the shuffle) -> best per column.  Output
    (column, mode, freq) with ``mode`` as string."""
    types = dict(df.dtypes)
    x = df.select(*[F.struct(F.col(f"`{c}`").cast("string").alias("v"),
                             (F.col(f"`{c}`").cast("double") if types[c] in _NUMERIC or types[c].startswith("decimal")
                              else F.lit(None).cast("double")).alias("k")).alias(c) for c in cols])
    long = x.unpivot([], list(cols), "column", "_s").select("column", F.col("_s.v").alias("value"),
                                                            F.col("_s.k").alias("_num"))
    cnt = long.where(F.col("value").isNotNull()).groupBy("column", "value", "_num").agg(
        F.count(F.lit(1)).alias("freq"))
    w = Window.partitionBy("column").orderBy(F.col("freq").desc(), F.col("_num").asc_nulls_last(), F.col("value"))
    return (cnt.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("column", F.col("value").alias("mode"), "freq"))


def mode_of(df: DataFrame, col: str) -> DataFrame:
    """One-row frame holding the mode of ``col`` (ties -> smallest value)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.col("_n").desc(), F.col(col)).limit(1).select(F.col(col).alias("_mode")))


def fill_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls of each column with its mode (``modes``: one aggregate for
    all columns); a column without values stays as it is."""
    types = dict(df.dtypes)
    found = {r["column"]: r["mode"] for r in modes(df, list(cols)).collect()}  # one row a column
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(found[c]).cast(types[c])).alias(c) if c in found else F.col(f"`{c}`") for c in df.columns])


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def dedup(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def recode(col: Column | str, mapping: Mapping, default: Column | None = None) -> Column:
    """Map values through a small literal dict; unmapped values pass
    through (or take ``default``).  Many-to-one maps are fine."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c if default is None else default)


def recode_by_table(df: DataFrame, col: str, mapping_df: DataFrame,
                    from_col: str = "from", to_col: str = "to") -> DataFrame:
    """Large maps as a table: left join + coalesce (AQE broadcasts it if small)."""
    m = mapping_df.select(F.col(from_col).alias("_from"), F.col(to_col).alias("_to"))
    return (df.join(m, df[col] == m["_from"], "left")
            .withColumn(col, F.coalesce(F.col("_to"), F.col(col))).drop("_from", "_to"))


def money_to_double(col: Column | str) -> Column:
    """``$1,234.50`` -> 1234.5; blanks and unparsable text -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    stripped = F.regexp_replace(c, r"[,$]", "")
    return F.nullif(F.trim(stripped), F.lit("")).try_cast("double")


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std, statistics from one aggregate."""
    stats = df.agg(*[x for i, c in enumerate(cols)
                     for x in (F.avg(c).alias(f"_mu{i}"), F.stddev_pop(c).alias(f"_sd{i}"))])
    j = with_scalars(df, stats)
    z = {c + suffix: F.try_divide(F.col(c) - F.col(f"_mu{i}"), F.col(f"_sd{i}"))
         for i, c in enumerate(cols)}
    if suffix:
        return j.withColumns(z).drop(*[x for i in range(len(cols)) for x in (f"_mu{i}", f"_sd{i}")])
    return j.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])


def impute_mode_all(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SimpleImputer('most_frequent') for many columns: modes for all columns
    come from ONE long-form aggregate, then a single broadcast row fills."""
    m = modes(df, cols).groupBy().pivot("column", list(cols)).agg(F.first("mode"))
    m = m.select(*[F.col(c).alias(f"_mode_{c}") for c in cols])
    types = dict(df.dtypes)
    j = with_scalars(df, m)
    return j.select(*[F.coalesce(F.col(c), F.col(f"_mode_{c}").cast(types[c])).alias(c)
                      if c in cols else F.col(c) for c in df.columns])
