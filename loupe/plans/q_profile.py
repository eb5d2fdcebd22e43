"""Profiling queries (PRF*, CMP18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators import profile as P
from loupe.operators.selection import quantiles_by
from loupe.plans.common import inject_nulls, r
from loupe.plans.registry import query
from loupe.session import stored
from loupe.sources.tables import TABLES, Tables

# Null rule for the profiling queries: priority blank when key % 7 = 0,
# total price blank when key % 11 = 0 (both stated in the oracle SQL).


def orders_with_nulls(t: Tables):
    o = inject_nulls(t.orders, "o_orderpriority", "o_orderkey", 7)
    return inject_nulls(o, "o_totalprice", "o_orderkey", 11)


_ORDERS_NULLS_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)"""


@query("table_info", oracle="""
SELECT 'c_custkey' AS "column", 'bigint' AS dtype, count(c_custkey) AS non_null, count(*) AS rows FROM customer
UNION ALL SELECT 'c_name', 'string', count(c_name), count(*) FROM customer
UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey), count(*) FROM customer
UNION ALL SELECT 'c_acctbal', 'double', count(c_acctbal), count(*) FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment), count(*) FROM customer""")
def table_info(spark, d):
    """Type, filled and total rows of every column."""
    return P.info(Tables(spark, d).customer)


@query("table_shape", oracle="\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, (SELECT count(*) FROM information_schema.columns "
    f"WHERE table_name = '{t}')::INTEGER AS columns FROM {t}" for t in TABLES))
def table_shape(spark, d):
    """Rows and columns of every table."""
    t = Tables(spark, d)
    out = None
    for name in TABLES:
        s = P.shape(getattr(t, name), name)
        out = s if out is None else out.unionByName(s)
    return out


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table, cols, digits=6):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS count, round(avg({x}), {digits}) AS mean, "
            f"round(stddev_samp({x}), {digits}) AS std, min({x}) AS min, "
            f"round(quantile_cont({x}, 0.25), {digits}) AS p25, round(quantile_cont({x}, 0.5), {digits}) AS p50, "
            f"round(quantile_cont({x}, 0.75), {digits}) AS p75, max({x}) AS max FROM {table}")
    return "\nUNION ALL\n".join(parts)


def _round_stats(df, digits=6):
    return df.select(*[r(c, digits).alias(c) if c in ("mean", "std", "p25", "p50", "p75") else F.col(c)
                       for c in df.columns])


@query("describe_numeric", oracle=_describe_sql("lineitem", _LI_NUM))
def describe_numeric(spark, d):
    """Moments, range and quartiles of the numeric columns."""
    return _round_stats(P.describe_numeric(Tables(spark, d).lineitem))


@query("describe_all", oracle="""
WITH s AS (
  SELECT 'p_partkey' AS "column", count(p_partkey) AS count, NULL::BIGINT AS "unique",
         round(avg(p_partkey), 6) AS mean, round(stddev_samp(p_partkey), 6) AS std, min(p_partkey)::DOUBLE AS min,
         round(quantile_cont(p_partkey, 0.25), 6) AS p25, round(quantile_cont(p_partkey, 0.5), 6) AS p50,
         round(quantile_cont(p_partkey, 0.75), 6) AS p75, max(p_partkey)::DOUBLE AS max FROM part
  UNION ALL SELECT 'p_size', count(p_size), NULL, round(avg(p_size), 6), round(stddev_samp(p_size), 6), min(p_size),
         round(quantile_cont(p_size, 0.25), 6), round(quantile_cont(p_size, 0.5), 6),
         round(quantile_cont(p_size, 0.75), 6), max(p_size) FROM part
  UNION ALL SELECT 'p_retailprice', count(p_retailprice), NULL, round(avg(p_retailprice), 6),
         round(stddev_samp(p_retailprice), 6), min(p_retailprice), round(quantile_cont(p_retailprice, 0.25), 6),
         round(quantile_cont(p_retailprice, 0.5), 6), round(quantile_cont(p_retailprice, 0.75), 6),
         max(p_retailprice) FROM part
  UNION ALL SELECT 'p_name', count(p_name), count(DISTINCT p_name), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'p_brand', count(p_brand), count(DISTINCT p_brand), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'p_type', count(p_type), count(DISTINCT p_type), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part),
long AS (
  SELECT 'p_name' AS "column", p_name AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part
  UNION ALL SELECT 'p_type', p_type FROM part),
top AS (
  SELECT "column", v AS top, n AS freq FROM (
    SELECT "column", v, count(*) AS n,
           row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, v) AS rn
    FROM long GROUP BY "column", v) WHERE rn = 1)
SELECT s.*, top.top, top.freq FROM s LEFT JOIN top USING ("column")""")
def describe_all(spark, d):
    """The same, with distinct values and the most frequent one of text columns."""
    return _round_stats(P.describe_all(Tables(spark, d).part))


@query("describe_wide", oracle="""
WITH long AS (
  SELECT 'f' || CAST(i - 1 AS VARCHAR) AS feature, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, 65) AS t(i))
SELECT feature, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
       round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max
FROM long GROUP BY feature""")
def describe_wide(spark, d):
    """Statistics of a positional column range of a wide table (f0..f63 of the
    embedding)."""
    e = Tables(spark, d).embeddings
    wide = e.select(*[F.get("embedding", F.lit(i)).alias(f"f{i}") for i in range(64)])
    return _round_stats(P.describe_numeric(wide).withColumnRenamed("column", "feature"))


@query("describe_groups", oracle="""
SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
       round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1, 2""")
def describe_groups(spark, d):
    """Exact quantiles of the price in each group of two columns."""
    q = quantiles_by(Tables(spark, d).lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.1, 0.5, 0.99], ["p10", "p50", "p99"])
    return q.select("l_returnflag", "l_linestatus", *[r(c).alias(c) for c in ("p10", "p50", "p99")])


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("null_counts", oracle="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows FROM {_ORDERS_NULLS_SQL}"
    for c in _ORDER_COLS))
def null_counts(spark, d):
    """Missing values in each column."""
    return P.null_counts(orders_with_nulls(Tables(spark, d)))


@query("null_total", oracle=f"""
SELECT count(*) FILTER (WHERE o_totalprice IS NULL) + count(*) FILTER (WHERE o_orderpriority IS NULL) AS total_nulls
FROM {_ORDERS_NULLS_SQL}""")
def null_total(spark, d):
    """Missing values in the whole table."""
    return P.null_counts(orders_with_nulls(Tables(spark, d))).agg(F.sum("nulls").alias("total_nulls"))


@query("null_rate", oracle=f"""
SELECT * FROM (
  SELECT 'o_totalprice' AS "column", round_even(100.0 * count(*) FILTER (WHERE o_totalprice IS NULL) / count(*), 2) AS pct
  FROM {_ORDERS_NULLS_SQL}
  UNION ALL
  SELECT 'o_orderpriority', round_even(100.0 * count(*) FILTER (WHERE o_orderpriority IS NULL) / count(*), 2)
  FROM {_ORDERS_NULLS_SQL}) WHERE pct > 0""")
def null_rate(spark, d):
    """Per cent of missing values, of the columns that have any."""
    n = P.null_counts(orders_with_nulls(Tables(spark, d)))
    return (n.select("column", F.bround(100.0 * F.col("nulls") / F.col("rows"), 2).alias("pct"))
            .where(F.col("pct") > 0))


@query("null_fraction", oracle="\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS null_fraction "
    f"FROM {_ORDERS_NULLS_SQL}" for c in _ORDER_COLS if c not in ("o_orderkey", "o_orderstatus")))
def null_fraction(spark, d):
    """Null fraction per feature, id (o_orderkey) and target (o_orderstatus) excluded."""
    o = orders_with_nulls(Tables(spark, d))
    feats = [c for c in o.columns if c not in ("o_orderkey", "o_orderstatus")]
    n = P.null_counts(o, feats)
    return n.select(F.col("column").alias("feature"), r(F.col("nulls") / F.col("rows")).alias("null_fraction"))


@query("null_per_row_hist", oracle=f"""
WITH k AS (SELECT (o_totalprice IS NULL)::INTEGER + (o_orderpriority IS NULL)::INTEGER AS k FROM {_ORDERS_NULLS_SQL})
SELECT k, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY k""")
def null_per_row_hist(spark, d):
    """How many rows have how many missing fields."""
    o = orders_with_nulls(Tables(spark, d))
    feats = [c for c in o.columns if c not in ("o_orderkey", "o_orderstatus")]
    h = P.null_per_row_hist(o, feats)
    return h.select("k", "n", r("share").alias("share"))


@query("missing_report", oracle=f"""
WITH o AS {_ORDERS_NULLS_SQL}
SELECT 'null_count' AS metric, 'o_totalprice' AS item, count(*) FILTER (WHERE o_totalprice IS NULL)::DOUBLE AS value FROM o
UNION ALL SELECT 'null_count', 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS NULL) FROM o
UNION ALL SELECT 'null_count', 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM o
UNION ALL SELECT 'null_count', 'o_orderdate', count(*) FILTER (WHERE o_orderdate IS NULL) FROM o
UNION ALL SELECT 'null_fraction', 'o_totalprice', round(count(*) FILTER (WHERE o_totalprice IS NULL) / count(*), 6) FROM o
UNION ALL SELECT 'null_fraction', 'o_orderpriority', round(count(*) FILTER (WHERE o_orderpriority IS NULL) / count(*), 6) FROM o
UNION ALL SELECT 'null_fraction', 'o_custkey', round(count(*) FILTER (WHERE o_custkey IS NULL) / count(*), 6) FROM o
UNION ALL SELECT 'null_fraction', 'o_orderdate', round(count(*) FILTER (WHERE o_orderdate IS NULL) / count(*), 6) FROM o
UNION ALL SELECT 'rows_with_k_nulls', CAST(k AS VARCHAR), round(count(*) / sum(count(*)) OVER (), 6) FROM (
  SELECT (o_totalprice IS NULL)::INTEGER + (o_orderpriority IS NULL)::INTEGER
         + (o_custkey IS NULL)::INTEGER + (o_orderdate IS NULL)::INTEGER AS k FROM o) GROUP BY k""")
def missing_report(spark, d):
    """Null counts, null fraction per feature, share of rows by number
    of missing features — long form (metric, item, value)."""
    o = orders_with_nulls(Tables(spark, d))
    feats = ["o_totalprice", "o_orderpriority", "o_custkey", "o_orderdate"]
    n = stored(P.null_counts(o, feats), "nulls")
    a = n.select(F.lit("null_count").alias("metric"), F.col("column").alias("item"),
                 F.col("nulls").cast("double").alias("value"))
    b = n.select(F.lit("null_fraction").alias("metric"), F.col("column").alias("item"),
                 r(F.col("nulls") / F.col("rows")).alias("value"))
    c = P.null_per_row_hist(o, feats).select(F.lit("rows_with_k_nulls").alias("metric"),
                                             F.col("k").cast("string").alias("item"), r("share").alias("value"))
    return a.unionByName(b).unionByName(c)


@query("columns_by_type", oracle="""
SELECT column_name AS "column",
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
            WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS dtype,
       CASE WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'numeric' ELSE 'categorical' END AS kind,
       (SELECT count(*) FROM lineitem) AS non_null
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def columns_by_type(spark, d):
    """Fractional columns apart from all others."""
    return P.columns_by_type(Tables(spark, d).lineitem)


@query("nunique_all", oracle="""
SELECT 'p_partkey' AS "column", count(DISTINCT p_partkey) AS nunique FROM part
UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part
UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice) FROM part""")
def nunique_all(spark, d):
    """Distinct values of each column."""
    return P.nunique(Tables(spark, d).part)


@query("low_card_values", oracle="""
WITH long AS (
  SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS VARCHAR) AS value FROM orders
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
  UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders
  UNION ALL SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
SELECT DISTINCT "column", value FROM long
WHERE "column" IN (SELECT "column" FROM long GROUP BY "column" HAVING count(DISTINCT value) < 50)""")
def low_card_values(spark, d):
    """The values of columns that have fewer than 50."""
    return P.low_cardinality_values(Tables(spark, d).orders, 50)


@query("distinct_values", oracle="SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, d):
    """The values of one column, in order."""
    return Tables(spark, d).orders.select("o_orderpriority").distinct().orderBy("o_orderpriority")


@query("scalar_max", oracle="SELECT max(o_totalprice) AS max_totalprice FROM orders")
def scalar_max(spark, d):
    """The largest value of a column."""
    return Tables(spark, d).orders.agg(F.max("o_totalprice").alias("max_totalprice"))
