"""Projection, filters, joins, aggregation, sorting and set operations
(PRJ*, FIL*, JOI*, AGG*, SRT*, SET*, PRF1-2, WIN6, WIN10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators import aggregate as A
from loupe.operators import relate as R
from loupe.operators.scalars import with_scalars
from loupe.plans.common import day, inject_nulls, r
from loupe.plans.registry import query
from loupe.session import stored
from loupe.sources.tables import Tables


# ---------------------------------------------------------------- projection
@query("select_cols", oracle="SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def select_cols(spark, d):
    """Some columns of a table."""
    return Tables(spark, d).orders.select("o_orderkey", "o_totalprice", "o_orderdate")


@query("rename_cols", oracle="""
SELECT o_orderkey AS order_id, o_custkey, o_orderstatus, o_totalprice AS price,
       o_orderdate, o_orderpriority FROM orders""")
def rename_cols(spark, d):
    # A name that does not exist is ignored, as in pandas.
    """Columns under new names."""
    return Tables(spark, d).orders.withColumnsRenamed(
        {"o_orderkey": "order_id", "o_totalprice": "price", "no_such_column": "x"})


@query("rename_positional", oracle="SELECT r_regionkey AS region_id, r_name AS region_name FROM region")
def rename_positional(spark, d):
    """All columns renamed in order."""
    return Tables(spark, d).region.toDF("region_id", "region_name")


@query("drop_cols", oracle="""
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE c_mktsegment NOT IN ('HOUSEHOLD', 'BUILDING')""")
def drop_cols(spark, d):
    """A table without some columns."""
    c = Tables(spark, d).customer.drop("c_name")
    return c.where(~F.col("c_mktsegment").isin("HOUSEHOLD", "BUILDING"))


@query("const_col", oracle="""
SELECT n_nationkey, n_name, CAST(1 AS INTEGER) AS count, 'nation' AS label, 0.0::DOUBLE AS base FROM nation""")
def const_col(spark, d):
    """A column with one value for all rows."""
    n = Tables(spark, d).nation.select("n_nationkey", "n_name")
    return n.select(*n.columns, F.lit(1).alias("count"), F.lit("nation").alias("label"),
                    F.lit(0.0).alias("base"))


@query("col_arith", oracle="""
SELECT l_orderkey, l_linenumber,
       l_extendedprice * (1 - l_discount) AS revenue,
       -l_quantity AS neg_qty,
       l_extendedprice / 1000000.0 AS price_m,
       l_tax / NULLIF(l_discount, 0) AS tax_per_discount
FROM lineitem""")
def col_arith(spark, d):
    """New columns computed from others."""
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                     (-F.col("l_quantity")).alias("neg_qty"),
                     (F.col("l_extendedprice") / 1e6).alias("price_m"),
                     F.try_divide("l_tax", "l_discount").alias("tax_per_discount"))


@query("cast_cols", oracle="""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
       CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
FROM orders""")
def cast_cols(spark, d):
    """Columns changed to other types."""
    o = Tables(spark, d).orders
    # Casting double -> integer truncates toward zero (as numpy astype does).
    return o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                    F.col("o_custkey").cast("int").alias("o_custkey"),
                    F.col("o_totalprice").cast("long").alias("o_totalprice"),
                    day("o_orderdate").alias("o_orderdate"))


@query("reorder_cols", oracle="""
PIVOT (SELECT o_orderstatus, o_orderpriority FROM orders)
ON o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')
USING count(*) GROUP BY o_orderstatus""")
def reorder_cols(spark, d):
    """Pivot counts, then order the value columns by overall frequency: the
    list comes from the counts, one for each column of the result."""
    o = Tables(spark, d).orders
    p, freq = A.wide_counts(o, "o_orderstatus", "o_orderpriority", by_frequency=True)
    return p.select("o_orderstatus", *[F.col(f"`{v}`") for v in freq])


# ------------------------------------------------------------------- filters
@query("filter_eq", oracle="SELECT * FROM orders WHERE o_orderstatus = 'O'")
def filter_eq(spark, d):
    """Rows with one value in a column."""
    return Tables(spark, d).orders.where(F.col("o_orderstatus") == "O")


@query("filter_cmp", oracle="SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N'")
def filter_cmp(spark, d):
    """Rows above a bound and unlike a value."""
    li = Tables(spark, d).lineitem
    return li.where((F.col("l_quantity") > 45) & (F.col("l_returnflag") != "N"))


@query("filter_bool", oracle="""
SELECT * FROM orders
WHERE o_orderpriority = '1-URGENT' OR (o_orderstatus = 'F' AND o_totalprice > 300000)""")
def filter_bool(spark, d):
    # "a or b and c" binds as a or (b and c); written with explicit parentheses.
    """Rows that meet one condition, or two others together."""
    o = Tables(spark, d).orders
    return o.where((F.col("o_orderpriority") == "1-URGENT")
                   | ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)))


@query("filter_isin", oracle="SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_isin(spark, d):
    """Rows with one of several values."""
    return Tables(spark, d).customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))


@query("filter_date_range", oracle="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""")
def filter_date_range(spark, d):
    """Rows between two dates."""
    o = Tables(spark, d).orders
    return (o.select("o_orderkey", day("o_orderdate").alias("o_orderdate"), "o_totalprice")
            .where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("date"),
                                                F.lit("1996-12-31").cast("date"))))


@query("filter_notnull", oracle="""
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0""")
def filter_notnull(spark, d):
    """Rows in which a field is filled."""
    o = inject_nulls(Tables(spark, d).orders.select("o_orderkey", "o_orderpriority"),
                     "o_orderpriority", "o_orderkey")
    return o.where(F.col("o_orderpriority").isNotNull())


@query("slice_rows", oracle="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 1""")
def slice_rows(spark, d):
    """Rows at some places of an order."""
    o = Tables(spark, d).orders.select("o_orderkey", "o_totalprice")
    return A.slice_rows(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1, 31)


@query("select_labels", oracle="""
SELECT o_orderpriority, count(*) AS count, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0
       WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS INTEGER) AS label_pos
FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT', '3-MEDIUM') GROUP BY o_orderpriority""")
def select_labels(spark, d):
    """Counts of some chosen values."""
    vc = A.value_counts(Tables(spark, d).orders, "o_orderpriority", ordered=False)
    out = R.select_labels(vc, "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"])
    return out.select("o_orderpriority", "count", F.col("label_pos").cast("int")).orderBy("label_pos")


@query("head_n", oracle="SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def head_n(spark, d):
    """The first rows of an order."""
    return Tables(spark, d).orders.orderBy("o_orderkey").limit(5)


@query("tail_n", oracle="SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def tail_n(spark, d):
    """The last rows of an order."""
    return Tables(spark, d).orders.orderBy(F.col("o_orderkey").desc()).limit(5).orderBy("o_orderkey")


# --------------------------------------------------------------------- joins
@query("join_left", oracle="""
SELECT c.c_custkey, c.c_mktsegment, o.o_orderkey, o.o_totalprice
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey""")
def join_left(spark, d):
    """Each row of one table beside its matches, or none."""
    t = Tables(spark, d)
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    # customers (left, preserved) <- orders (right, may hold hot keys)
    return R.left_join_skew_safe(t.customer.select("c_custkey", "c_mktsegment"), o, "c_custkey")


@query("join_inner", oracle="""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey AS p_partkey, p.p_name, p.p_brand, l.l_quantity
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")
def join_inner(spark, d):
    """Matching rows of two tables."""
    t = Tables(spark, d)
    li = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return R.join_on(li, t.part.select("p_partkey", "p_name", "p_brand"), "p_partkey", "inner")


@query("join_left_named", oracle="""
SELECT n.n_nationkey, n.n_name, c.c_nationkey, c.c_custkey
FROM nation n LEFT JOIN customer c ON n.n_nationkey = c.c_nationkey""")
def join_left_named(spark, d):
    """Matches over differently named keys, unmatched rows kept."""
    t = Tables(spark, d)
    return R.join_named(t.nation.select("n_nationkey", "n_name"),
                        t.customer.select("c_nationkey", "c_custkey"),
                        "n_nationkey", "c_nationkey", "left")


@query("join_inner_named", oracle="""
SELECT o.o_orderkey, l.l_orderkey, l.l_linenumber, o.o_orderstatus, l.l_quantity
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def join_inner_named(spark, d):
    """Matches over differently named keys."""
    t = Tables(spark, d)
    return R.join_named(t.orders.select("o_orderkey", "o_orderstatus"),
                        t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"),
                        "o_orderkey", "l_orderkey", "inner")


@query("topk_semi_join", oracle="""
WITH top AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM top)""")
def topk_semi_join(spark, d):
    """Keep rows whose group is among the top-10 groups."""
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return R.semi_join_top_k(o, "o_custkey", 10)


@query("align_add", oracle="""
WITH a AS (SELECT c_nationkey AS nationkey, count(*) AS customers FROM customer GROUP BY 1),
     b AS (SELECT s_nationkey AS nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT coalesce(a.nationkey, b.nationkey) AS nationkey, a.customers AS _a, b.suppliers AS _b,
       a.customers + b.suppliers AS value
FROM a FULL OUTER JOIN b ON a.nationkey = b.nationkey""")
def align_add(spark, d):
    """Columns of one table plus another table's value of the same key."""
    t = Tables(spark, d)
    a = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return R.align_arith(a, b, "nationkey", "customers", "suppliers", "+")


@query("cond_count_by_dim", oracle="""
SELECT n.n_nationkey AS c_nationkey,
       CAST(count(*) FILTER (WHERE c.c_mktsegment = 'BUILDING') AS BIGINT) AS building,
       CAST(count(*) FILTER (WHERE c.c_acctbal > 5000) AS BIGINT) AS rich
FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
WHERE n.n_regionkey IN (0, 1, 2) GROUP BY n.n_nationkey""")
def cond_count_by_dim(spark, d):
    """Per key of a filtered dimension, conditional counts."""
    t = Tables(spark, d)
    dim = t.nation.where(F.col("n_regionkey").isin(0, 1, 2)).select(F.col("n_nationkey").alias("c_nationkey"))
    return R.conditional_counts_by_dim(
        dim, t.customer, "c_nationkey",
        {"building": F.col("c_mktsegment") == "BUILDING", "rich": F.col("c_acctbal") > 5000})


@query("gold_by_country", oracle="""
SELECT c.c_nationkey, count(*) AS gold FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderpriority = '1-URGENT' GROUP BY c.c_nationkey""")
def gold_by_country(spark, d):
    """Counts of one kind for a given list of keys."""
    t = Tables(spark, d)
    g = (t.orders.where(F.col("o_orderpriority") == "1-URGENT")
         .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")))  # pre-aggregate before the join
    j = R.join_named(g, t.customer.select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey")
    return j.groupBy("c_nationkey").agg(F.sum("k").alias("gold"))


# --------------------------------------------------------------- aggregation
@query("group_count", oracle="""
SELECT o_orderstatus, count(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END) AS count
FROM orders GROUP BY o_orderstatus""")
def group_count(spark, d):
    """Filled values in each group."""
    o = inject_nulls(Tables(spark, d).orders, "o_orderpriority", "o_orderkey")
    return A.group_count(o, "o_orderstatus", "o_orderpriority")


@query("group_size", oracle="""
SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_linenumber, count(*) AS size
FROM lineitem GROUP BY ALL""")
def group_size(spark, d):
    """Rows of each combination of four keys."""
    li = Tables(spark, d).lineitem.withColumn("ship_year", F.year("l_shipdate"))
    return A.group_size(li, ["l_returnflag", "l_linestatus", "ship_year", "l_linenumber"])


@query("group_sum", oracle="""
SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS l_partkey,
       CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber,
       round(sum(l_quantity), 4) AS l_quantity, round(sum(l_extendedprice), 4) AS l_extendedprice,
       round(sum(l_discount), 4) AS l_discount, round(sum(l_tax), 4) AS l_tax
FROM lineitem GROUP BY l_returnflag""")
def group_sum(spark, d):
    """Sums in each group."""
    s = A.group_sum_numeric(Tables(spark, d).lineitem, "l_returnflag")
    return s.select(*[r(c, 4).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t.startswith("decimal") else F.col(c) for c, t in s.dtypes])


@query("group_mean_dims", oracle="""
WITH j AS (SELECT l.l_extendedprice, p.p_brand, p.p_type, CAST(p.p_size AS VARCHAR) AS p_size,
                  l.l_returnflag, l.l_linestatus
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT 'p_brand' AS dimension, p_brand AS value, round(avg(l_extendedprice), 6) AS mean, count(*) AS n FROM j GROUP BY 2
UNION ALL SELECT 'p_type', p_type, round(avg(l_extendedprice), 6), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'p_size', p_size, round(avg(l_extendedprice), 6), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'l_returnflag', l_returnflag, round(avg(l_extendedprice), 6), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, round(avg(l_extendedprice), 6), count(*) FROM j GROUP BY 2""")
def group_mean_dims(spark, d):
    """Mean sales by five dimensions in one GROUPING SETS pass."""
    t = Tables(spark, d)
    # Eager aggregation below the join: a mean is sum / count, so lineitem is
    # first reduced to one row per (part, flag, status) and only those rows
    # meet the part dimension.
    pre = (t.lineitem.groupBy("l_partkey", "l_returnflag", "l_linestatus")
           .agg(F.sum("l_extendedprice").alias("_s"), F.count("l_extendedprice").alias("_c")))
    j = pre.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size"), "l_partkey")
    g = A.grouping_sets_ratio(j, ["p_brand", "p_type", "p_size", "l_returnflag", "l_linestatus"], "_s", "_c")
    return g.select("dimension", "value", r("mean").alias("mean"), "n")


@query("group_mean_round", oracle="""
SELECT c.c_mktsegment, round_even(avg(o.o_totalprice), 0) + 0.0 AS mean_price,
       round_even(avg(year(o.o_orderdate)), 0) + 0.0 AS mean_year
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""")
def group_mean_round(spark, d):
    """Rounded means of two columns in each group."""
    t = Tables(spark, d)
    # partial sums per customer below the customer join (means = sums / counts)
    pre = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("_sp"), F.count("o_totalprice").alias("_cp"),
                                            F.sum(F.year("o_orderdate")).alias("_sy"),
                                            F.count(F.year("o_orderdate")).alias("_cy"))
    j = pre.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return j.groupBy("c_mktsegment").agg(
        F.bround(F.sum("_sp") / F.sum("_cp"), 0).alias("mean_price"),
        F.bround(F.sum("_sy") / F.sum("_cy"), 0).alias("mean_year"))


@query("value_counts", oracle="""
SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def value_counts(spark, d):
    """Rows of each value, most frequent first."""
    return A.value_counts(Tables(spark, d).orders, "o_orderpriority")


@query("value_counts_multi", oracle="""
SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2""")
def value_counts_multi(spark, d):
    """Rows of each pair of values."""
    return A.value_counts(Tables(spark, d).orders, ["o_orderstatus", "o_orderpriority"])


@query("group_value_counts", oracle="""
SELECT c_mktsegment, c_nationkey, count(*) AS count FROM customer GROUP BY 1, 2""")
def group_value_counts(spark, d):
    """Rows of each value within each group."""
    return A.value_counts(Tables(spark, d).customer, ["c_mktsegment", "c_nationkey"])


@query("pivot_counts", oracle="""
PIVOT (SELECT o_orderstatus, o_orderpriority FROM orders)
ON o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')
USING count(*) GROUP BY o_orderstatus""")
def pivot_counts(spark, d):
    """Counts of two columns as a table, one column a value."""
    return A.wide_counts(Tables(spark, d).orders, "o_orderstatus", "o_orderpriority")[0]


@query("crosstab_normalized", oracle="""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2),
     s AS (SELECT o_orderstatus, o_orderpriority, n * 1.0 / sum(n) OVER (PARTITION BY o_orderstatus) AS share FROM c)
SELECT o_orderpriority,
       round(max(share) FILTER (WHERE o_orderstatus = 'F'), 6) AS F,
       round(max(share) FILTER (WHERE o_orderstatus = 'O'), 6) AS O,
       round(max(share) FILTER (WHERE o_orderstatus = 'P'), 6) AS P
FROM s GROUP BY o_orderpriority""")
def crosstab_normalized(spark, d):
    """crosstab(status, priority, normalize='index').T: shares within each
    status, laid out with priorities as rows and statuses as columns."""
    p, statuses = A.wide_counts(Tables(spark, d).orders, "o_orderpriority", "o_orderstatus")
    p = stored(p, "counts")  # one row a priority, one column a status
    total = with_scalars(p, p.agg(*[F.sum(f"`{x}`").alias(f"_t_{x}") for x in statuses]))
    share = lambda x: F.when(F.col(f"`{x}`") > 0, r(F.col(f"`{x}`") / F.col(f"`_t_{x}`")))
    return total.select("o_orderpriority", *[share(x).alias(x) for x in statuses])


@query("transpose_small", oracle="""
PIVOT (SELECT l_linestatus, l_returnflag FROM lineitem) ON l_returnflag IN ('A', 'N', 'R')
USING count(*) GROUP BY l_linestatus""")
def transpose_small(spark, d):
    """Build returnflag x linestatus counts, then transpose the wide table
    (unpivot + pivot with the values that occur)."""
    wide, statuses = A.wide_counts(Tables(spark, d).lineitem, "l_returnflag", "l_linestatus")
    wide = stored(wide, "counts")
    flags = sorted(x[0] for x in wide.select("l_returnflag").collect())  # one column of the result each
    long = wide.unpivot("l_returnflag", [f"`{s}`" for s in statuses], "l_linestatus", "n")
    return long.groupBy("l_linestatus").pivot("l_returnflag", flags).agg(F.first("n")).fillna(0)


@query("share_of_total", oracle="""
SELECT c_mktsegment, count(*) AS count, round_even(count(*) / sum(count(*)) OVER (), 2) + 0.0 AS share,
       round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) + 0.0 AS percent
FROM customer GROUP BY c_mktsegment""")
def share_of_total(spark, d):
    """Each value's share of all rows."""
    vc = A.value_counts(Tables(spark, d).customer, "c_mktsegment", ordered=False)
    s = A.share_of_total(vc, "count", "share", digits=2)
    return A.share_of_total(s, "count", "percent", scale=100.0, digits=2)


@query("row_share", oracle="""
WITH p AS (PIVOT (SELECT o_orderstatus, o_orderpriority FROM orders)
           ON o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')
           USING count(*) GROUP BY o_orderstatus)
SELECT o_orderstatus, "1-URGENT" + "2-HIGH" + "3-MEDIUM" + "4-NOT SPECIFIED" + "5-LOW" AS total,
       round("1-URGENT" / total, 6) AS "1-URGENT", round("2-HIGH" / total, 6) AS "2-HIGH",
       round("3-MEDIUM" / total, 6) AS "3-MEDIUM", round("4-NOT SPECIFIED" / total, 6) AS "4-NOT SPECIFIED",
       round("5-LOW" / total, 6) AS "5-LOW"
FROM p""")
def row_share(spark, d):
    """Totals of rows of a table of counts, and the shares in them."""
    p, priorities = A.wide_counts(Tables(spark, d).orders, "o_orderstatus", "o_orderpriority")
    total = A.row_sum([f"`{v}`" for v in priorities])
    return p.select("o_orderstatus", total.alias("total"),
                    *[r(F.try_divide(F.col(f"`{v}`"), total)).alias(v) for v in priorities])


@query("sum_by_two", oracle="""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty FROM lineitem GROUP BY 1, 2""")
def sum_by_two(spark, d):
    """A sum by two columns."""
    li = Tables(spark, d).lineitem
    return A.group_agg(li, ["l_returnflag", "l_linestatus"], {"sum_qty": r(F.sum("l_quantity"), 4)})


@query("count_by_facets", oracle="""
SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count
FROM orders GROUP BY ALL""")
def count_by_facets(spark, d):
    """Counts by two columns and year."""
    o = Tables(spark, d).orders.withColumn("year", F.year("o_orderdate"))
    return A.value_counts(o, ["o_orderstatus", "o_orderpriority", "year"])


@query("mean_ci", oracle="""
SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean,
       round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS ci_low,
       round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS ci_high
FROM lineitem GROUP BY l_returnflag""")
def mean_ci(spark, d):
    """Means with 95 % confidence intervals."""
    m = A.mean_ci(Tables(spark, d).lineitem, "l_returnflag", "l_extendedprice")
    return m.select("l_returnflag", "n", *[r(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query("distinct_then_count", oracle="""
SELECT c_nationkey, count(*) AS count FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1""")
def distinct_then_count(spark, d):
    """Distinct pairs then count per key."""
    c = Tables(spark, d).customer.select("c_nationkey", "c_mktsegment").distinct()
    return c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("count"))


@query("argmax_row", oracle="""
WITH t AS (SELECT c.c_mktsegment, o.o_custkey AS c_custkey, round(sum(o.o_totalprice), 2) AS total
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT c_mktsegment, c_custkey, total FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, c_custkey) AS rn FROM t)
WHERE rn = 1""")
def argmax_row(spark, d):
    """The member with the largest measure."""
    t = Tables(spark, d)
    tot = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(r(F.sum("o_totalprice"), 2).alias("total"))
    j = tot.join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return A.argmax_row(j, "c_custkey", "total", group="c_mktsegment")


# ------------------------------------------------------------------ sorting
@query("sort_desc", oracle="SELECT o_orderkey, o_totalprice FROM orders")
def sort_desc(spark, d):
    """Rows from largest to smallest."""
    o = Tables(spark, d).orders.select("o_orderkey", "o_totalprice")
    return o.orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"))


@query("sort_multi", oracle="SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem")
def sort_multi(spark, d):
    """Rows in order of several columns."""
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return li.orderBy(F.col("l_shipdate").desc(), F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")


@query("sort_key", oracle="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders GROUP BY 1""")
def sort_key(spark, d):
    """Counts in order of their key."""
    o = Tables(spark, d).orders.withColumn("year", F.year("o_orderdate"))
    return A.value_counts(o, "year", ordered=False).orderBy("year")


@query("topk_sum", oracle="""
SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem
GROUP BY l_partkey ORDER BY sum(l_extendedprice) DESC, l_partkey LIMIT 15""")
def topk_sum(spark, d):
    """The members with the largest sums."""
    g = Tables(spark, d).lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("_s"))
    top = A.top_k(g, [F.col("_s").desc(), F.col("l_partkey")], 15)
    return top.select("l_partkey", r("_s", 2).alias("revenue"))


@query("order_by_frequency", oracle="""
SELECT c_mktsegment, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS freq_rank
FROM customer GROUP BY c_mktsegment""")
def order_by_frequency(spark, d):
    """Order categories by frequency."""
    f = A.order_by_frequency(Tables(spark, d).customer, "c_mktsegment")
    return f.withColumn("freq_rank", F.col("freq_rank").cast("long"))


# ----------------------------------------------------------- per-group heads
@query("head_per_group", oracle="""
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn <= 3""")
def head_per_group(spark, d):
    """The first rows of each group."""
    o = Tables(spark, d).orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return A.top_n_per_group(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 3, "_rn").drop("_rn")


@query("topn_per_class", oracle="""
WITH c AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_custkey, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_custkey) AS rank FROM c)
WHERE rank <= 20""")
def topn_per_class(spark, d):
    """Rank by count, take top-N per class."""
    c = A.value_counts(Tables(spark, d).orders, ["o_orderpriority", "o_custkey"], "n", ordered=False)
    t = A.top_n_per_group(c, "o_orderpriority", [F.col("n").desc(), F.col("o_custkey")], 20)
    return t.withColumn("rank", F.col("rank").cast("long"))


# ------------------------------------------------------------------ set ops
@query("union_tagged", oracle="""
SELECT o_orderkey, o_totalprice, 'train' AS source FROM orders WHERE year(o_orderdate) <= 1997
UNION ALL SELECT o_orderkey, NULL, 'test' FROM orders WHERE year(o_orderdate) > 1997""")
def union_tagged(spark, d):
    """Two tables under each other, with the source of each row."""
    o = Tables(spark, d).orders
    train = o.where(F.year("o_orderdate") <= 1997).select("o_orderkey", "o_totalprice")
    test = o.where(F.year("o_orderdate") > 1997).select("o_orderkey")
    return R.union_tagged({"train": train, "test": test})


@query("distinct_tags", oracle="""
SELECT DISTINCT unnest(string_split(p_name, ' ')) AS member FROM part""")
def distinct_tags(spark, d):
    """The distinct members of all lists."""
    p = Tables(spark, d).part
    return R.distinct_members(p, F.split("p_name", " "))


# ----------------------------------------------------------------- sampling
_MD5_SQL = "CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)"


def _seeded(key: str):
    """A number from a seeded digest of a key: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col(key).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


@query("sample_seeded", oracle=f"SELECT doc_id, lang, n_chars FROM documents ORDER BY {_MD5_SQL}, doc_id LIMIT 5")
def sample_seeded(spark, d):
    """Five reproducible random rows: those with the smallest seeded digest of
    the key, whatever the partitioning."""
    docs = Tables(spark, d).documents.select("doc_id", "lang", "n_chars")
    return A.top_k(docs.withColumn("_h", _seeded("doc_id")), [F.col("_h"), F.col("doc_id")], 5).drop("_h")


@query("split_random", oracle=f"SELECT doc_id, CASE WHEN {_MD5_SQL} % 100 < 80 THEN 'train' ELSE 'valid' END AS split FROM documents")
def split_random(spark, d):
    """Stable 80/20 split by a seeded digest of the key."""
    docs = Tables(spark, d).documents.select("doc_id")
    return docs.withColumn("split", F.when(_seeded("doc_id") % 100 < 80, "train").otherwise("valid"))
