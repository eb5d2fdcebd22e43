"""Cleaning and imputation queries (CLN*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators import clean as C
from loupe.plans.common import inject_nulls, r
from loupe.plans.registry import query
from loupe.sources.tables import Tables


@query("fill_const", oracle="""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'No Data' ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders""")
def fill_const(spark, d):
    """Blank texts and numbers take a constant."""
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    o = inject_nulls(inject_nulls(o, "o_orderpriority", "o_orderkey", 7), "o_totalprice", "o_orderkey", 11)
    return C.fill_const(C.fill_const(o, "No Data", ["o_orderpriority"]), 0.0, ["o_totalprice"])


@query("fill_mean", oracle="""
WITH li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
                   CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, l_discount
            FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, avg(l_quantity) OVER ()), 6) AS l_quantity,
       round(coalesce(l_extendedprice, avg(l_extendedprice) OVER ()), 6) AS l_extendedprice, l_discount FROM li""")
def fill_mean(spark, d):
    """Missing numbers take their column's mean."""
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    li = inject_nulls(inject_nulls(li, "l_quantity", "l_orderkey", 7), "l_extendedprice", "l_orderkey", 5)
    f = C.fill_mean(li, ["l_quantity", "l_extendedprice"])
    return f.select("l_orderkey", "l_linenumber", r("l_quantity").alias("l_quantity"),
                    r("l_extendedprice").alias("l_extendedprice"), "l_discount")


_ORDERS_2NULLS = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders)"""


@query("fill_mode", oracle=f"""
WITH o AS {_ORDERS_2NULLS},
mp AS (SELECT o_orderpriority AS m FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
ms AS (SELECT o_orderstatus AS m FROM o WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT m FROM mp)) AS o_orderpriority,
       coalesce(o_orderstatus, (SELECT m FROM ms)) AS o_orderstatus FROM o""")
def fill_mode(spark, d):
    """Missing values take their column's most frequent one."""
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    o = inject_nulls(inject_nulls(o, "o_orderpriority", "o_orderkey", 7), "o_orderstatus", "o_orderkey", 3)
    return C.fill_mode(o, ["o_orderpriority", "o_orderstatus"])


@query("drop_nulls", oracle="""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0""")
def drop_nulls(spark, d):
    """Rows with any missing field go."""
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    o = inject_nulls(inject_nulls(o, "o_orderpriority", "o_orderkey", 7), "o_totalprice", "o_orderkey", 11)
    return C.drop_nulls(o)


@query("dedup_rows", oracle="SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedup_rows(spark, d):
    """Repeated rows are kept once."""
    return C.dedup(Tables(spark, d).lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


# Many-to-one recode of order priorities.
PRIORITY_RECODE = {"1-URGENT": "HIGH", "2-HIGH": "HIGH", "4-NOT SPECIFIED": "UNKNOWN"}


@query("recode_values", oracle="""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH'
       WHEN '4-NOT SPECIFIED' THEN 'UNKNOWN' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def recode_values(spark, d):
    """Codes of one column replaced by names."""
    o = Tables(spark, d).orders
    return o.select("o_orderkey", C.recode("o_orderpriority", PRIORITY_RECODE).alias("o_orderpriority"))


@query("clean_money", oracle="""
WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN 'n/a'
                  WHEN c_custkey % 13 = 0 THEN NULL ELSE '$' || format('{:,.2f}', c_acctbal) END AS revenue_text
           FROM customer)
SELECT c_custkey, revenue_text, TRY_CAST(NULLIF(trim(regexp_replace(revenue_text, '[,$]', '', 'g')), '') AS DOUBLE) AS revenue
FROM m WHERE TRY_CAST(NULLIF(trim(regexp_replace(revenue_text, '[,$]', '', 'g')), '') AS DOUBLE) IS NOT NULL""")
def clean_money(spark, d):
    """Money text -> number: strip ',' and '$', blanks/junk -> NULL, drop them."""
    c = Tables(spark, d).customer
    text = (F.when(F.col("c_custkey") % 7 == 0, F.lit(""))
            .when(F.col("c_custkey") % 11 == 0, F.lit("n/a"))
            .when(F.col("c_custkey") % 13 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("$"), F.format_number("c_acctbal", 2))))
    m = c.select("c_custkey", text.alias("revenue_text"))
    return m.withColumn("revenue", C.money_to_double("revenue_text")).where(F.col("revenue").isNotNull())


_ORDERS_3NULLS = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders)"""


@query("impute_mode_all", oracle=f"""
WITH o AS {_ORDERS_3NULLS},
m1 AS (SELECT o_orderpriority AS m FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
m2 AS (SELECT o_orderstatus AS m FROM o WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
m3 AS (SELECT o_custkey AS m FROM o WHERE o_custkey IS NOT NULL GROUP BY 1
       ORDER BY count(*) DESC, o_custkey LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT m FROM m1)) AS o_orderpriority,
       coalesce(o_orderstatus, (SELECT m FROM m2)) AS o_orderstatus,
       coalesce(o_custkey, (SELECT m FROM m3)) AS o_custkey FROM o""")
def impute_mode_all(spark, d):
    """Most-frequent imputation of several columns; all modes from one
    long-form aggregate (ties -> smallest value)."""
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    o = inject_nulls(o, "o_orderpriority", "o_orderkey", 7)
    o = inject_nulls(o, "o_orderstatus", "o_orderkey", 3)
    o = inject_nulls(o, "o_custkey", "o_orderkey", 5)
    return C.impute_mode_all(o, ["o_orderpriority", "o_orderstatus", "o_custkey"])


@query("standardize", oracle="""
SELECT l_orderkey, l_linenumber,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice
FROM lineitem""")
def standardize(spark, d):
    """Columns centred and scaled to unit variance."""
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    z = C.standardize(li, ["l_quantity", "l_extendedprice"])
    return z.select("l_orderkey", "l_linenumber", r("l_quantity").alias("l_quantity"),
                    r("l_extendedprice").alias("l_extendedprice"))


@query("tabular_prep", oracle="""
WITH li2 AS (
  SELECT l_orderkey, l_linenumber, l_returnflag,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         (((l_orderkey % 1000003) * 2654435761) % 100) < 80 AS is_train FROM lineitem),
codes AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) AS code
          FROM (SELECT DISTINCT l_returnflag FROM li2 WHERE is_train AND l_returnflag IS NOT NULL)),
med AS (SELECT quantile_cont(l_quantity, 0.5) AS m FROM li2 WHERE is_train),
filled AS (SELECT li2.*, coalesce(l_quantity, (SELECT m FROM med)) AS q_filled, l_quantity IS NULL AS l_quantity_na
           FROM li2),
st AS (SELECT avg(q_filled) AS mu, stddev_pop(q_filled) AS sd FROM filled WHERE is_train)
SELECT l_orderkey, l_linenumber, is_train, coalesce(codes.code, 0) AS l_returnflag_code, l_quantity_na,
       round((q_filled - (SELECT mu FROM st)) / (SELECT sd FROM st), 6) AS l_quantity_norm
FROM filled LEFT JOIN codes USING (l_returnflag)""")
def tabular_prep(spark, d):
    """Category -> integer code (0 = unknown), median fill + missing
    flag, population z-score; statistics from the training split only."""
    from loupe.operators.models import tabular_prepare
    li = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    li = inject_nulls(li, "l_quantity", "l_orderkey", 7)
    li = li.withColumn("is_train", (((F.col("l_orderkey") % 1000003) * 2654435761) % 100) < 80)
    out = tabular_prepare(li, cat_cols=["l_returnflag"], num_cols=["l_quantity"], train_flag="is_train")
    return out.select("l_orderkey", "l_linenumber", "is_train", "l_returnflag_code", "l_quantity_na",
                      r("l_quantity_norm").alias("l_quantity_norm"))
