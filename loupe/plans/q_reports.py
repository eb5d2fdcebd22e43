"""Composite analyses (CMP*): the end-to-end questions of the notebooks,
bound to the test tables (analogue map: orders/customer/nation stand for
medals/athletes/hosts, lineitem/part for sales/stores, ...)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators.aggregate import top_n_per_group
from loupe.operators.clean import recode
from loupe.operators.relate import bounded, join_named
from loupe.plans.registry import query
from loupe.session import stored
from loupe.sources.tables import Tables

# The medal classes and their order-priority analogues.
MEDAL_MAP = {"1-URGENT": "GOLD", "2-HIGH": "SILVER", "3-MEDIUM": "BRONZE"}
MEDALS = ["GOLD", "SILVER", "BRONZE"]


def medal_facts(t: Tables):
    """orders recoded to medal classes, pre-aggregated per customer before
    the customer join (one row per customer and class instead of per order),
    then attached to the nation dimension (25 rows, broadcast)."""
    o = (t.orders.where(F.col("o_orderstatus") == "F")
         .select("o_custkey", recode("o_orderpriority", MEDAL_MAP).alias("medal_class"))
         .where(F.col("medal_class").isin(MEDALS))
         .groupBy("o_custkey", "medal_class").agg(F.count(F.lit(1)).alias("k")))
    c = t.customer.select("c_custkey", "c_nationkey")
    j = join_named(o, c, "o_custkey", "c_custkey", "left")
    j = join_named(j, bounded(t.nation.select("n_nationkey", "n_name")),
                   "c_nationkey", "n_nationkey", "left")
    return j.where(F.col("n_name").isNotNull())


@query("top10_by_class", oracle="""
WITH f AS (
  SELECT n.n_name,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'GOLD' WHEN '2-HIGH' THEN 'SILVER'
              WHEN '3-MEDIUM' THEN 'BRONZE' ELSE o.o_orderpriority END AS medal_class
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE o.o_orderstatus = 'F'
), g AS (
  SELECT medal_class, n_name, count(*) AS medals FROM f
  WHERE medal_class IN ('GOLD','SILVER','BRONZE') AND n_name IS NOT NULL GROUP BY 1, 2
  UNION ALL
  SELECT 'ALL', n_name, count(*) FROM f
  WHERE medal_class IN ('GOLD','SILVER','BRONZE') AND n_name IS NOT NULL GROUP BY 2
)
SELECT medal_class, n_name, medals, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY medal_class ORDER BY medals DESC, n_name) AS rank FROM g)
WHERE rank <= 10
""")
def top10_by_class(spark, sf_dir):
    """Top 10 nations per medal class and over all classes."""
    f = medal_facts(Tables(spark, sf_dir))
    g = (f.groupingSets([["medal_class", "n_name"], ["n_name"]], "medal_class", "n_name")
         .agg(F.sum("k").alias("medals"), F.grouping_id().alias("_g"))
         .withColumn("medal_class", F.when(F.col("_g") == 0, F.col("medal_class")).otherwise(F.lit("ALL"))))
    r = top_n_per_group(g, "medal_class", [F.col("medals").desc(), F.col("n_name")], 10)
    return r.select("medal_class", "n_name", "medals", F.col("rank").cast("long").alias("rank"))


# --------------------------------------------------------------------------
from loupe.functions import dates as D  # noqa: E402
from loupe.operators import aggregate as A  # noqa: E402
from loupe.operators import clean as C  # noqa: E402
from loupe.operators import stats as ST  # noqa: E402
from loupe.operators.relate import semi_join_top_k  # noqa: E402
from loupe.plans.common import r  # noqa: E402

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("catalog_clean", oracle="""
WITH raw AS (
  SELECT o_custkey,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%B %-d, %Y') END AS date_text
  FROM orders),
m AS (SELECT o_orderpriority AS m FROM raw WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
c AS (
  SELECT DISTINCT o_custkey, coalesce(o_orderstatus, 'No Data') AS o_orderstatus,
         coalesce(o_orderpriority, (SELECT m FROM m)) AS o_orderpriority,
         CAST(strptime(date_text, '%B %d, %Y') AS DATE) AS date_added
  FROM raw WHERE date_text IS NOT NULL)
SELECT *, CAST(year(date_added) AS INTEGER) AS year_added, CAST(month(date_added) AS INTEGER) AS month_added,
       monthname(date_added) AS month_name_added FROM c""")
def catalog_clean(spark, d):
    """Parse text dates, fill the mode / a constant, drop rows still
    missing, drop duplicates, derive year / month / month name."""
    from loupe.plans.common import inject_nulls
    o = Tables(spark, d).orders
    o = inject_nulls(o, "o_orderstatus", "o_orderkey", 11)
    o = inject_nulls(o, "o_orderpriority", "o_orderkey", 7)
    txt = F.when(F.col("o_orderkey") % 13 != 0, F.date_format("o_orderdate", "MMMM d, yyyy"))
    raw = o.select("o_custkey", "o_orderstatus", "o_orderpriority", txt.alias("date_text"))
    x = raw.withColumn("date_added", D.parse_date("date_text", "MMMM d, yyyy")).drop("date_text")
    x = C.fill_mode(x, ["o_orderpriority"])
    x = C.fill_const(x, "No Data", ["o_orderstatus"])
    x = C.dedup(C.drop_nulls(x))
    return x.select("*", F.year("date_added").alias("year_added"), F.month("date_added").alias("month_added"),
                    D.month_name("date_added").alias("month_name_added"))


def _cust_nation(t):
    return t.customer.select("c_custkey", "c_mktsegment", "c_nationkey").join(
        bounded(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")


@query("share_by_top_group", oracle="""
WITH j AS (SELECT n.n_name, c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
top AS (SELECT n_name FROM j GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 11),
p AS (PIVOT (SELECT * FROM j WHERE n_name IN (SELECT n_name FROM top))
      ON c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') USING count(*) GROUP BY n_name)
SELECT n_name, AUTOMOBILE + BUILDING + FURNITURE + HOUSEHOLD + MACHINERY AS total,
       round(AUTOMOBILE / total, 6) AS AUTOMOBILE, round(BUILDING / total, 6) AS BUILDING,
       round(FURNITURE / total, 6) AS FURNITURE, round(HOUSEHOLD / total, 6) AS HOUSEHOLD,
       round(MACHINERY / total, 6) AS MACHINERY FROM p""")
def share_by_top_group(spark, d):
    """For the 11 nations with most customers, each segment's share of
    the nation's customers (pivot, row total, row share), by total desc."""
    t = Tables(spark, d)
    # customers are counted by nation key and segment before the names are joined
    c = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    names = bounded(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))
    c = stored(c.join(names, "c_nationkey").groupBy("n_name", "c_mktsegment").agg(F.sum("n").alias("n")), "segment-counts")
    top = c.groupBy("n_name").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "n_name").limit(11)
    segments = sorted(x[0] for x in c.where("c_mktsegment is not null").select("c_mktsegment").distinct().collect())  # one column each
    p = c.groupBy("n_name").pivot("c_mktsegment", segments).agg(F.sum("n")).fillna(0)
    total = A.row_sum([f"`{s}`" for s in segments])
    return p.join(bounded(top.select("n_name")), "n_name", "left_semi").select(
        "n_name", total.alias("total"), *[r(F.col(f"`{s}`") / total).alias(s) for s in segments]).orderBy(F.col("total").desc(), "n_name")


@query("mirrored_counts", oracle="""
SELECT o_orderpriority, -count(*) FILTER (WHERE o_orderstatus = 'F') AS F,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def mirrored_counts(spark, d):
    """Priority x status counts (missing = 0), one side negated for a
    mirrored bar chart."""
    p, classes = A.wide_counts(Tables(spark, d).orders, "o_orderpriority", "o_orderstatus")
    # the first class points the other way
    return p.select("o_orderpriority", (-F.col(f"`{classes[0]}`")).alias(classes[0]), *[f"`{c}`" for c in classes[1:]])


@query("counts_per_year", oracle="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def counts_per_year(spark, d):
    """Filter one type, count per year, sort by year."""
    o = Tables(spark, d).orders.where(F.col("o_orderstatus") == "F").withColumn("year", F.year("o_orderdate"))
    return A.value_counts(o, "year", ordered=False).orderBy("year")


@query("mix_of_top_groups", oracle="""
WITH j AS (SELECT n.n_name, c.c_mktsegment FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
top AS (SELECT n_name FROM j GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 10),
c AS (SELECT n_name, c_mktsegment, count(*) AS n FROM j WHERE n_name IN (SELECT n_name FROM top) GROUP BY 1, 2)
SELECT c_mktsegment, n_name, round(n / sum(n) OVER (PARTITION BY n_name), 6) AS share FROM c""")
def mix_of_top_groups(spark, d):
    """Segment mix within each of the top 10 nations (crosstab
    normalised by nation, transposed to segment rows; long form)."""
    j = semi_join_top_k(_cust_nation(Tables(spark, d)), "n_name", 10)
    c = A.value_counts(j, ["n_name", "c_mktsegment"], "n", ordered=False)
    s = A.share_within(c, "n_name", "n", "share")
    return s.select("c_mktsegment", "n_name", r("share").alias("share"))


@query("gap_of_top_groups", oracle="""
WITH os AS (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1),
j AS (SELECT n.n_name, o.o_orderstatus, year(o.o_orderdate) AS oy, year(os.first_ship) AS sy
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
      JOIN os ON os.l_orderkey = o.o_orderkey),
top AS (SELECT n_name FROM j GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 10)
SELECT o_orderstatus, n_name, round_even(avg(oy), 0) + 0.0 AS mean_order_year, round_even(avg(sy), 0) + 0.0 AS mean_ship_year,
       round_even(avg(sy), 0) - round_even(avg(oy), 0) + 0.0 AS gap
FROM j WHERE n_name IN (SELECT n_name FROM top) AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2""")
def gap_of_top_groups(spark, d):
    """For the top 10 nations, mean order year vs mean first-ship year
    (rounded half to even), per status."""
    t = Tables(spark, d)
    ship = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_ship"))
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("oy"))
    # per (customer, status) sums below the customer join; means = sums / counts
    pc = (o.join(ship, "o_orderkey").groupBy("o_custkey", "o_orderstatus")
          .agg(F.sum("oy").alias("_so"), F.sum(F.year("first_ship")).alias("_ss"), F.count(F.lit(1)).alias("_c")))
    j = pc.join(_cust_nation(t).select(F.col("c_custkey").alias("o_custkey"), "n_name"), "o_custkey")
    j = semi_join_top_k(j, "n_name", 10, measure=F.sum("_c"))
    g = j.where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus", "n_name").agg(
        F.bround(F.sum("_so") / F.sum("_c"), 0).alias("mean_order_year"),
        F.bround(F.sum("_ss") / F.sum("_c"), 0).alias("mean_ship_year"))
    return g.withColumn("gap", F.col("mean_ship_year") - F.col("mean_order_year")).orderBy(F.col("gap").desc(), "n_name")


@query("tag_correlation", oracle="""
WITH p AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part WHERE p_brand = 'Brand#1'),
n AS (SELECT count(DISTINCT p_partkey) AS n FROM p),
t AS (SELECT tag, count(DISTINCT p_partkey) AS k FROM p GROUP BY tag),
pr AS (SELECT a.tag AS feature_i, b.tag AS feature_j, count(DISTINCT a.p_partkey) AS kab
       FROM p a JOIN p b ON a.p_partkey = b.p_partkey AND a.tag > b.tag GROUP BY 1, 2),
pairs AS (SELECT ti.tag AS feature_i, tj.tag AS feature_j, ti.k AS ki, tj.k AS kj FROM t ti JOIN t tj ON ti.tag > tj.tag)
SELECT pairs.feature_i, pairs.feature_j,
       round((n * coalesce(kab, 0) - ki * kj) / sqrt(ki * (n - ki) * kj * (n - kj)), 9) AS corr
FROM pairs LEFT JOIN pr USING (feature_i, feature_j), n""")
def tag_correlation(spark, d):
    """Filter one brand, split names into tags, Pearson correlation of
    the indicators of every tag pair (lower triangle)."""
    p = Tables(spark, d).part.where(F.col("p_brand") == "Brand#1").select(
        "p_partkey", F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("tags"))
    return ST.tag_pairs(p, "tags").select("feature_i", "feature_j", r("corr", 9).alias("corr"))


@query("top_members", oracle="""
SELECT o_custkey, count(o_orderkey) AS n_orders FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_members(spark, d):
    """Members with the most records (count, then top 10)."""
    g = A.group_count(Tables(spark, d).orders, "o_custkey", "o_orderkey", "n_orders")
    return A.top_k(g, [F.col("n_orders").desc(), F.col("o_custkey")], 10)


@query("top_combinations", oracle="""
WITH j AS (SELECT n.n_name, c.c_mktsegment, o.o_orderpriority, year(o.o_orderdate) AS year
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
           WHERE o.o_orderstatus IN ('F', 'O')),
s AS (SELECT n_name, c_mktsegment, o_orderpriority, year, count(*) AS size FROM j GROUP BY ALL
      ORDER BY size DESC, n_name, c_mktsegment, o_orderpriority, year LIMIT 100)
SELECT n_name, c_mktsegment, CAST(sum(size) AS BIGINT) AS total FROM s GROUP BY 1, 2""")
def top_combinations(spark, d):
    """Size per (nation, segment, priority, year), top 100, then summed
    by (nation, segment)."""
    t = Tables(spark, d)
    # orders reduced to (customer, priority, year) counts before the customer join
    o = (t.orders.where(F.col("o_orderstatus").isin("F", "O"))
         .groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", F.year("o_orderdate").alias("year"))
         .agg(F.count(F.lit(1)).alias("_c")))
    j = o.join(_cust_nation(t), "c_custkey")
    keys = ["n_name", "c_mktsegment", "o_orderpriority", "year"]
    s = A.not_null_keys(j, keys).groupBy(*keys).agg(F.sum("_c").alias("size"))
    top = A.top_k(s, [F.col("size").desc()] + [F.col(k) for k in keys], 100)
    return top.groupBy("n_name", "c_mktsegment").agg(F.sum("size").alias("total"))


@query("stacked_by_class", oracle="""
SELECT p.p_type, l.l_returnflag, count(l.l_orderkey) AS count
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def stacked_by_class(spark, d):
    """Counts per (type, class), kept for the chosen classes."""
    t = Tables(spark, d)
    # count per (part, class) first, so only those rows meet the part dimension
    pre = (t.lineitem.where(F.col("l_returnflag").isin("A", "R"))
           .groupBy("l_partkey", "l_returnflag").agg(F.count("l_orderkey").alias("_c")))
    j = pre.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return j.groupBy("p_type", "l_returnflag").agg(F.sum("_c").alias("count"))


@query("dimension_means", oracle="""
WITH j AS (SELECT l.l_extendedprice AS sales, CAST(year(l.l_shipdate) AS VARCHAR) AS year,
                  CAST(month(l.l_shipdate) AS VARCHAR) AS month, CAST(isodow(l.l_shipdate) - 1 AS VARCHAR) AS weekday,
                  p.p_brand, CAST(p.p_size AS VARCHAR) AS p_size
           FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)
SELECT 'year' AS dimension, year AS value, round(avg(sales), 6) AS mean, count(*) AS n FROM j GROUP BY 2
UNION ALL SELECT 'month', month, round(avg(sales), 6), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'weekday', weekday, round(avg(sales), 6), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'p_brand', p_brand, round(avg(sales), 6), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'p_size', p_size, round(avg(sales), 6), count(*) FROM j GROUP BY 2""")
def dimension_means(spark, d):
    """Date parts + left join to the product dimension, then mean
    sales by five dimensions in one GROUPING SETS pass."""
    t = Tables(spark, d)
    li = t.lineitem.select("l_partkey", F.col("l_extendedprice").alias("sales"), "l_shipdate")
    li = li.select("l_partkey", "sales", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
                   F.weekday("l_shipdate").alias("weekday"))
    j = li.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey", "left")
    g = A.grouping_sets_mean(j, ["year", "month", "weekday", "p_brand", "p_size"], "sales")
    return g.select("dimension", "value", r("mean").alias("mean"), "n")


@query("totals_in_millions", oracle="""
WITH j AS (SELECT s.s_name, n.n_name, rg.r_name, l.l_extendedprice AS sales
           FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
           JOIN region rg ON n.n_regionkey = rg.r_regionkey),
t AS (SELECT 'supplier' AS level, s_name AS name, sum(sales) AS total FROM j GROUP BY 2
      UNION ALL SELECT 'nation', n_name, sum(sales) FROM j GROUP BY 2
      UNION ALL SELECT 'region', r_name, sum(sales) FROM j GROUP BY 2)
SELECT level, name, round(total / 1e6, 6) AS total_m, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY total DESC, name) AS rank FROM t) WHERE rank <= 55""")
def totals_in_millions(spark, d):
    """Total sales per supplier / nation / region, top 55 each, in
    millions (one GROUPING SETS aggregate after pre-aggregating per supplier)."""
    t = Tables(spark, d)
    per_supp = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_extendedprice").alias("sales"))
    dims = (t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
            .join(bounded(t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))), "n_nationkey")
            .join(bounded(t.region.select("r_regionkey", "r_name")), "r_regionkey"))
    j = per_supp.join(dims, "s_suppkey")
    g = j.groupingSets([["s_name"], ["n_name"], ["r_name"]], "s_name", "n_name", "r_name").agg(
        F.sum("sales").alias("total"), F.grouping_id().alias("_g"))
    lvl = F.when(F.col("_g") == 3, "supplier").when(F.col("_g") == 5, "nation").otherwise("region")
    name = F.coalesce("s_name", "n_name", "r_name")
    g = g.select(lvl.alias("level"), name.alias("name"), "total")
    top = A.top_n_per_group(g, "level", [F.col("total").desc(), F.col("name")], 55)
    return top.select("level", "name", r(F.col("total") / 1e6).alias("total_m"), F.col("rank").cast("long"))
