"""Source and sink queries (SRC*, SNK1, DTE8, CMP20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.operators.clean import money_to_double
from loupe.operators.scalars import with_scalars
from loupe.plans.registry import query
from loupe.sources import files as FS
from loupe.sources import html as H
from loupe.sources.tables import Tables


@query("src_csv_roundtrip", oracle="SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv_roundtrip(spark, d):
    """Write a table as CSV with a header (no row label) and read it back
    with an explicit schema."""
    path = FS.new_scratch(spark, "csv-nation")
    FS.write_csv(Tables(spark, d).nation, path)
    return FS.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("src_csv_dates", oracle="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders""")
def src_csv_dates(spark, d):
    """Dates typed on read (``yyyy-MM-dd``) from a CSV round trip."""
    path = FS.new_scratch(spark, "csv-orders")
    o = Tables(spark, d).orders.select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    FS.write_csv(o, path)
    return FS.read_csv(spark, path, "o_orderkey long, o_orderdate date, o_totalprice double")


@query("src_latin1", oracle="""
SELECT n_nationkey, n_name || ' Ça-Göteborg-Año' AS place FROM nation""")
def src_latin1(spark, d):
    """Single-byte encoded CSV (ISO-8859-1) with accented text, read back."""
    path = FS.new_scratch(spark, "csv-latin1")
    n = Tables(spark, d).nation.select("n_nationkey", F.concat("n_name", F.lit(" Ça-Göteborg-Año")).alias("place"))
    FS.write_csv(n, path, encoding="ISO-8859-1")
    return FS.read_csv(spark, path, "n_nationkey int, place string", encoding="ISO-8859-1")


@query("src_file_inventory")
def src_file_inventory(spark, d):
    """All files under the data folder with their sizes, plus the count."""
    inv = FS.file_inventory(spark, d)
    n = inv.agg(F.count(F.lit(1)).alias("n_files"))
    return with_scalars(inv.select("file_name", "length"), n)


@query("src_wholetext_join", oracle="""
SELECT d.doc_id, d.lang, length(d.text) AS text_len FROM documents d""")
def src_wholetext_join(spark, d):
    """One text file per document id, read whole and joined back to the
    document metadata by id."""
    t = Tables(spark, d)
    path = FS.new_scratch(spark, "texts")
    FS.write_texts(t.documents, "doc_id", "text", path)
    texts = FS.read_texts(spark, path, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    # what is returned of a text is taken before the join, so that texts are not shuffled
    texts = texts.withColumn("text_len", F.length("text").cast("long")).drop("text", "file_name")
    j = texts.join(t.documents.select("doc_id", "lang"), "doc_id")
    return j.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text_len")


@query("html_rows", oracle="""
WITH a AS (SELECT page_id,
  regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs,
  regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS texts FROM pages)
SELECT page_id, CAST(i AS INTEGER) AS link_no, replace(hrefs[i], '&amp;', '&') AS href, replace(texts[i], '&amp;', '&') AS text
FROM a, range(1, len(hrefs) + 1) AS r(i)""")
def html_rows(spark, d):
    """Links of stored web pages as rows (page_id, link_no, href, text)."""
    return H.anchors(Tables(spark, d).pages, "page_id", "html")


@query("page_lists", oracle="""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) AS lists FROM pages),
x AS (SELECT page_id, CAST(n AS INTEGER) AS list_no, regexp_extract_all(lists[n], '(?s)<li>(.*?)</li>', 1) AS items FROM l, range(1, len(lists) + 1) AS r(n))
SELECT page_id, list_no, CAST(i AS INTEGER) AS item_no, replace(regexp_replace(items[i], '<[^>]*>', '', 'g'), '&amp;', '&') AS text
FROM x, range(1, len(items) + 1) AS r(i)""")
def page_lists(spark, d):
    """Lists of the stored pages as tables of one cell a row."""
    return H.list_items(Tables(spark, d).pages, "page_id", "html")


@query("page_first_list", oracle="""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) AS lists FROM pages),
x AS (SELECT page_id, n, regexp_extract_all(lists[n], '(?s)<li>(.*?)</li>', 1) AS items FROM l, range(1, len(lists) + 1) AS r(n)),
y AS (SELECT page_id, n, i, replace(regexp_replace(items[i], '<[^>]*>', '', 'g'), '&amp;', '&') AS text FROM x, range(1, len(items) + 1) AS r(i)),
f AS (SELECT page_id, min(n) AS n FROM y WHERE regexp_matches(text, '^t[ho]') GROUP BY 1)
SELECT page_id, CAST(i AS INTEGER) AS item_no, text FROM y JOIN f USING (page_id, n)""")
def page_first_list(spark, d):
    """The first list of each page with an item that starts in "th" or "to"."""
    t = H.first_matching_table(Tables(spark, d).pages, "page_id", "html", "^t[ho]", ("list",))
    return t.select("page_id", F.col("row_no").alias("item_no"), F.col("cells")[0].alias("text"))


@query("holiday_frame", oracle="""
SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds, 'holiday' AS holiday,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'National' WHEN '2-HIGH' THEN 'Regional' ELSE 'Local' END AS locale
FROM orders
WHERE o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_orderstatus = 'F')""")
def holiday_frame(spark, d):
    """Holiday calendar: National OR (Regional AND Holiday) rows, a constant
    label and a date.  locale <- priority, type <- status."""
    o = Tables(spark, d).orders
    locale = (F.when(F.col("o_orderpriority") == "1-URGENT", "National")
              .when(F.col("o_orderpriority") == "2-HIGH", "Regional").otherwise("Local"))
    typ = F.when(F.col("o_orderstatus") == "F", "Holiday").when(F.col("o_orderstatus") == "O", "Event").otherwise("Additional")
    x = o.select(F.to_date("o_orderdate").alias("ds"), locale.alias("locale"), typ.alias("type"))
    x = x.where((F.col("locale") == "National") | ((F.col("locale") == "Regional") & (F.col("type") == "Holiday")))
    return x.select("ds", F.lit("holiday").alias("holiday"), "locale").distinct()


def revenue_pages(t: Tables):
    """One HTML page per year: a summary table, then the quarterly revenue
    table with money-formatted cells (built from lineitem)."""
    li = t.lineitem.select(F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("q"), "l_extendedprice")
    q = li.groupBy("year", "q").agg(F.sum("l_extendedprice").alias("rev"))
    q = q.withColumn("date", F.last_day(F.make_date("year", F.col("q") * 3, F.lit(1))))
    cell = F.concat(F.lit("<tr><td>"), F.col("date").cast("string"), F.lit("</td><td>$"),
                    F.format_number("rev", 2), F.lit("</td></tr>"))
    # A year has four quarters, so the rows collected per page are bounded.
    rows = q.groupBy("year").agg(F.array_join(F.sort_array(F.collect_list(F.struct("date", cell.alias("c")))).getField("c"), "").alias("rows"))
    page = F.concat(F.lit("<html><body><h1>Report</h1><table><tr><th>Year</th></tr><tr><td>"),
                    F.col("year").cast("string"), F.lit("</td></tr></table><table><tr><th>Quarterly Revenue &amp; Date</th>"
                                                        "<th>Revenue</th></tr>"), F.col("rows"),
                    F.lit("<tr><td></td><td></td></tr></table></body></html>"))
    return rows.select("year", page.alias("html"))


@query("revenue_from_html", oracle="""
SELECT CAST(year(l_shipdate) AS INTEGER) AS year,
       last_day(make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1)) AS date,
       round(sum(l_extendedprice), 2) AS revenue
FROM lineitem GROUP BY 1, 2""")
def revenue_from_html(spark, d):
    """First table matching 'Quarterly Revenue' of each page -> name
    the columns -> strip '$' and ',' -> drop blank and null revenue."""
    pages = revenue_pages(Tables(spark, d))
    t = H.first_matching_table(pages, "year", "html", "Quarterly Revenue")
    body = t.where(~F.col("header")).select("year", F.col("cells")[0].alias("Date"), F.col("cells")[1].alias("Revenue"))
    body = body.where(F.col("Revenue") != "")
    return body.select("year", F.to_date("Date").alias("date"), money_to_double("Revenue").alias("revenue")).dropna()
