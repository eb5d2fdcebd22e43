"""String, list, nested, date and math queries (TXT*, ARR1, NST2, JOI8,
DTE*, MTH*, PRJ11, PRJ12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.functions import dates as D
from loupe.functions import mathx as M
from loupe.functions import text as T
from loupe.operators import aggregate as A
from loupe.plans.common import r
from loupe.operators.wordcloud import word_cloud as word_cloud_table
from loupe.plans.registry import query
from loupe.session import stored
from loupe.sources.tables import Tables

_STOP_SQL = ", ".join("('" + w.replace("'", "''") + "')" for w in T.STOP_WORDS)


# ---------------------------------------------------------------- strings
@query("first_token", oracle="SELECT p_partkey, split_part(p_name, ' ', 1) AS first_token FROM part")
def first_token(spark, d):
    """The first part of a text."""
    p = Tables(spark, d).part
    return p.select("p_partkey", T.first_token("p_name").alias("first_token"))


_DURATION_TEXT_SQL = """CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 9 + 1 AS VARCHAR) || ' Seasons'
  WHEN p_partkey % 3 = 1 THEN CAST(p_size * 5 AS VARCHAR) || ' min' ELSE '1 Season' END"""


def _duration_text():
    return (F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit(" Seasons")))
            .when(F.col("p_partkey") % 3 == 1, F.concat((F.col("p_size") * 5).cast("string"), F.lit(" min")))
            .otherwise(F.lit("1 Season")))


@query("parse_duration", oracle=f"""
WITH t AS (SELECT p_partkey, {_DURATION_TEXT_SQL} AS duration FROM part)
SELECT p_partkey, duration,
       CASE WHEN contains(duration, 'min') THEN CAST(split_part(duration, ' ', 1) AS BIGINT) ELSE 0 END AS minutes,
       CASE WHEN contains(duration, 'min') THEN 0 ELSE CAST(split_part(duration, ' ', 1) AS BIGINT) END AS seasons
FROM t""")
def parse_duration(spark, d):
    """'90 min' -> minutes, 'N Seasons' -> seasons (text built from part)."""
    p = Tables(spark, d).part.select("p_partkey", _duration_text().alias("duration"))
    minutes, seasons = T.parse_duration("duration")
    return p.select("p_partkey", "duration", minutes.cast("long").alias("minutes"),
                    seasons.cast("long").alias("seasons"))


_LIST_TEXT_SQL = """CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', ' ,') WHEN 1 THEN replace(p_name, ' ', ', ')
  ELSE replace(p_name, ' ', ',') END"""


def _list_text():
    return (F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit(" ,")))
            .when(F.col("p_partkey") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit(", ")))
            .otherwise(F.replace("p_name", F.lit(" "), F.lit(","))))


@query("split_list", oracle=f"""
WITH t AS (SELECT p_partkey, string_split(replace(replace({_LIST_TEXT_SQL}, ' ,', ','), ', ', ','), ',') AS l FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS pos, l[i] AS member FROM t, range(1, len(l) + 1) AS r(i)""")
def split_list(spark, d):
    """Members of a text list, blanks around commas ignored."""
    p = Tables(spark, d).part.select("p_partkey", T.split_list(_list_text()).alias("l"))
    return p.select("p_partkey", F.posexplode("l").alias("pos", "member")).select(
        "p_partkey", (F.col("pos") + 1).alias("pos"), "member")


@query("word_count", oracle="""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words
FROM documents""")
def word_count(spark, d):
    """Words of a text."""
    return Tables(spark, d).documents.select("doc_id", T.word_count("text").alias("n_words"))


@query("member_counts", oracle=f"""
WITH t AS (SELECT ltrim(unnest(string_split({_LIST_TEXT_SQL}, ','))) AS member FROM part)
SELECT member, count(*) AS count FROM t WHERE member IS NOT NULL GROUP BY member""")
def member_counts(spark, d):
    """Frequency of members of a comma-separated column (split, left-strip,
    count, sort)."""
    p = Tables(spark, d).part.select(F.explode(F.split(_list_text(), ",")).alias("m"))
    return A.value_counts(p.select(F.ltrim("m").alias("member")), "member")


@query("word_freq", oracle=f"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']+')) AS word FROM documents),
s(word) AS (VALUES {_STOP_SQL})
SELECT word, count(*) AS count FROM w WHERE word NOT IN (SELECT word FROM s)
GROUP BY word ORDER BY count(*) DESC, word LIMIT 5000""")
def word_freq(spark, d):
    """Word-cloud table: lower-cased words minus stop words, top 5,000 by
    count.  Tokens are exploded (never concatenated), counted with a partial
    aggregate, and ranked with TakeOrderedAndProject."""
    docs = Tables(spark, d).documents
    w = docs.select(F.explode(T.tokens("text")).alias("word"))
    w = w.join(T.stop_words_df(spark), "word", "left_anti")
    c = w.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return A.top_k(c, [F.col("count").desc(), F.col("word")], 5000)


_CLOUD_STOP_SQL = ", ".join("('" + w.replace("'", "''") + "')" for w in sorted({*T.STOP_WORDS, *(w[:-2] for w in T.STOP_WORDS if w.endswith("'s"))}))


@query("word_cloud", oracle=f"""
WITH raw AS (SELECT list_filter(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']+'), lambda x: regexp_replace(x, '''s$', '')),
                                lambda x: x <> '' AND NOT regexp_matches(x, '^\\p{{Nd}}+$')) AS w FROM documents),
stop(word) AS (VALUES {_CLOUD_STOP_SQL}),
p0 AS (SELECT w[i] AS a, w[i + 1] AS b FROM raw, range(1, len(w) + 1) AS r(i)),
p AS (SELECT a, CASE WHEN b IN (SELECT word FROM stop) THEN NULL ELSE b END AS b, count(*) AS n FROM p0 WHERE a NOT IN (SELECT word FROM stop) GROUP BY 1, 2),
u AS (SELECT a AS word, sum(n) AS n FROM p GROUP BY 1),
f AS (SELECT u.word, coalesce(s.word, u.word) AS base, u.n FROM u LEFT JOIN u s ON u.word LIKE '%s' AND u.word NOT LIKE '%ss' AND s.word = left(u.word, length(u.word) - 1)),
c AS (SELECT base, sum(n) AS n FROM f GROUP BY 1),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c),
b1 AS (SELECT a || ' ' || b AS pair, a, b, n FROM p WHERE b IS NOT NULL),
b2 AS (SELECT coalesce(s.pair, x.pair) AS base, x.a, CASE WHEN s.pair IS NULL THEN x.b ELSE left(x.b, length(x.b) - 1) END AS b, x.n
       FROM b1 x LEFT JOIN b1 s ON x.pair LIKE '%s' AND x.pair NOT LIKE '%ss' AND s.pair = left(x.pair, length(x.pair) - 1)),
b3 AS (SELECT base, a, b, sum(n) AS n FROM b2 GROUP BY 1, 2, 3),
j AS (SELECT b3.base, fa.base AS fa, fb.base AS fb, CAST(b3.n AS DOUBLE) AS n, CAST(ca.n AS DOUBLE) AS na, CAST(cb.n AS DOUBLE) AS nb, t
      FROM b3 JOIN f fa ON fa.word = a JOIN f fb ON fb.word = b JOIN c ca ON ca.base = fa.base JOIN c cb ON cb.base = fb.base, tot),
x AS (SELECT *, nb / t AS p, n / na AS p1, (nb - n) / (t - na) AS p2 FROM j WHERE t > na AND t > nb),
l AS (SELECT *, -2 * (ln(greatest(p, 1e-10)) * n + ln(greatest(1 - p, 1e-10)) * (na - n) + ln(greatest(p, 1e-10)) * (nb - n) + ln(greatest(1 - p, 1e-10)) * (t - na - nb + n)
       - ln(greatest(p1, 1e-10)) * n - ln(greatest(1 - p1, 1e-10)) * (na - n) - ln(greatest(p2, 1e-10)) * (nb - n) - ln(greatest(1 - p2, 1e-10)) * (t - na - nb + n)) AS score FROM x),
k AS (SELECT * FROM l WHERE score > 30),
g AS (SELECT base, sum(n) AS gone FROM (SELECT fa AS base, n FROM k UNION ALL SELECT fb, n FROM k) GROUP BY 1),
o AS (SELECT c.base AS word, CAST(c.n - coalesce(gone, 0) AS BIGINT) AS count FROM c LEFT JOIN g USING (base) WHERE c.n - coalesce(gone, 0) > 0
      UNION ALL SELECT base, CAST(n AS BIGINT) FROM k)
SELECT word, count FROM o ORDER BY count DESC, word LIMIT 5000""")
def word_cloud(spark, d):
    """Word-cloud table with two-word collocations, plural and possessive
    forms merged and numbers dropped, top 5,000 by count."""
    return word_cloud_table(Tables(spark, d).documents, "text")


@query("format_labels", oracle="""
WITH c AS (SELECT c_mktsegment, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM customer GROUP BY 1)
SELECT c_mktsegment, printf('%.2f', pct) AS pct_label, CAST(trunc(pct) AS BIGINT) || '%' AS int_label,
       regexp_replace(printf('%.1f', pct), '\\.0$', '') AS short_label FROM c""")
def format_labels(spark, d):
    """Shares as labels: two decimals, whole per cent, three significant
    digits."""
    vc = A.value_counts(Tables(spark, d).customer, "c_mktsegment", "n", ordered=False)
    s = A.share_of_total(vc, "n", "pct", scale=100.0)
    return s.select("c_mktsegment", F.format_string("%.2f", "pct").alias("pct_label"),
                    F.concat(F.floor("pct").cast("string"), F.lit("%")).alias("int_label"),
                    T.significant("pct", 3).alias("short_label"))


# The words of which the generated part names are made.
_NAME_WORDS = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()


@query("multi_hot", oracle="""
WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part)
SELECT p_partkey, """ + ", ".join(f"CAST(count(*) FILTER (WHERE tag = '{w}') > 0 AS INTEGER) AS {w}" for w in _NAME_WORDS) + " FROM t GROUP BY p_partkey")
def multi_hot(spark, d):
    """List column -> 0/1 indicator per class.  Step 1 finds the classes
    (one aggregate; the result has a column for each), step 2 is a narrow
    projection."""
    p = Tables(spark, d).part.select("p_partkey", F.split("p_name", " ").alias("tags"))
    classes = sorted(x[0] for x in p.select(F.explode("tags").alias("t")).distinct().collect())
    return T.multi_hot(p, "tags", classes).drop("tags")


@query("doc_spans", oracle="""
WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
s AS (SELECT conv_id, turn, role,
             CAST(coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start,
             n FROM t)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY span_start) AS INTEGER) AS span_no,
       span_start, span_start + n AS span_end, role AS label,
       CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS n_spans
FROM s""")
def doc_spans(spark, d):
    """Per document the {start, end, label} spans of its turns
    laid end to end with a newline; flat form (span_no, n_spans)."""
    from loupe.operators.nested import spans_from_pieces
    c = Tables(spark, d).conversations
    s = stored(spans_from_pieces(c, "conv_id", "turn", "text", "role"), "spans")
    n = s.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n_spans"))
    s = s.join(n, "conv_id")
    return s.select("conv_id", F.col("piece_no").cast("int").alias("span_no"), F.col("start").alias("span_start"),
                    F.col("end").alias("span_end"), "label", "n_spans")


# ------------------------------------------------------------------ dates
@query("parse_dates", oracle="""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS date_text,
       CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS parsed FROM orders""")
def parse_dates(spark, d):
    """Dates read from text."""
    o = Tables(spark, d).orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("date_text"))
    return o.withColumn("parsed", D.parse_date("date_text", "dd/MM/yyyy"))


@query("date_parts", oracle="""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(day(o_orderdate) AS INTEGER) AS day, CAST(week(o_orderdate) AS INTEGER) AS week,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(dayofyear(o_orderdate) AS INTEGER) AS dayofyear
FROM orders""")
def date_parts(spark, d):
    """Parts of a date."""
    o = Tables(spark, d).orders
    return o.select("o_orderkey", *D.date_parts("o_orderdate"))


@query("month_name", oracle="SELECT o_orderkey, monthname(o_orderdate) AS month_name FROM orders")
def month_name(spark, d):
    """The month's name."""
    return Tables(spark, d).orders.select("o_orderkey", D.month_name("o_orderdate").alias("month_name"))


@query("week_period", oracle="""
SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start FROM orders""")
def week_period(spark, d):
    """The week that holds a date."""
    return Tables(spark, d).orders.select("o_orderkey", D.week_start("o_orderdate").alias("week_start"))


@query("ordered_category", oracle="""
SELECT monthname(o_orderdate) AS month_name, CAST(month(o_orderdate) AS INTEGER) AS month_pos, count(*) AS count
FROM orders GROUP BY 1, 2""")
def ordered_category(spark, d):
    """Month names with their calendar rank, counted and ordered by the rank."""
    o = Tables(spark, d).orders.select(D.month_name("o_orderdate").alias("month_name"))
    c = A.value_counts(o, "month_name")
    return c.select("month_name", D.calendar_rank("month_name").cast("int").alias("month_pos"), "count").orderBy("month_pos")


# ------------------------------------------------------------------- math
@query("round_even", oracle="""
SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) + 0.0 AS half_qty,
       round_even(l_discount * 10 + 0.25, 1) + 0.0 AS disc_tenths FROM lineitem""")
def round_even(spark, d):
    """Half-to-even rounding (0.5 -> 0, 1.5 -> 2, 2.5 -> 2)."""
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     M.round_half_even(F.col("l_quantity") / 2, 0).alias("half_qty"),
                     M.round_half_even(F.col("l_discount") * 10 + 0.25, 1).alias("disc_tenths"))


@query("log_transform", oracle="""
SELECT o_orderkey, round(ln(o_totalprice), 9) AS log_price,
       round(CASE WHEN o_totalprice - 100000 > 0 THEN ln(o_totalprice - 100000) END, 9) AS log_excess
FROM orders""")
def log_transform(spark, d):
    """Logarithms of a column."""
    o = Tables(spark, d).orders
    return o.select("o_orderkey", r(M.safe_log("o_totalprice"), 9).alias("log_price"),
                    r(M.safe_log(F.col("o_totalprice") - 100000), 9).alias("log_excess"))
