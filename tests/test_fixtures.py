"""Edge-case fixtures (FIXTURES.md) with expected rows typed in by hand."""

import datetime as dt
import math

from pyspark.sql import functions as F

from loupe.functions import dates as D
from loupe.functions import text as T
from loupe.operators import aggregate as A
from loupe.operators import clean as C
from loupe.operators import profile as P
from loupe.operators import relate as R
from loupe.operators import series as S
from loupe.operators.nested import attach_spans, nest_spans


def test_nulls_profile_and_fill(spark):
    # f_nulls: nulls in every column, an all-null column, an all-null row
    df = spark.createDataFrame(
        [(1, "a", None, 1.0), (None, "a", None, None), (3, None, None, 3.0), (None, None, None, None)],
        "k int, s string, allnull string, x double")
    n = {r["column"]: r["nulls"] for r in P.null_counts(df).collect()}
    assert n == {"k": 2, "s": 2, "allnull": 4, "x": 2}
    h = {r["k"]: r["n"] for r in P.null_per_row_hist(df, df.columns).collect()}
    assert h == {1: 1, 3: 1, 2: 1, 4: 1}
    filled = C.fill_mode(df, ["s", "allnull"]).collect()
    assert [r["s"] for r in filled] == ["a", "a", "a", "a"]
    assert all(r["allnull"] is None for r in filled)
    assert C.drop_nulls(df.drop("allnull")).count() == 1
    assert [r["x"] for r in C.fill_mean(df, ["x"]).collect()] == [1.0, 2.0, 3.0, 2.0]


def test_mode_ties_pick_smallest(spark):
    # f_ties: two equally frequent values
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    assert C.mode_of(df, "v").first()[0] == "a"
    m = C.modes(spark.createDataFrame([(2, "y"), (1, "x"), (2, "x"), (1, "y")], "n int, s string"), ["n", "s"])
    assert {r["column"]: r["mode"] for r in m.collect()} == {"n": "1", "s": "x"}
    vc = A.value_counts(df, "v").collect()
    assert [(r["v"], r["count"]) for r in vc] == [("a", 2), ("b", 2), ("c", 1)]


def test_round_half_even(spark):
    # f_halves
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    got = [r[0] for r in df.select(F.bround("x", 0)).collect()]
    assert got == [0.0, 2.0, 2.0, -0.0]


def test_money_cleaning(spark):
    # f_money
    df = spark.createDataFrame([("$1,234.50",), ("1,000",), ("",), (None,), ("n/a",)], "t string")
    got = [r[0] for r in df.select(C.money_to_double("t")).collect()]
    assert got == [1234.5, 1000.0, None, None, None]


def test_durations(spark):
    # f_durations
    df = spark.createDataFrame([("90 min",), ("1 Season",), ("12 Seasons",)], "d string")
    m, s = T.parse_duration("d")
    assert [tuple(r) for r in df.select(m, s).collect()] == [(90, 0), (0, 1), (0, 12)]


def test_multi_valued(spark):
    # f_multi: 'a, b', 'a ,b', 'a,b', 'a', null
    df = spark.createDataFrame([("a, b",), ("a ,b",), ("a,b",), ("a",), (None,)], "v string")
    lists = [r[0] for r in df.select(T.split_list("v")).collect()]
    assert lists[:4] == [["a", "b"]] * 3 + [["a"]]
    assert lists[4] is None
    mh = T.multi_hot(df.select(T.split_list("v").alias("l")).where("l is not null"), "l", ["a", "b"])
    assert [(r["a"], r["b"]) for r in mh.collect()] == [(1, 1), (1, 1), (1, 1), (1, 0)]


def test_text_tokens_and_counts(spark):
    # f_text: empty, double blanks, tabs, case, apostrophes, stop words only
    df = spark.createDataFrame([("",), ("a  b",), ("x\ty z ",), ("Don't STOP",), ("the and of",)], "t string")
    assert [r[0] for r in df.select(T.word_count("t")).collect()] == [0, 2, 3, 2, 3]
    toks = [r[0] for r in df.select(T.tokens("t")).collect()]
    assert toks[3] == ["don't", "stop"]
    assert toks[1] == []  # single letters are not words under the \\w[\\w']+ rule
    words = df.select(F.explode(T.tokens("t")).alias("word")).join(T.stop_words_df(spark), "word", "left_anti")
    assert sorted(r[0] for r in words.collect()) == ["stop"]


def test_calendar_parts(spark):
    # f_calendar: ISO week 53 -> 1 at a year boundary, leap day, weekday Monday=0
    df = spark.createDataFrame([(dt.date(2020, 12, 31),), (dt.date(2021, 1, 3),), (dt.date(2021, 1, 4),),
                                (dt.date(2020, 2, 29),)], "d date")
    rows = df.select(*D.date_parts("d"), D.month_name("d").alias("mn"), D.week_end_sunday("d").alias("sun")).collect()
    assert [(r["week"], r["weekday"]) for r in rows] == [(53, 3), (53, 6), (1, 0), (9, 5)]
    assert rows[3]["dayofyear"] == 60 and rows[3]["mn"] == "February"
    assert rows[0]["sun"] == dt.date(2021, 1, 3) and rows[2]["sun"] == dt.date(2021, 1, 10)


def test_resample_weekly_and_pad(spark):
    # missing weekdays, a missing whole week, two rows on one date
    d = [(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 1), 3.0), (dt.date(2024, 1, 3), 5.0),
         (dt.date(2024, 1, 22), 7.0)]
    df = spark.createDataFrame(d, "ds date, y double")
    w = {r["week"]: r["y"] for r in S.resample_weekly(df, "ds", "y").collect()}
    assert w == {dt.date(2024, 1, 7): 3.0, dt.date(2024, 1, 14): None, dt.date(2024, 1, 21): None,
                 dt.date(2024, 1, 28): 7.0}
    daily = df.groupBy("ds").agg(F.sum("y").alias("y"))
    p = {r["ds"]: (r["present"], r["y"]) for r in S.asfreq_pad(daily, "ds", ["y"]).collect()}
    assert len(p) == 22
    assert p[dt.date(2024, 1, 2)] == (False, 4.0)
    assert p[dt.date(2024, 1, 21)] == (False, 5.0)
    assert p[dt.date(2024, 1, 22)] == (True, 7.0)


def test_asfreq_keeps_existing_nulls(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 2), None),
                                (dt.date(2024, 1, 4), 2.0)], "ds date, y double")
    p = {r["ds"]: r["y"] for r in S.asfreq_pad(df, "ds", ["y"]).collect()}
    assert p[dt.date(2024, 1, 2)] is None and p[dt.date(2024, 1, 3)] is None


def test_short_series_rolling(spark):
    # f_short_series: 0, 1, 11, 12, 13 points; constant series; a null in the middle
    for n in (0, 1, 11, 12, 13):
        df = spark.createDataFrame([(i, float(i)) for i in range(n)], "t int, y double")
        r = S.rolling(df, "y", "t", 12, stats=("mean", "std")).orderBy("t").collect()
        full = [x for x in r if x["y_roll12_mean"] is not None]
        assert len(full) == max(0, n - 11)
        if n >= 12:
            assert full[0]["y_roll12_mean"] == 5.5
    const = spark.createDataFrame([(i, 2.0) for i in range(12)], "t int, y double")
    assert S.rolling(const, "y", "t", 12, stats=("std",)).orderBy("t").collect()[-1]["y_roll12_std"] == 0.0
    gap = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "t int, y double")
    r = S.rolling(gap, "y", "t", 3, min_periods=1).orderBy("t").collect()
    assert [x["y_roll3_mean"] for x in r] == [1.0, 1.0, 2.0]
    ident = S.rolling(gap, "y", "t", 1, min_periods=1).orderBy("t").collect()
    assert [x["y_roll1_mean"] for x in ident] == [1.0, None, 3.0]


def test_centered_window_bounds(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "t int, y double")
    r = S.rolling(df, "y", "t", 5, min_periods=1, centered=True).orderBy("t").collect()
    assert [x["y_roll5_mean"] for x in r] == [1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 6.5, 7.0]
    r4 = S.rolling(df, "y", "t", 4, min_periods=4, centered=True).orderBy("t").collect()
    # pandas centres an even window on [i-2, i+1]
    assert [x["y_roll4_mean"] for x in r4][:3] == [None, None, 1.5]


def test_joins_null_keys_and_missing(spark):
    # f_keys: dimension keys without facts, facts without dimension, null keys, duplicate dim keys
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2"), (None, "n")], "k int, name string")
    facts = spark.createDataFrame([(1, 10.0), (3, 30.0), (None, 99.0)], "k int, v double")
    left = R.join_on(dim, facts, "k", "left").collect()
    assert sorted((r["name"], r["v"]) for r in left) == [("a", 10.0), ("b", None), ("b2", None), ("n", None)]
    ns = R.join_on(dim, facts, "k", "left", null_safe=True).collect()
    assert ("n", 99.0) in [(r["name"], r["v"]) for r in ns]
    cc = R.conditional_counts_by_dim(dim, facts, "k", {"big": F.col("v") > 5}).collect()
    assert sorted((r["k"], r["big"]) for r in cc if r["k"] is not None) == [(1, 1), (2, 0)]
    al = {r["nationkey"]: r["value"] for r in R.align_arith(
        spark.createDataFrame([(1, 1), (2, 2)], "nationkey int, a int"),
        spark.createDataFrame([(2, 5), (3, 7)], "nationkey int, b int"), "nationkey", "a", "b").collect()}
    assert al == {1: None, 2: 7, 3: None}


def test_categories_order_and_stacking(spark):
    # f_categories: labels out of list order, a missing label
    counts = spark.createDataFrame([(2000, "B", 2), (2000, "A", 1), (2001, "A", 4)], "year int, cat string, n bigint")
    st = {(r["year"], r["cat"]): r["stacked"] for r in S.stacked_cumsum(counts, "year", "cat", "n", ["A", "B"]).collect()}
    assert st == {(2000, "A"): 1, (2000, "B"): 3, (2001, "A"): 4, (2001, "B"): 4}
    lab = R.select_labels(spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), "k", ["y", "zz", "x"])
    assert [(r["k"], r["label_pos"]) for r in lab.orderBy("label_pos").collect()] == [("y", 0), ("x", 2)]
    mon = spark.createDataFrame([("March",), ("January",)], "m string")
    assert [r[0] for r in mon.select(D.calendar_rank("m")).collect()] == [3, 1]


def test_holiday_precedence(spark):
    # f_holidays: National OR (Regional AND Holiday)
    df = spark.createDataFrame([("National", "Holiday"), ("Regional", "Holiday"), ("Regional", "Event"),
                                ("Local", "Holiday")], "locale string, type string")
    keep = df.where((F.col("locale") == "National") | ((F.col("locale") == "Regional") & (F.col("type") == "Holiday")))
    assert sorted(tuple(r) for r in keep.collect()) == [("National", "Holiday"), ("Regional", "Holiday")]


def test_spans(spark):
    # f_spans: pieces laid end to end; a text without spans keeps an empty list
    pieces = spark.createDataFrame([(1, 0, "abc", "user"), (1, 1, "de", "bot"), (2, 0, "x", "user")],
                                   "doc int, turn int, text string, role string")
    sp = nest_spans(pieces, "doc", "turn", "text", "role")
    got = {r["doc"]: [(s["start"], s["end"], s["label"]) for s in r["spans"]] for r in sp.collect()}
    assert got == {1: [(0, 3, "user"), (4, 6, "bot")], 2: [(0, 1, "user")]}
    texts = spark.createDataFrame([(1, "abc\nde"), (3, "none")], "doc int, text string")
    at = {r["doc"]: r["spans"] for r in attach_spans(texts, sp, "doc").collect()}
    assert at[3] == [] and len(at[1]) == 2


def test_html_tables(spark):
    # f_html: two tables with the match in the second; missing cells; entities; no table
    from loupe.sources.html import first_matching_table, tables
    page = ("<html><table><tr><td>x</td></tr></table>"
            "<table><tr><th>Date</th><th>Revenue &amp; more</th></tr>"
            "<tr><td>2020-01-01</td><td>$1,000</td></tr><tr><td>2020-02-01</td><td></td></tr></table></html>")
    df = spark.createDataFrame([(1, page), (2, "<p>no table</p>")], "id int, html string")
    t = tables(df, "id", "html").collect()
    assert len(t) == 4 and {r["id"] for r in t} == {1}
    m = first_matching_table(df, "id", "html", "Revenue").orderBy("row_no").collect()
    assert [r["cells"] for r in m] == [["Date", "Revenue & more"], ["2020-01-01", "$1,000"], ["2020-02-01", ""]]
    assert m[0]["table_no"] == 2


def test_latin1_csv(spark, tmp_path):
    # f_latin1: accented names in ISO-8859-1
    from loupe.sources.files import read_csv
    p = tmp_path / "latin1.csv"
    p.write_bytes("name,city\nJosé,Zürich\nFrançois,Malmö\n".encode("latin-1"))
    rows = read_csv(spark, str(p), "name string, city string", encoding="ISO-8859-1").collect()
    assert [(r[0], r[1]) for r in rows] == [("José", "Zürich"), ("François", "Malmö")]


def test_wholetext_files(spark, tmp_path):
    from loupe.sources.files import file_inventory, read_texts
    for i, body in ((1, "hello\nworld"), (2, "x")):
        d = tmp_path / f"id={i}"
        d.mkdir()
        (d / "part.txt").write_text(body + "\n")
    got = {r["id"]: r["text"] for r in read_texts(spark, str(tmp_path), "id").collect()}
    assert got == {1: "hello\nworld", 2: "x"}
    inv = file_inventory(spark, str(tmp_path)).collect()
    assert len(inv) == 2 and all(r["file_name"] == "part.txt" for r in inv)


def test_money_and_dates_parse(spark):
    df = spark.createDataFrame([("September 24, 2021",), ("bad",)], "t string")
    got = [r[0] for r in df.select(D.parse_date("t", "MMMM d, yyyy")).collect()]
    assert got == [dt.date(2021, 9, 24), None]


def test_describe_matches_numpy(spark):
    import numpy as np
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = P.describe_numeric(df, ["x"]).first()
    a = np.array([v for v in vals if v is not None])
    assert r["count"] == 5 and math.isclose(r["mean"], a.mean()) and math.isclose(r["std"], a.std(ddof=1))
    assert [r["p25"], r["p50"], r["p75"]] == list(np.percentile(a, [25, 50, 75]))


def test_skew_safe_left_join_equals_left_join(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (4, "d")], "k int, name string")
    facts = spark.createDataFrame([(1, 10.0), (1, 11.0), (3, 30.0), (None, 9.0)], "k int, v double")
    a = sorted(map(tuple, R.join_on(dim, facts, "k", "left").collect()), key=repr)
    b = sorted(map(tuple, R.left_join_skew_safe(dim, facts, "k").select("k", "name", "v").collect()), key=repr)
    assert a == b


def test_mode_ties_numeric_order_and_mean_fill_of_ints(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,), (None,)], "n int")
    assert C.modes(df, ["n"]).first()["mode"] == "9"
    assert [r[0] for r in C.impute_mode_all(df, ["n"]).collect()][-1] == 9
    f = C.fill_mean(spark.createDataFrame([(1,), (2,), (None,)], "n int"), ["n"])
    assert [r[0] for r in f.collect()] == [1.0, 2.0, 1.5]


def test_null_group_keys_dropped_and_nulls_sort_last(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", None), ("b", 3.0)], "k string, v double")
    vc = {r["k"]: r["count"] for r in A.value_counts(df, "k").collect()}
    assert vc == {"a": 2, "b": 1}
    gc = {r["k"]: r["count"] for r in A.group_count(df, "k", "v").collect()}
    assert gc == {"a": 1, "b": 1}  # count of non-null v; the null key group is dropped
    desc = [r["v"] for r in df.orderBy(F.col("v").desc_nulls_last()).collect()]
    asc = [r["v"] for r in df.orderBy(F.col("v").asc_nulls_last()).collect()]
    assert desc[-1] is None and asc[-1] is None


def test_sample_vs_population_std(spark):
    import numpy as np
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    z = [r["x"] for r in C.standardize(df, ["x"]).orderBy("x").collect()]
    a = np.array([1, 2, 3, 4.0])
    assert np.allclose(z, (a - a.mean()) / a.std(ddof=0))
    r = S.rolling(spark.createDataFrame([(i, float(i)) for i in range(4)], "t int, y double"), "y", "t", 4,
                  stats=("std",)).orderBy("t").collect()[-1]
    assert math.isclose(r["y_roll4_std"], np.std([0, 1, 2, 3], ddof=1))


def test_recode_by_table_and_literal_map(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string")
    m = spark.createDataFrame([("a", "X"), ("b", "X")], "from string, to string")
    assert [r[0] for r in C.recode_by_table(df, "v", m).orderBy(F.col("v").asc_nulls_last()).collect()] == \
        ["X", "X", "c", None]
    assert [r[0] for r in df.select(C.recode("v", {"a": "X", "b": "X"})).collect()] == ["X", "X", "c", None]


def test_sketch_switches(spark):
    import numpy as np
    vals = list(range(1, 1001))
    df = spark.createDataFrame([(float(v), v % 37) for v in vals], "x double, k int")
    ex = {r["column"]: r for r in P.describe_numeric(df, ["x"]).collect()}["x"]
    ap = {r["column"]: r for r in P.describe_numeric(df, ["x"], exact=False).collect()}["x"]
    assert ex["p50"] == float(np.percentile(vals, 50))
    assert abs(ap["p50"] - ex["p50"]) <= 2 and ap["count"] == ex["count"] and ap["mean"] == ex["mean"]
    nu = {r["column"]: r["nunique"] for r in P.nunique(df, exact=False).collect()}
    assert abs(nu["x"] - 1000) < 80 and nu["k"] == 37


def test_single_file_csv(spark, tmp_path):
    from loupe.sources.files import read_csv, write_csv
    df = spark.range(0, 100, 1, 4).select(F.col("id").cast("int").alias("id"))
    write_csv(df, str(tmp_path / "out"), single_file=True)
    parts = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert len(parts) == 1
    back = read_csv(spark, str(tmp_path / "out"), "id int")
    assert sorted(r[0] for r in back.collect()) == list(range(100))
