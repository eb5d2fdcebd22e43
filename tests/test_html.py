"""The structure parser of web pages."""

from loupe.sources import html as H


def test_spans_are_filled_in():
    page = """<table><thead><tr><th colspan=2>a</th><th rowspan="2">b</th></tr><tr><th>c</th><th>d</th></tr></thead>
    <tbody><tr><td rowspan=0>1</td><td>2</td><td>3</td></tr><tr><td colspan="2">4</td></tr><tr><td>5</td></tr></tbody>
    <tr><td>6</td><td>7<td colspan=x>8</table>"""
    g = H.PageParser().parse(page).grids[0]
    assert g.rows == [["a", "a", "b"], ["c", "d", "b"], ["1", "2", "3"], ["1", "4", "4"], ["1", "5"], ["6", "7", "8"]]
    assert g.heads == [True, True, False, False, False, False]


def test_lists_and_nesting():
    page = "<ul><li>one<li>two <b>bold</b><ol><li>in</li></ol></li></ul><table><tr><td>x<ul><li>y</li></ul>z<table><tr><td>deep</td></tr></table></td></tr></table>"
    grids = H.PageParser().parse(page).grids
    assert [(g.kind, g.rows) for g in grids] == [
        ("list", [["one"], ["two boldin"]]), ("list", [["in"]]), ("table", [["xyz"]]), ("list", [["y"]]), ("table", [["deep"]])]


def test_unseen_text_and_broken_pages():
    page = "<TABLE><TR><TD>a<script>var t='</td>';</script><style>x</style>b&nbsp;&amp;<br>c<TD>d"
    assert H.parse_tables(page) == [[["ab & c", "d"]]]
    assert H.parse_tables(None) == H.parse_tables("") == H.parse_tables("</table><td>no</td></tr>") == []
    assert H.parse_tables("<table></table>") == [[]] and H.parse_tables("<table><tr></tr></table>") == [[[]]]


def test_links(spark):
    page = """<A HREF='/x?a=1&amp;b=2'>One <b>bold</b></a><a name=n>no</a><a href=/bare>two<a href="/three">three"""
    rows = [(2**53 + 1, page), (None, "<a href=''>e</a>"), (3, None)]
    got = H.anchors(spark.createDataFrame(rows, "id long, html string").coalesce(1), "id", "html").collect()
    assert [tuple(r) for r in got] == [(2**53 + 1, 1, "/x?a=1&b=2", "One bold"), (2**53 + 1, 2, "/bare", "two"), (2**53 + 1, 3, "/three", "three"), (None, 1, "", "e")]


def test_first_match_is_a_pattern_and_stops_there(spark):
    page = ("<ul><li>Sales 2020</li></ul><table><tr><td>x</td></tr></table><table><tr><th>Sales 2020 &amp; more</th></tr><tr><td>1</td></tr></table>"
            "<table><tr><td>Sales 2021</td></tr></table><table><tr><td>never closed")
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id int, html string")
    got = H.first_matching_table(df, "id", "html", r"Sales \d+").collect()
    assert [(r.id, r.table_no, r.row_no, r.header, r.cells) for r in got] == [(1, 2, 1, True, ["Sales 2020 & more"]), (1, 2, 2, False, ["1"])]
    import re
    assert len(H.PageParser(re.compile(r"Sales \d+"), ("table",)).parse(page).grids) == 3  # the list, and two tables
    both = H.tables(df, "id", "html", r"Sales", ("table", "list")).select("table_no").distinct().collect()
    assert sorted(r.table_no for r in both) == [1, 3, 4]
    outer = "<table><tr><td>Sales<table><tr><td>Sales in</td></tr></table></td></tr></table>"
    one = H.first_matching_table(spark.createDataFrame([(1, outer)], "id int, html string"), "id", "html", "Sales").collect()
    assert [(r.table_no, r.cells) for r in one] == [(1, ["Sales"])]
