"""Tables, lists and links of stored web pages (SRC6).

One structure parser (on the standard library's tokenizer) reads a page once:
tables become rows of cell texts with row and column spans filled in, lists
become tables of one cell a row, links keep their target and text.  It runs
in ``mapInArrow``, a page at a time; keys pass through unchanged."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: the widest and longest span of a cell,
# elements whose text is not shown.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
UNSEEN = {"script", "style", "template", "noscript"}
PARTS = {"thead", "tbody", "tfoot"}


class _Grid:
    """One open table or list."""

    def __init__(self, kind: str):
        self.kind, self.rows, self.heads = kind, [], []
        self.row: list | None = None  # (text, is header cell, columns, rows) of the open row
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.head_cell = False
        self.part = ""
        self.over: dict[int, list] = {}  # column -> [text, rows still to fill]

    def end_cell(self) -> None:
        if self.cell is not None:
            self.row.append((" ".join("".join(self.cell).split()), self.head_cell, *self.spans))
            self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.row is None:
            return
        out, at = [], 0

        def carried() -> None:
            nonlocal at
            while at in self.over:
                text, left = self.over[at]
                out.append(text)
                if left == 1:
                    del self.over[at]
                else:
                    self.over[at][1] = left - 1
                at += 1
        for text, _, wide, long in self.row:
            carried()
            for _ in range(wide):
                out.append(text)
                if long > 1:
                    self.over[at] = [text, long - 1]
                at += 1
        carried()
        self.rows.append(out)
        self.heads.append(self.part == "thead" or bool(self.row) and all(c[1] for c in self.row))
        self.row = None

    def end_part(self) -> None:
        self.end_row()
        self.over, self.part = {}, ""


class _Found(Exception):
    pass


def _span(value: str | None, most: int) -> int:
    digits = re.match(r"\s*(\d+)", value or "")
    return min(int(digits[1]), most) if digits else 1


class PageParser(HTMLParser):
    """Tables and lists of a page in the order they open, and its links.

    With ``match``, parsing ends at the end of the first table whose text the
    pattern is found in."""

    def __init__(self, match: re.Pattern | None = None, kinds: tuple[str, ...] = ("table", "list")):
        super().__init__(convert_charrefs=True)
        self.match, self.kinds = match, kinds
        self.grids: list[_Grid] = []
        self.links: list[tuple[str, str]] = []
        self._open: list[_Grid] = []
        self._link: tuple[str, list[str]] | None = None
        self._unseen = 0

    def _start(self, kind: str) -> None:
        g = _Grid(kind)
        self.grids.append(g)
        self._open.append(g)

    def _end(self) -> None:
        g = self._open.pop()
        g.end_part()
        # a table inside another ends first, but the outer one opened before it
        if self.match and g.kind in self.kinds and not any(o.kind in self.kinds for o in self._open) and any(
                self.match.search(c) for row in g.rows for c in row):
            raise _Found

    def _inside(self, kind: str) -> _Grid | None:
        return self._open[-1] if self._open and self._open[-1].kind == kind else None

    def _end_link(self) -> None:
        if self._link:
            self.links.append((self._link[0], " ".join("".join(self._link[1]).split())))
            self._link = None

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self._unseen += 1
        elif tag in ("table", "ul", "ol"):
            self._start("table" if tag == "table" else "list")
        elif tag == "li" and (g := self._inside("list")):
            g.end_row()
            g.row, g.cell, g.spans, g.head_cell = [], [], (1, 1), False
        elif tag in PARTS and (g := self._inside("table")):
            g.end_part()
            g.part = tag
        elif tag == "tr" and (g := self._inside("table")):
            g.end_row()
            g.row = []
        elif tag in ("td", "th") and (g := self._inside("table")):
            g.end_cell()
            a = dict(attrs)
            long = _span(a.get("rowspan"), MAX_ROWSPAN)
            g.row = [] if g.row is None else g.row
            g.cell, g.head_cell = [], tag == "th"
            # 0 rows: to the end of the table's part
            g.spans = (max(1, _span(a.get("colspan"), MAX_COLSPAN)), long or MAX_ROWSPAN)
        elif tag == "a":
            self._end_link()
            if (href := dict(attrs).get("href")) is not None:
                self._link = (href, [])
        elif tag in ("br", "p", "div"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self._unseen = max(0, self._unseen - 1)
        elif tag == "a":
            self._end_link()
        elif tag in ("table", "ul", "ol"):
            kind = "table" if tag == "table" else "list"
            if any(g.kind == kind for g in self._open):
                while self._open[-1].kind != kind:
                    self._end()
                self._end()
        elif tag in ("td", "th") and (g := self._inside("table")):
            g.end_cell()
        elif tag == "tr" and (g := self._inside("table")) or tag == "li" and (g := self._inside("list")):
            g.end_row()
        elif tag in PARTS and (g := self._inside("table")):
            g.end_part()

    def handle_data(self, data):
        if self._unseen:
            return
        if self._link:
            self._link[1].append(data)
        for g in reversed(self._open):  # a list's text is text of the cell around it, an inner table's is not
            if g.cell is not None:
                g.cell.append(data)
            if g.kind == "table":
                break

    def parse(self, html: str | None) -> PageParser:
        try:
            self.feed(html or "")
            self.close()
            while self._open:  # tables that the page never closes
                self._end()
        except _Found:
            pass
        self._end_link()
        return self


def parse_tables(html: str | None, kinds: tuple[str, ...] = ("table",)) -> list[list[list[str]]]:
    return [g.rows for g in PageParser().parse(html).grids if g.kind in kinds]


def _per_page(df: DataFrame, key: str, html: str, fields: str, rows: Callable[[str | None], Iterator[tuple]]) -> DataFrame:
    """Rows made of each page, with its key passed through as it is."""
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages, out = [], []
            for i, h in enumerate(b.column(1)):
                made = list(rows(h.as_py()))
                pages += [i] * len(made)
                out += made
            cols = [pa.array([r[j] for r in out], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pages, pa.int64())), *cols], [key, *names])
    return df.select(key, html).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {fields}")


def anchors(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, link_no, href, text) for every link of each page."""
    def links(h):
        return ((i, *link) for i, link in enumerate(PageParser().parse(h).links, start=1))
    return _per_page(df, key, html, "link_no int, href string, text string", links)


TABLE_ROWS = "table_no int, row_no int, header boolean, cells array<string>"


def tables(df: DataFrame, key: str, html: str, match: str | None = None, kinds: tuple[str, ...] = ("table",)) -> DataFrame:
    """Long form (key, table_no, row_no, header, cells) of the pages' tables
    (``kinds``: "table", "list"), numbered in the order they open.  ``match``
    is a pattern: only tables with a cell in which it is found.  ``header``
    marks rows of ``thead`` and rows of ``th`` cells alone.  Null pages and
    pages without tables have no rows."""
    pattern = re.compile(match) if match else None

    def rows(h):
        grids = [g for g in PageParser().parse(h).grids if g.kind in kinds]
        for n, g in enumerate(grids, start=1):
            if pattern is None or any(pattern.search(c) for row in g.rows for c in row):
                for k, (row, head) in enumerate(zip(g.rows, g.heads), start=1):
                    yield n, k, head, row
    return _per_page(df, key, html, TABLE_ROWS, rows)


def first_matching_table(df: DataFrame, key: str, html: str, match: str, kinds: tuple[str, ...] = ("table",)) -> DataFrame:
    """Rows of each page's first table with a cell in which the pattern
    ``match`` is found; the parser stops there."""
    pattern = re.compile(match)

    def rows(h):
        grids = [g for g in PageParser(pattern, kinds).parse(h).grids if g.kind in kinds]
        for n, g in enumerate(grids, start=1):
            if any(pattern.search(c) for row in g.rows for c in row):
                for k, (row, head) in enumerate(zip(g.rows, g.heads), start=1):
                    yield n, k, head, row
                return
    return _per_page(df, key, html, TABLE_ROWS, rows)


def list_items(df: DataFrame, key: str, html: str) -> DataFrame:
    """Every list item of each page as (key, list_no, item_no, text)."""
    t = tables(df, key, html, kinds=("list",))
    return t.select(key, F.col("table_no").alias("list_no"), F.col("row_no").alias("item_no"), F.col("cells")[0].alias("text"))
