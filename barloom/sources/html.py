"""Tables in HTML pages, as rows: pages are parsed side by side, a batch at a time."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Tables(HTMLParser):
    """Collects the rows of every table, each cell as [text, columns, rows]; a table inside a cell is a table of its own.

    A row group's rows are told apart from the next one's, since no cell reaches beyond its group.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.cell, self.hidden = [], [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag == "table":
            self.tables.append([[]])
            self.open.append((self.tables[-1], self.cell))
            self.cell = None
        elif tag in ("thead", "tbody", "tfoot") and self.open:
            self.open[-1][0].append([])
            self.cell = None
        elif tag == "tr" and self.open:
            self.open[-1][0][-1].append([])
            self.cell = None
        elif tag in ("td", "th") and self.open:
            rows = self.open[-1][0][-1]
            rows or rows.append([])
            self.cell = ["", _span(attrs, "colspan", 1, MOST_COLUMNS), _span(attrs, "rowspan", 0, MOST_ROWS)]
            rows[-1].append(self.cell)
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.open:
            self.cell = self.open.pop()[1]
        elif tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            self.cell = None

    def handle_data(self, data):
        if self.cell and not self.hidden:
            self.cell[0] += data


def _span(attrs: list, name: str, least: int, most: int) -> int:
    """The number an attribute begins with, within bounds; 1 where it has none."""
    m = re.match(r"\s*\+?([0-9]{1,9})", dict(attrs).get(name) or "")
    return min(max(int(m[1]), least), most) if m else 1


def grid(rows: list[list]) -> list[list[str]]:
    """The cells of a row group at their places: a cell is repeated in all columns and rows that it spans, and pushes later
    ones to the next free column. No rows (0) means down to the end of the group."""
    out: list[list[str]] = [[] for _ in rows]
    taken: list[dict[int, str]] = [{} for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for text, columns, down in row:
            while x in taken[y]:
                x += 1
            last = len(rows) if down == 0 else min(len(rows), y + down)
            clean = re.sub(r"\s+", " ", text).strip()
            for below in range(y, last):
                for c in range(x, x + columns):
                    taken[below].setdefault(c, clean)
            x += columns
        held = taken[y]
        out[y] = [held.get(c, "") for c in range(max(held) + 1)] if held else []
        taken[y] = {}
    return out


def tables_of(html: str | None) -> list[list[list[str]]]:
    """Tables of a page as rows of cells, with the cells that span several places in each of them; rows without cells go."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [[row for group in t for row in grid(group) if row] for t in parser.tables]


def tables(html: Column) -> Column:
    """Tables of a page, each a list of rows of cells; a null page has none."""

    @F.arrow_udf("array<array<array<string>>>")
    def parse(pages: pa.Array) -> pa.Array:
        return pa.array([tables_of(p) for p in pages.to_pylist()], pa.list_(pa.list_(pa.list_(pa.string()))))

    return parse(html)


def scan(pages: DataFrame, key: str, html: str, wanted: list[tuple[str, ...]], position: str | None = None) -> DataFrame:
    """key and a column for each wanted one, from the first table of each page whose header has them all; with the row's
    place in the table as column `position`, if a name is given.

    A wanted column is a tuple of the names it may have; it gets the first of them as its name. The header is a table's
    first row. Pages without such a table give no rows; rows that are too short have nulls.
    """
    has = lambda head: F.forall(F.array(*(F.array(*(F.lit(n) for n in names)) for names in wanted)), lambda names: F.arrays_overlap(names, head))
    fitting = F.filter(tables(F.col(html)), lambda t: has(F.coalesce(F.get(t, F.lit(0)), F.array().cast("array<string>"))))
    rows = pages.select(F.col(key), F.get(fitting, F.lit(0)).alias("barloom_table")).where("barloom_table is not null")
    rows = rows.select(key, F.get("barloom_table", F.lit(0)).alias("barloom_head"), F.posexplode(F.slice("barloom_table", F.lit(2), F.size("barloom_table"))).alias("barloom_place", "barloom_row"))
    place = lambda names: F.coalesce(*(F.nullif(F.array_position("barloom_head", F.lit(n)), F.lit(0)) for n in names))
    at = [F.col("barloom_place").alias(position)] if position else []
    return rows.select(key, *at, *(F.get("barloom_row", (place(names) - 1).cast("int")).alias(names[0]) for names in wanted))
