"""Tables of HTML pages as grids, from tags instead of patterns: nested tables, cells that nobody closes, comments, quoted
brackets in attributes, scripts, and cells that span rows and columns."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

CELL = StructType([StructField("text", StringType()), StructField("href", StringType()), StructField("head", BooleanType())])
ROW = StructType([StructField("table_no", IntegerType()), StructField("row_no", IntegerType()), StructField("cells", ArrayType(CELL))])
#: The most columns and rows that a cell may span, as browsers have it.
WIDEST, TALLEST = 1000, 65_534
SILENT = {"script", "style", "template"}


class Cell:
    def __init__(self, attrs: dict[str, str | None], head: bool) -> None:
        self.text: list[str] = []
        self.href: str | None = None
        self.head = head
        self.wide, self.tall = (self.span(attrs.get(k), most) for k, most in (("colspan", WIDEST), ("rowspan", TALLEST)))

    @staticmethod
    def span(told: str | None, most: int) -> int:
        """0 stands for all rows that are left."""
        told = (told or "").strip()
        return min(int(told), most) if told.isascii() and told.isdigit() else 1

    def shown(self) -> tuple[str, str | None, bool]:
        return "".join(self.text).strip(), self.href, self.head


class Tables(HTMLParser):
    """Reads a page from front to back. Of the tables that are open the innermost one gets rows, cells, links and text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[Cell]]] = []  # in the order in which they open
        self.stack: list[tuple[list[list[Cell]], list]] = []  # (rows, [the open row, the open cell])
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "table":
            self.tables.append([])
            self.stack.append((self.tables[-1], [None, None]))
        elif self.stack:
            rows, now = self.stack[-1]
            if tag == "tr":
                rows.append([])
                now[:] = [rows[-1], None]
            elif tag in ("td", "th"):
                if now[0] is None:  # a cell without a row opens one
                    rows.append([])
                    now[0] = rows[-1]
                now[1] = Cell(dict(attrs), tag == "th")  # and closes the cell before
                now[0].append(now[1])
            elif tag in ("thead", "tbody", "tfoot"):
                now[:] = [None, None]
            elif tag == "a" and now[1] is not None and now[1].href is None:
                now[1].href = dict(attrs).get("href")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.stack:
            now = self.stack[-1][1]
            if tag == "table":
                self.stack.pop()
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                now[:] = [None, None]
            elif tag in ("td", "th"):
                now[1] = None

    def handle_data(self, data: str) -> None:
        if self.stack and not self.silent and self.stack[-1][1][1] is not None:
            self.stack[-1][1][1].text.append(data)


def grid(rows: list[list[Cell]]) -> list[list[tuple[str, str | None, bool]]]:
    """Each row's cells by column; a cell that spans several stands in each. Places that no cell covers are empty."""
    out: list[dict[int, tuple]] = [{} for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for cell in row:
            while x in out[y]:
                x += 1
            own = cell.shown()
            for down in range(y, len(rows) if cell.tall == 0 else min(y + cell.tall, len(rows))):
                for right in range(x, x + max(1, cell.wide)):
                    out[down].setdefault(right, own)
            x += max(1, cell.wide)
    return [[r.get(i, ("", None, False)) for i in range(max(r, default=-1) + 1)] for r in out]


def tables_of(html: str | None) -> list[tuple[int, int, list]]:
    """(table, row, cells) of all tables of a page, in the order in which they open."""
    reader = Tables()
    reader.feed(html or "")
    reader.close()
    return [(t, y, cells) for t, rows in enumerate(reader.tables) for y, cells in enumerate(grid(rows))]


@F.pandas_udf(ArrayType(ROW))
def table_grids(html: pd.Series) -> pd.Series:
    """The rows of all tables of a page; none for null."""
    named = lambda cells: [dict(zip(("text", "href", "head"), c, strict=True)) for c in cells]
    return html.map(lambda page: [{"table_no": t, "row_no": y, "cells": named(cells)} for t, y, cells in tables_of(page)])
