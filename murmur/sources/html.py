"""Tables in landed web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
# Fixed value: rows of a stock screen, its header among them, are set off by this attribute.
SCREEN_ROW = ("valign", "top")
CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"
TAG = r"(?s)<[^>]*>"

# The character references that screens use in names.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def cell_text(markup: Column) -> Column:
    out = F.regexp_replace(markup, TAG, "")
    for reference, plain in REFERENCES.items():
        out = F.replace(out, F.lit(reference), F.lit(plain))
    return out


def row_with(attribute: str, value: str) -> str:
    """The pattern of table rows that carry an attribute, whatever table they stand in."""
    quoted = rf"""["']?{value}["']?(?=[\s>/])"""
    return rf"(?is)<tr\b(?=[^>]*\s{attribute}\s*=\s*{quoted})[^>]*>(.*?)</tr>"


def html_rows(pages: DataFrame, html: Column, row: str = ROW, cell: str = CELL) -> DataFrame:
    """One record per table row: the page's columns, ``row_no`` and ``cells``.

    Takes well-formed rows, in JVM expressions only.
    """
    marked = pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(row), F.lit(1))).alias("row_no", "_row"))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(cell), F.lit(1)), cell_text)
    return marked.withColumn("cells", cells).drop("_row")


class _TableReader(HTMLParser):
    """Rows of cells, with the end tags a browser would supply."""

    def __init__(self, attribute: tuple[str, str] | None) -> None:
        super().__init__(convert_charrefs=True)
        self.attribute = attribute
        self.rows: list[list[str]] = []
        self.open_row = attribute is None
        self.open_cell = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.open_cell = False
            name, value = self.attribute or (None, None)
            self.open_row = name is None or (dict(attrs).get(name) or "").lower() == value
            if self.open_row:
                self.rows.append([])
        elif tag in ("td", "th") and self.open_row:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
            self.open_cell = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.open_cell = False

    def handle_data(self, data):
        if self.open_cell:
            self.rows[-1][-1] += data


def html_rows_lenient(pages: DataFrame, page_id: str, html: str, attribute: tuple[str, str] | None = None) -> DataFrame:
    """As ``html_rows`` for pages whose rows or cells are not closed.

    ``attribute`` keeps the rows that carry it, as ``row_with`` does.
    """
    id_type = pages.schema[page_id].dataType
    schema = T.StructType(
        [
            T.StructField(page_id, id_type),
            T.StructField("row_no", T.IntegerType()),
            T.StructField("cells", T.ArrayType(T.StringType())),
        ]
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = []
            for key, markup in zip(batch[page_id], batch[html]):
                reader = _TableReader(attribute)
                reader.feed(markup or "")
                reader.close()
                records += [(key, number, cells) for number, cells in enumerate(reader.rows)]
            yield pd.DataFrame(records, columns=[page_id, "row_no", "cells"])

    return pages.select(page_id, html).mapInPandas(read, schema)


def screener_rows(pages: DataFrame, page_id: str, html: str = "html", *, closed: bool = True) -> DataFrame:
    """Rows of a stock screen: second cell ticker, third company.

    They are the rows aligned to the top, in any table of the page, but for the
    first of them, the header. ``closed=False`` reads pages that leave end tags
    out; on other pages it gives the same rows.
    """
    if closed:
        rows = html_rows(pages.select(page_id, html), F.col(html), row_with(*SCREEN_ROW))
    else:
        rows = html_rows_lenient(pages, page_id, html, SCREEN_ROW)
    company = F.trim(F.get("cells", F.lit(2)), F.lit("\n"))
    rows = rows.where(F.col("row_no") > 0).withColumns({"ticker": F.get("cells", F.lit(1)), "company": company})
    return rows.select(page_id, "row_no", "ticker", "company")


def first_cell_after_label(pages: DataFrame, html: Column, out: str, table: str | None = None) -> DataFrame:
    """Add the second cell of the first row of a table: the first table, or the first whose tag has ``table`` in it.

    A statistics page shows the market cap there.
    """
    tag = rf"<table\b[^>]*{table}[^>]*>" if table else r"<table\b[^>]*>"
    row = F.regexp_extract(F.regexp_extract(html, rf"(?is){tag}.*?</table>", 0), ROW, 1)
    return pages.withColumn(out, cell_text(F.get(F.regexp_extract_all(row, F.lit(CELL), F.lit(1)), F.lit(1))))


def index_members(rows: DataFrame) -> DataFrame:
    """Tickers of an index page: first cell of every row but the header."""
    ticker = F.replace(F.get("cells", F.lit(0)), F.lit("\n"), F.lit(""))
    return rows.where(F.col("row_no") > 0).withColumn("ticker", ticker).drop("cells")
