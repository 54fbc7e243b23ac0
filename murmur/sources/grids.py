"""Tables of web pages as grids: chosen by class, nested ones apart, spans filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.html import cell_text

_TOKEN = r"(?s)<!--.*?-->|<[^>]*>|[^<]+|<"
_NAME = r"(?s)^<\s*(/?)\s*([a-zA-Z][a-zA-Z0-9]*)"
# The widest spans that the HTML standard allows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def _span(tag: Column, name: str, most: int) -> Column:
    """A span as a number from 1 on; 0, which means the rest, and what is no number are as browsers take them."""
    number = F.regexp_extract(_attribute(tag, name), r"^\s*(\d{1,6})", 1)
    n = F.when(number == "", 1).otherwise(number.cast("int"))
    rest = F.lit(most if name == "rowspan" else 1)
    return F.when(n == 0, rest).otherwise(F.least(n, F.lit(most)))


def table_cells(pages: DataFrame, page_id: str, html: str = "html") -> DataFrame:
    """Every cell of every table: the page, its table, place and markup.

    (page_id, ``page``, ``table_at``, ``level``, ``classes``, ``row_no``, ``cell_no``,
    ``rowspan``, ``colspan``, ``text``). ``page`` tells pages apart that share an id,
    ``table_at`` the tables of a page, in their order; ``level`` is 1 for tables
    that stand in no other. A cell has the text of its own, without that of a
    table in it. End tags may be missing: a cell ends with the next cell or row
    and with its table, a row with the next row.

    The stack of open tables is a running sum over a page's tags, and what a tag
    belongs to is what was opened last at its depth; so nothing is held but one
    page's tags, in JVM windows that can spill.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.monotonically_increasing_id().alias("page"), F.col(html).alias("_html"))
    tokens = rows.select("page_id", "page", F.posexplode(F.regexp_extract_all("_html", F.lit(_TOKEN), F.lit(0))).alias("at", "token"))
    tag = F.startswith("token", F.lit("<")) & (F.length("token") > 1)
    name = F.when(tag, F.lower(F.regexp_extract("token", _NAME, 2))).otherwise("")
    closes = F.when(tag, F.regexp_extract("token", _NAME, 1) == "/").otherwise(False)
    tokens = tokens.withColumns({"name": name, "closes": closes})
    tokens = tokens.where(~tag | F.col("name").isin("table", "tr", "td", "th"))

    table = F.col("name") == "table"
    step = F.when(table & ~F.col("closes"), 1).when(table, -1).otherwise(0)
    page = Window.partitionBy("page").orderBy("at")
    depth = F.sum(step).over(page)
    # an end tag belongs to the table it ends; stray end tags lift nothing above the page
    tokens = tokens.withColumn("depth", depth)
    low = F.least(F.lit(0), F.min("depth").over(page))
    tokens = tokens.withColumn("level", (F.col("depth") - low + F.when(table & F.col("closes"), 1).otherwise(0)).cast("int"))
    tokens = tokens.where("level > 0")

    opens = table & ~F.col("closes")
    level = Window.partitionBy("page", "level").orderBy("at")
    held = F.last(F.when(opens, F.struct(F.col("at").alias("table_at"), F.lower(_attribute(F.col("token"), "class")).alias("classes"))), True)
    tokens = tokens.withColumn("held", held.over(level)).where("held is not null")
    cell = F.col("name").isin("td", "th") & ~F.col("closes")
    within = Window.partitionBy("page", "held.table_at").orderBy("at")
    row_no = F.sum(F.when((F.col("name") == "tr") & ~F.col("closes"), 1).otherwise(0)).over(within)
    cell_no = F.sum(F.when(cell, 1).otherwise(0)).over(within)
    # what was opened or closed last decides whether text is in a cell
    inside = F.last(F.when(F.col("name") != "", cell), True).over(within)
    parts = tokens.select(
        "page_id", "page", "held.table_at", "held.classes", "level", "at", "token", "name",
        row_no.alias("row_no"), cell_no.alias("cell_no"), inside.alias("inside"), cell.alias("cell"),
    ).where("inside")
    markup = F.array_sort(F.collect_list(F.when(F.col("name") == "", F.struct("at", "token"))))
    text = F.array_join(F.transform(markup, lambda p: p["token"]), "")
    start = F.max(F.when(F.col("cell"), F.struct("row_no", "token")))
    cells = parts.groupBy("page", "table_at", "cell_no").agg(
        F.first("page_id").alias("page_id"), F.first("level").alias("level"), F.first("classes").alias("classes"), start.alias("start"), text.alias("text")
    )
    return cells.select(
        "page_id", "page", "table_at", "level", "classes", F.col("start.row_no").cast("int").alias("row_no"), F.col("cell_no").cast("int").alias("cell_no"),
        _span(F.col("start.token"), "rowspan", MOST_ROWS).alias("rowspan"), _span(F.col("start.token"), "colspan", MOST_COLUMNS).alias("colspan"),
        cell_text(F.col("text")).alias("text"),
    )


def table_grids(pages: DataFrame, page_id: str, html: str = "html", class_name: str | None = None, level: int | None = None) -> DataFrame:
    """(page_id, ``table_no``, ``row``, ``col``, ``text``): every slot of every table that a cell covers.

    Slots count from 0. A cell fills all slots of its row and column span, as far
    as the table has rows; where two would fill one, the first in the page does.
    ``class_name`` keeps the tables with that class, ``level`` those nested so
    deep; ``table_no`` counts the tables kept in a page. Rows without cells count.
    """
    cells = table_cells(pages, page_id, html)
    if class_name is not None:
        cells = cells.where(F.array_contains(F.split("classes", r"\s+"), class_name.lower()))
    if level is not None:
        cells = cells.where(F.col("level") == level)
    one = F.struct("cell_no", "row_no", "rowspan", "colspan", "text")
    tables = cells.groupBy("page", "table_at").agg(F.first("page_id").alias("page_id"), F.array_sort(F.collect_list(one)).alias("cells"))
    empty = F.expr("cast(array() as array<struct<row: int, col: int, rows: int, cols: int, text: string>>)")
    start = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("col"), F.expr("cast(array() as array<int>)").alias("until"), empty.alias("out"))

    def place(state: Column, c: Column) -> Column:
        """Put a cell into the first slot of its row, from the last cell on, that none from above reaches into."""
        cursor = F.when(state["row"] == c["row_no"], state["col"]).otherwise(F.lit(0))
        slots = F.sequence(cursor, F.greatest(cursor, F.size(state["until"])))
        col = F.get(F.filter(slots, lambda x: F.coalesce(F.get(state["until"], x), F.lit(-1)) < c["row_no"]), F.lit(0))
        return F.get(F.transform(F.array(col), lambda at: filled(state, c, at)), F.lit(0))

    def filled(state: Column, c: Column, at: Column) -> Column:
        end, last = at + c["colspan"], c["row_no"] + c["rowspan"] - 1
        until = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(state["until"]), end) - 1),
            lambda x: F.when((x >= at) & (x < end), F.greatest(last, F.coalesce(F.get(state["until"], x), last))).otherwise(
                F.coalesce(F.get(state["until"], x), F.lit(-1))
            ),
        )
        cell = F.struct(c["row_no"].alias("row"), at.alias("col"), c["rowspan"].alias("rows"), c["colspan"].alias("cols"), c["text"].alias("text"))
        return F.struct(c["row_no"].alias("row"), end.alias("col"), until.alias("until"), F.array_append(state["out"], cell).alias("out"))

    placed = tables.select("page_id", "page", "table_at", F.aggregate("cells", start, place)["out"].alias("out"))
    ends = F.transform("out", lambda c: c["row"])
    placed = placed.withColumns({"first": F.array_min(ends), "last": F.array_max(ends)})
    number = F.dense_rank().over(Window.partitionBy("page").orderBy("table_at")) - 1
    placed = placed.withColumn("table_no", number)
    slots = placed.select("page_id", "page", "table_no", "first", "last", F.posexplode_outer("out").alias("nth", "c"))
    down = F.sequence(F.col("c.row"), F.least(F.col("c.row") + F.col("c.rows") - 1, F.col("last")))
    across = F.sequence(F.col("c.col"), F.col("c.col") + F.col("c.cols") - 1)
    slots = slots.select("*", F.explode_outer(down).alias("row")).select("*", F.explode_outer(across).alias("col"))
    first = F.row_number().over(Window.partitionBy("page", "table_no", "row", "col").orderBy("nth"))
    slots = slots.withColumn("_first", first).where("_first = 1")
    # rows are counted from the first <tr>; cells before any stand in the row of that number less one
    base = F.least(F.col("first"), F.lit(1))
    return slots.select(F.col("page_id").alias(page_id), "table_no", (F.col("row") - base).alias("row"), "col", F.col("c.text").alias("text"))
