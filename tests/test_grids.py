"""Grids of nested and spanned tables against a plain reader."""

from __future__ import annotations

import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from murmur.sources.grids import table_grids


class Reader(HTMLParser):
    """Tables by a stack, with the end tags a browser would supply."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.tables = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.stack.append({"class": (a.get("class") or "").lower().split(), "cells": [], "row": 0, "open": False, "level": len(self.stack) + 1})
            self.tables.append(self.stack[-1])
        elif self.stack and tag == "tr":
            self.stack[-1]["row"] += 1
            self.stack[-1]["open"] = False
        elif self.stack and tag in ("td", "th"):
            number = lambda n, most: (int(a[n]) if (a.get(n) or "").isdigit() else 1, most)
            rows, cols = number("rowspan", 65534), number("colspan", 1000)
            rows = rows[1] if rows[0] == 0 else min(rows)
            cols = 1 if cols[0] == 0 else min(cols)
            self.stack[-1]["cells"].append([self.stack[-1]["row"], rows, cols, ""])
            self.stack[-1]["open"] = True

    def handle_endtag(self, tag):
        if tag == "table" and self.stack:
            self.stack.pop()
        elif self.stack and tag in ("td", "th", "tr"):
            self.stack[-1]["open"] = False

    def handle_data(self, data):
        if self.stack and self.stack[-1]["open"]:
            self.stack[-1]["cells"][-1][3] += data


def grids(page, class_name=None, level=None):
    reader = Reader()
    reader.feed(page or "")
    reader.close()
    kept = [t for t in reader.tables if t["cells"] and (class_name is None or class_name in t["class"]) and (level is None or t["level"] == level)]
    out = []
    for no, table in enumerate(kept):
        slots, busy, last = {}, {}, max(c[0] for c in table["cells"])
        base, row, col = min(1, min(c[0] for c in table["cells"])), None, 0
        for r, rows, cols, text in table["cells"]:
            col = col if r == row else 0
            row = r
            while busy.get(col, -1) >= r:
                col += 1
            for x in range(col, col + cols):
                busy[x] = max(busy.get(x, -1), r + rows - 1)
                for y in range(r, min(r + rows - 1, last) + 1):
                    slots.setdefault((y - base, x), text)
            col += cols
        out += [(no, y, x, t) for (y, x), t in slots.items()]
    return out


def a_table(rng, depth, closed):
    end = lambda tag: f"</{tag}>" if closed or tag == "table" else ""
    out = [rng.choice(["<table>", '<table class="Main data">', "<TABLE CLASS=data>", "<table id=x class='other'>"])]
    for _ in range(rng.randint(0, 4)):
        out.append(rng.choice(["<tr>", "<tr valign=top>"]))
        for _ in range(rng.randint(0, 4)):
            span = "".join(f' {n}="{rng.choice([0, 1, 2, 3, "x"])}"' for n in ("rowspan", "colspan") if rng.random() < 0.3)
            out.append(f"<{'th' if rng.random() < 0.2 else 'td'}{span}>")
            tag = out[-1][1:3]
            out.append(rng.choice(["a", "b &amp; c", "<b>bold</b>", "", " x\n"]))
            if depth and rng.random() < 0.25:
                out.append(a_table(rng, depth - 1, closed) + "after")
            out.append(end(tag))
        out.append(end("tr"))
    return "".join(out) + end("table")


@pytest.mark.parametrize(("class_name", "level"), [(None, None), ("data", None), (None, 2)])
def test_grids_against_a_reader(spark, class_name, level):
    rng = random.Random(4)
    pages = [f"<p>text {a_table(rng, 2, i % 2 == 0)} between {a_table(rng, 1, i % 3 == 0)}" for i in range(150)]
    pages += [None, "", "no table", "</table><table><td>x</table>", "<table><tr><td>open", pages[0]]
    rows = [(i, p) for i, p in enumerate(pages)] + [(0, pages[1])]
    frame = spark.createDataFrame(rows, "page_id int, html string").repartition(3)
    got = Counter(map(tuple, table_grids(frame, "page_id", "html", class_name, level).collect()))
    want = Counter((i, *slot) for i, p in rows for slot in grids(p, class_name, level))
    assert got == want and sum(want.values()) > 200


def test_spans_fill_the_grid(spark):
    page = '<table><tr><td rowspan=2>a<td colspan="2">b<tr><td>c<td>d</table>'
    frame = spark.createDataFrame([(1, page)], "page_id int, html string")
    rows = sorted((r["row"], r["col"], r["text"]) for r in table_grids(frame, "page_id").collect())
    assert rows == [(0, 0, "a"), (0, 1, "b"), (0, 2, "b"), (1, 0, "a"), (1, 1, "c"), (1, 2, "d")]
    plan = table_grids(frame, "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonUDF0", "")
