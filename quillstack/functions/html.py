"""HTML tables to headers, rows and footnotes."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())
TABLE = T.StructType([T.StructField("headers", TEXTS), T.StructField("rows", T.ArrayType(TEXTS)), T.StructField("footnotes", T.StringType())])


class _Reader(HTMLParser):
    """Collects cells with their spans; text after the table becomes footnotes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []  # cell: [is head, text parts, colspan, rowspan]
        self.cell: list | None = None
        self.closed = False
        self.after: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr" and not self.closed:
            self.rows.append([])
        elif tag in ("td", "th") and not self.closed and self.rows:
            span = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and v and v.isdigit()}
            self.cell = [tag == "th", [], max(1, span.get("colspan", 1)), max(1, span.get("rowspan", 1))]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = None
        elif tag == "table":
            self.closed, self.cell = True, None

    def handle_data(self, data: str) -> None:
        if self.closed:
            self.after.append(data)
        elif self.cell is not None:
            self.cell[1].append(data)


def read_table(html: str) -> dict:
    """The first table: its first row of heads (or first row) as headers, the others as rows, spans filled in."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    hanging: dict[int, list] = {}  # column -> [rows left, text]
    heads, body = [], []
    for cells in reader.rows:
        line: list[str] = []
        is_head = any(c[0] for c in cells)
        queue = [c for c in cells if c[0]] if is_head else cells
        started: dict[int, list] = {}

        def fill() -> None:
            while len(line) in hanging:
                line.append(hanging[len(line)][1])

        for _, parts, across, down in queue:
            fill()
            text = " ".join(" ".join(parts).split())
            for _ in range(across):
                if down > 1:
                    started[len(line)] = [down - 1, text]
                line.append(text)
        fill()
        hanging = {c: [n - 1, t] for c, (n, t) in hanging.items() if n > 1} | started
        (heads if is_head else body).append(line)
    if not heads and body:
        heads, body = body[:1], body[1:]
    return {"headers": heads[0] if heads else [], "rows": body, "footnotes": " ".join(" ".join(reader.after).split())}


@F.pandas_udf(TABLE)
def html_table(html: pd.Series) -> pd.DataFrame:
    """Struct of headers, rows and footnotes; a null gives empty ones."""
    found = [read_table(h or "") for h in html]
    return pd.DataFrame({k: [f[k] for f in found] for k in ("headers", "rows", "footnotes")})
