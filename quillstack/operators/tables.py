"""Tables as rows: Markdown in and out, artifacts, overlaps with figures, continuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.runtime import by_group

SYNTHETIC = "Uncaptioned"
CONTINUATION_PAGES = 2
NUMBERED = r"(?i)^(?:\*\*)?(?:Table|Tab\.?)\s+(?:\d+|[IVXLCDM]+|[A-Z]\.\d+|S\d+)"
# Letters set apart as some publishers print them over the abstract; marks of contents lists and diagrams.
SPACED_BOX = r"(?i)a\s+r\s*t\s*i\s*c\s*l\s*e|i\s+n\s*f\s*o|a\s+b\s*s\s*t\s*r\s*a\s*c\s*t"
CONTENTS_LINE = r"^\d+\s+[A-Z].*\d{2,}$"
CONTENTS_PACKED = r"\d+\s+[A-Z][a-z]+.*?\d{2,}"
BARE_NUMBER = r"^\.?\d+\.?$"
DIAGRAM = r"(?i)(?:Figure|Fig\.?)\s+\d+\b.*(?:diagram|block|schematic|overview|flowchart)"


def n_cols(headers: Column, rows: Column) -> Column:
    return F.greatest(F.coalesce(F.size(headers), F.lit(0)), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))


def to_markdown(headers: Column, rows: Column, caption: Column, footnotes: Column) -> Column:
    """A table as Markdown: bold caption, head, padded rows, footnotes in italics."""
    width = n_cols(headers, rows)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width)
    head = F.when(F.size(headers) > 0, F.array(line(headers), line(F.transform(headers, lambda h: F.lit("---"))))).otherwise(F.array().cast("array<string>"))
    top = F.when(F.coalesce(caption, F.lit("")) != "", F.array(F.concat(F.lit("**"), caption, F.lit("**\n")))).otherwise(F.array().cast("array<string>"))
    foot = F.when(F.coalesce(footnotes, F.lit("")) != "", F.array(F.lit(""), F.concat(F.lit("*"), footnotes, F.lit("*")))).otherwise(F.array().cast("array<string>"))
    body = F.transform(F.filter(rows, lambda r: F.lit(True)), lambda r: line(padded(r)))
    return F.array_join(F.concat(top, head, body, foot), "\n")


def artifact(headers: Column, rows: Column, caption: Column) -> Column:
    """What a table really is: article_info_box, table_of_contents, diagram_as_table; null for a table."""
    cells = F.filter(F.concat(headers, F.flatten(rows)), lambda c: c.isNotNull())
    real = F.coalesce(caption.rlike(NUMBERED), F.lit(False))
    total = F.size(rows) + F.when(F.size(headers) > 0, 1).otherwise(0)
    listed = F.size(F.filter(cells, lambda c: F.trim(c).rlike(CONTENTS_LINE)))
    packed = F.exists(cells, lambda c: F.size(F.regexp_extract_all(c, F.lit(CONTENTS_PACKED), F.lit(0))) >= 3)
    lines = F.concat(F.when(F.size(headers) >= 3, F.array(headers)).otherwise(F.array().cast("array<array<string>>")), rows)
    spread = F.size(F.filter(lines, lambda r: (F.size(r) >= 3) & F.trim(F.get(r, F.lit(0))).rlike(BARE_NUMBER) & F.trim(F.element_at(r, -1)).rlike(BARE_NUMBER)))
    everything = F.concat_ws(" ", headers, F.flatten(rows))
    return (
        F.when(~real & F.array_join(headers, " ").rlike(SPACED_BOX), "article_info_box").when((listed >= 3) & (listed >= total * 0.4), "table_of_contents").when(~real & packed, "table_of_contents")
        .when(~real & (total >= 2) & (spread >= 2) & (spread >= total * 0.4), "table_of_contents").when(~real & everything.rlike(DIAGRAM), "diagram_as_table")
    )


def figure_data_tables(tables: DataFrame, figures: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Tables without a caption of their own of whose area more than ``share`` lies in a figure of their page."""
    free = tables.where(F.col("caption").isNull() | (F.col("caption") == "") | F.startswith("caption", F.lit(SYNTHETIC)))
    f = figures.select(*keys, *[F.col(c).alias("f" + c) for c in ("x0", "y0", "x1", "y1")])
    met = free.join(f, keys)
    wide = F.greatest(F.least("x1", "fx1") - F.greatest("x0", "fx0"), F.lit(0.0))
    high = F.greatest(F.least("y1", "fy1") - F.greatest("y0", "fy0"), F.lit(0.0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return met.where((area > 0) & (wide * high > share * area)).select(*tables.columns).distinct()


def markdown_tables(pages: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """Tables in the Markdown of pages: keys, table_index (from 0 per page), headers, rows, caption, n_rows, n_cols.

    A table is a run of lines that start with a bar and has a rule as its second line. The caption is the nearest
    non-blank line above if it names a table; a line before another table is not that.
    """
    lines = pages.where(F.length(text) > 0).select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).withColumn("bar", F.col("line").rlike(r"^\s*\|"))
    order = W.partitionBy(*keys).orderBy("n")
    above = F.last(F.when(F.trim("line") != "", F.when(F.col("bar"), "").otherwise(F.col("line"))), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("bar"), 0).otherwise(1)).over(order)
    marked = lines.withColumn("above", above).withColumn("run", run).where("bar")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|", -1), lambda c: F.trim(c))
    grouped = marked.groupBy(*keys, "run").agg(F.min("n").alias("first"), F.array_sort(F.collect_list(F.struct("n", "line", cells.alias("cells")))).alias("rows"), F.min_by("above", "n").alias("above"))
    ruled = grouped.where((F.size("rows") >= 2) & F.get("rows", F.lit(1))["line"].rlike(r"^\s*\|[\s:|\-]+\|?\s*$"))
    body = F.transform(F.slice("rows", F.lit(3), F.size("rows")), lambda r: r["cells"])
    out = ruled.select(*keys, "first", F.get("rows", F.lit(0))["cells"].alias("headers"), body.alias("rows"), F.when(F.col("above").rlike(NUMBERED), F.regexp_replace("above", r"^\*+|\*+$", "")).alias("caption"))
    out = out.withColumn("table_index", F.row_number().over(W.partitionBy(*keys).orderBy("first")) - 1)
    return out.select(*keys, "table_index", "headers", "rows", "caption", F.size("rows").alias("n_rows"), n_cols(F.col("headers"), F.col("rows")).alias("n_cols"))


def synthetic_caption(kind: str, caption: Column, page: Column) -> Column:
    return F.coalesce(F.when(F.trim(caption) != "", caption), F.concat(F.lit(f"{SYNTHETIC} {kind} on page "), page.cast("string")))


def continue_captions(tables: DataFrame, key: str) -> DataFrame:
    """Uncaptioned tables that carry on a captioned one (same headers, at most two pages apart) get its caption with '(continued)'.

    A table that got a caption can pass it on, so the tables of one document are walked in order; a group is the
    tables of one document.
    """

    def walk(rows: list, _: list) -> list:
        order = sorted(range(len(rows)), key=lambda i: (rows[i]["page_num"], rows[i]["table_index"]))
        captions: list[str | None] = [rows[i]["caption"] or None for i in range(len(rows))]
        captioned: dict[tuple, list[int]] = {}
        for i in order:
            if captions[i]:
                captioned.setdefault(tuple(rows[i]["headers"]), []).append(i)
        for i in order:
            head = tuple(rows[i]["headers"]) if rows[i]["headers"] is not None else ()
            if captions[i] or not head:
                continue
            near = [j for j in captioned.get(head, ()) if abs(rows[j]["page_num"] - rows[i]["page_num"]) <= CONTINUATION_PAGES]
            if near:
                donor = min(near, key=lambda j: (rows[j]["page_num"], rows[j]["table_index"]))
                captions[i] = f"{captions[donor]} (continued)"
                captioned[head].append(i)
        return captions

    done = by_group(tables, None, [key], walk, T.ArrayType(T.StringType()))
    each = done.select(key, F.explode(F.zip_with("_rows", "_out", lambda r, c: F.struct(r.alias("r"), c.alias("c")))).alias("x"))
    return each.select(*[F.col(key) if c == key else F.col("x.c").alias(c) if c == "caption" else F.col(f"x.r.{c}").alias(c) for c in tables.columns])


def number_of(caption: Column) -> Column:
    """Whole number of a table or figure caption, null without one."""
    return F.regexp_extract(caption, r"(?i)(?:Figure|Fig\.?|Table|Tab\.?)\s+(\d+)", 1).try_cast("int")

