"""Caption detection, and assignment of captions to tables, figures and OCR regions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.runtime import by_group

# Numbers and labels of captions.
NUMBER = r"(?:\d+|[IVXLCDM]+|[A-Z]\.\d+|S\d+)"
FIGURE, TABLE = r"(?:Figure|Fig\.?)", r"(?:\*\*)?(?:Table|Tab\.?)"
SUPPLEMENT = r"(?i)^(?:supplementary|suppl?\.?)\s+"


def caption_kind(line: Column) -> Column:
    """'figure' or 'table' if the line is a caption: label and number, then a delimiter or nothing."""
    bare = F.regexp_replace(F.trim(line), SUPPLEMENT, "")
    strict = lambda label: bare.rlike(rf"(?i)^{label}\s+{NUMBER}\s*(?:[.:(—–-]|\*\*|$)")
    return F.when(strict(FIGURE), "figure").when(strict(TABLE), "table")


def caption_number(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, rf"(?i)(?:Figure|Fig\.?|Table|Tab\.?)\s+({NUMBER})", 1), F.lit(""))


def captions(pages: DataFrame, keys: list[str], text: str = "markdown") -> DataFrame:
    """(keys, line_no, kind, number, caption) of every caption line of the pages."""
    lines = pages.where(F.length(text) > 0).select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    found = lines.withColumn("kind", caption_kind(F.col("line"))).where("kind is not null")
    return found.select(*keys, (F.col("n") + 1).alias("line_no"), "kind", caption_number(F.col("line")).alias("number"), F.trim(F.regexp_replace("line", r"\*\*", "")).alias("caption"))


SCANNED_LINES = 5  # lines of a block, from its first, that may open its caption
BOLD_FONT = r"(?i)bold|\.B$|-B$|heavy|black"


def _spans(lines: Column) -> Column:
    """The spans with text of some lines, one after another."""
    return F.filter(F.flatten(F.transform(lines, lambda line: line["spans"])), lambda s: F.trim(s["text"]) != "")


def _set_apart(lines: Column) -> Column:
    """Whether lines look like a caption: the first two spans differ in font, or most letters are bold."""
    spans = _spans(lines)
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, s: n + F.length(F.trim(s["text"])))
    bold = F.filter(spans, lambda s: F.coalesce(s["bold"], F.lit(False)) | F.coalesce(s["font"].rlike(BOLD_FONT), F.lit(False)))
    change = F.coalesce(F.get(spans, F.lit(0))["font"] != F.get(spans, F.lit(1))["font"], F.lit(False))
    return change | ((size(spans) > 0) & (size(bold) > size(spans) * 0.5))


def block_captions(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, kind, number, caption, y, x0, y0, x1, y1) of the captions among the text blocks of pages, from top to bottom.

    blocks: keys, block, x0..y1, lines (array of struct(spans: array of struct(text, font, bold))). A block is a caption
    if it opens with a label and number followed by a delimiter or nothing, or by words where the style sets the label
    apart: another font, its own line, or bold. Text may run into a caption's block from above, so the first SCANNED_LINES
    lines are tried one after another; the caption begins at the line found. Figures come before tables.
    """
    text = lambda lines: F.trim(F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), "")), " "))
    label = {"figure": FIGURE, "table": TABLE}
    strict = lambda t, kind: F.regexp_replace(t, SUPPLEMENT, "").rlike(rf"(?i)^{label[kind]}\s+{NUMBER}\s*[.:(—–-]")
    bare = lambda t, kind: F.regexp_replace(t, SUPPLEMENT, "").rlike(rf"(?i)^{label[kind]}\s+{NUMBER}\s*$")
    loose = lambda t, kind: F.regexp_replace(t, SUPPLEMENT, "").rlike(rf"(?i)^{label[kind]}\s+{NUMBER}\s+\S")
    rows = blocks.where(F.size("lines") > 0).withColumn("_texts", F.transform("lines", lambda line: F.trim(F.array_join(F.transform(line["spans"], lambda s: s["text"]), ""))))
    rows = rows.withColumn("_whole", text(F.col("lines"))).where("_whole <> ''")

    def opening(kind: str) -> Column:
        """Index of the line that opens a caption of this kind, null if none does."""
        own_line = (F.size("lines") > 1) & bare(F.get("_texts", F.lit(0)), kind)
        first = strict(F.col("_whole"), kind) | bare(F.col("_whole"), kind) | (loose(F.col("_whole"), kind) & (_set_apart(F.col("lines")) | own_line))
        fits = lambda i: strict(F.get("_texts", i), kind) | bare(F.get("_texts", i), kind) | (loose(F.get("_texts", i), kind) & _set_apart(F.slice("lines", i + 1, F.size("lines"))))
        later = F.filter(F.sequence(F.lit(1), F.lit(SCANNED_LINES - 1)), lambda i: (i < F.size("lines")) & F.coalesce(fits(i), F.lit(False)))
        return F.when(first, 0).otherwise(F.get(later, F.lit(0)))

    rows = rows.withColumn("_f", opening("figure")).withColumn("_t", opening("table")).where("_f is not null or _t is not null")
    at = F.coalesce("_f", "_t")
    rows = rows.withColumn("caption", text(F.slice("lines", at + 1, F.size("lines")))).withColumn("kind", F.when(F.col("_f").isNotNull(), "figure").otherwise("table"))
    return rows.select(*keys, "block", "kind", caption_number(F.col("caption")).alias("number"), "caption", ((F.col("y0") + F.col("y1")) / 2).alias("y"), "x0", "y0", "x1", "y1").orderBy(*keys, "y", "block")


def _order(number: str | None) -> tuple:
    return (0, int(number), "") if number and number.isdigit() else (1, 0, number or "")


def side_by_side(boxes: list[tuple]) -> bool:
    """Whether two boxes stand beside each other: their heights overlap by more than 30 % of the lower one's."""
    spans = sorted((b[1], b[3]) for b in boxes)
    for i, (top, bottom) in enumerate(spans):
        for top2, bottom2 in spans[i + 1 :]:
            if top2 >= bottom:
                break
            low = min(bottom - top, bottom2 - top2)
            if low > 0 and (min(bottom, bottom2) - top2) / low > 0.3:
                return True
    return False


def match_boxes(boxes: list[tuple], found: list[tuple]) -> list[str | None]:
    """Caption of each box. found: (y, text, box or None).

    Captions in number order (without numbers, from top to bottom) go to the boxes from top to bottom, or, where boxes
    stand beside each other, each to the nearest free box.
    """
    if not found:
        return [None] * len(boxes)
    numbered = [(m.group(1), c) for c in found if (m := re.search(rf"(?:Figure|Fig\.?|Table|Tab\.?)\s+({NUMBER})", c[1], re.IGNORECASE))]
    queue = [c for _, c in sorted(numbered, key=lambda x: _order(x[0]))] if numbered else sorted(found, key=lambda c: c[0])
    out: list[str | None] = [None] * len(boxes)
    if not side_by_side(boxes):
        for i, c in zip(sorted(range(len(boxes)), key=lambda i: boxes[i][1]), queue):
            out[i] = c[1]
        return out
    free = {i: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for i, b in enumerate(boxes)}
    for y, text, box in queue:
        if not free:
            break
        x, y = ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2) if box is not None else (0.0, y)
        nearest = min(free, key=lambda i: (math.hypot(free[i][0] - x, free[i][1] - y), i))
        out[nearest] = text
        del free[nearest]
    return out


def with_captions(objects: DataFrame, found: DataFrame, keys: list[str], work) -> DataFrame:
    """``caption`` of each object by ``work(objects, captions)`` of its group, a list aligned with the objects."""
    done = by_group(objects, found, keys, work, T.ArrayType(T.StringType()))
    rest = [c for c in objects.columns if c not in keys]
    each = done.select(*keys, F.explode(F.zip_with("_rows", "_out", lambda r, c: F.struct(r.alias("r"), c.alias("c")))).alias("x"))
    return each.select(*keys, *[F.col(f"x.r.{c}") for c in rest], F.col("x.c").alias("caption")).select(*objects.columns, "caption")


def assign_captions(objects: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``caption`` of each object (keys, object_id, x0..y1) from the captions (keys, y, caption, x0..y1) of its page."""

    def match(rows: list, others: list) -> list:
        order = sorted(range(len(rows)), key=lambda i: rows[i]["object_id"])
        caps = sorted(others, key=lambda c: (c["y"], c["caption"]))
        found_ = match_boxes([tuple(rows[i][k] for k in ("x0", "y0", "x1", "y1")) for i in order], [(c["y"], c["caption"], None if c["x0"] is None else (c["x0"], c["y0"], c["x1"], c["y1"])) for c in caps])
        out: list[str | None] = [None] * len(rows)
        for i, c in zip(order, found_):
            out[i] = c
        return out

    return with_captions(objects, found, keys, match)


def captions_above(regions: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Recognised tables (keys, region_id, y0, page_height) with the nearest free caption above; heights are compared as shares of the page.

    Regions choose from top to bottom and each caption serves once.
    """

    def match(rows: list, others: list) -> list:
        share = lambda y, h: y / h if h else y
        pool = sorted((share(c["y"], c["page_height"]), c["caption"]) for c in others)
        out: list[str | None] = [None] * len(rows)
        for i in sorted(range(len(rows)), key=lambda i: (share(rows[i]["y0"], rows[i]["page_height"]), rows[i]["region_id"])):
            top = share(rows[i]["y0"], rows[i]["page_height"])
            at = max((j for j, (y, _) in enumerate(pool) if y <= top), default=None)
            if at is not None:
                out[i] = pool.pop(at)[1]
        return out

    return with_captions(regions, found, keys, match)


def recover_orphans(objects: DataFrame, floating: DataFrame, key: str) -> DataFrame:
    """Objects without a caption (key, page_num, object_id, y) take the nearest floating caption (key, page_num, caption, y) of their page.

    Pairs are taken by growing distance, each object and caption once.
    """

    def match(rows: list, others: list) -> list:
        pairs = sorted((abs(a["y"] - b["y"]), a["object_id"], b["caption"], i, j) for i, a in enumerate(rows) for j, b in enumerate(others))
        out: list[str | None] = [None] * len(rows)
        used = set()
        for _, _, caption, i, j in pairs:
            if out[i] is None and j not in used:
                out[i] = caption
                used.add(j)
        return out

    return with_captions(objects, floating, [key, "page_num"], match)
