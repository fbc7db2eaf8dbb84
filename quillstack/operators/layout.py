"""Structure of documents from their layout: contents lists, abstracts, headings over tables, gaps in caption numbers, completeness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.config import CONFIDENCE_FALLBACK, CONFIDENCE_TOC, SECTION_WEIGHTS
from quillstack.functions.text import heading_text, section_of, stripped
from quillstack.operators.chunking import build_spans

# Fixed value: how an abstract opens.
ABSTRACT = r"(?im)(?:\A|\n)[ \t]*(?:#{1,3}[ \t]*)?(?:\*\*)?abstract(?:\*\*)?\.?[ \t]*[\n:]?"
NEXT_HEADING = r"\n\s*(?:#{1,3}\s|\*\*\d)"
PAGE_ID = r"^R?\d+$"
LEAST_DEEP_WEIGHT = 0.85
ABSTRACT_PAGES, LEAST_ABSTRACT = 3, 100
HEADING_CHARS, HEADING_WORDS, HEADING_LINES = 120, 15, 4
BATCH_BYTES = 200_000_000


def toc_matches(toc: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Entries of contents lists (key, entry, level, title, page_num) with the header box (key, page_num, box_index, text, char_offset) they name.

    One text holds the other; the entry's own page comes first, then the next, then the one before, and of several
    boxes of a page the first.
    """
    plain = lambda c: F.lower(heading_text(c))
    asked = toc.select(key, "entry", "level", "title", plain(F.col("title")).alias("_t"), F.posexplode(F.array(F.col("page_num"), F.col("page_num") + 1, F.col("page_num") - 1)).alias("_rank", "page_num"))
    met = asked.where("_t <> ''").join(boxes.withColumn("_b", plain(F.col("text"))), [key, "page_num"])
    met = met.where(F.contains("_b", F.col("_t")) | (F.contains("_t", F.col("_b")) & (F.col("_b") != "")))
    return met.withColumn("_n", F.row_number().over(W.partitionBy(key, "entry").orderBy("_rank", "box_index"))).where("_n = 1").select(key, "entry", "level", "title", "text", "char_offset")


def toc_sections(matched: DataFrame, key: str) -> DataFrame:
    """label and confidence of matched entries: by their words, else (deeper levels) from the nearest told entry of level 1 above, else unknown."""
    told = section_of(heading_text(F.col("title")))
    out = matched.withColumn("_told", told)
    above = F.last(F.when((F.col("level") == 1), F.col("_told")), ignorenulls=True).over(W.partitionBy(key).orderBy("char_offset", "entry").rowsBetween(W.unboundedPreceding, -1))
    label = F.coalesce("_told", F.when(F.col("level") >= 2, above), F.lit("unknown"))
    return out.withColumn("label", label).withColumn("confidence", F.when(F.col("_told").isNotNull(), CONFIDENCE_TOC).otherwise(CONFIDENCE_FALLBACK)).drop("_told")


def counted(toc: DataFrame) -> DataFrame:
    """Entries of contents lists that count: levels 1 and 2, and those of level 3 whose words tell a section that weighs LEAST_DEEP_WEIGHT or more."""
    weight = F.create_map(*[F.lit(x) for kv in SECTION_WEIGHTS.items() for x in kv])
    told = section_of(heading_text(F.col("title")))
    return toc.where((F.col("level") <= 2) | ((F.col("level") == 3) & (F.coalesce(F.try_element_at(weight, told), F.lit(0.0)) >= LEAST_DEEP_WEIGHT)))


def document_sections(docs: DataFrame, toc: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Section spans from contents lists where they match header boxes, else from the header boxes alone.

    docs: key, total (characters); toc and boxes as in ``toc_matches``. Boxes that hold only a page's identifier are no
    headings. Without a contents list nothing is inherited: a heading that tells no section is unknown. A document
    without headings is one unknown span.
    """
    listed = toc_sections(toc_matches(counted(toc), boxes, key), key).select(key, F.col("char_offset").alias("char_start"), F.col("text").alias("heading_text"), "label", "confidence")
    free = boxes.where(~heading_text(F.col("text")).rlike(PAGE_ID)).join(listed.select(key).distinct(), key, "left_anti")
    word = section_of(heading_text(F.col("text")))
    boxed = free.select(key, F.col("char_offset").alias("char_start"), stripped(F.col("text")).alias("heading_text"), F.coalesce(word, F.lit("unknown")).alias("label"), F.when(word.isNotNull(), CONFIDENCE_TOC).otherwise(CONFIDENCE_FALLBACK).alias("confidence"))
    return build_spans(listed.unionByName(boxed), docs, key)


def abstract_spans(pages: DataFrame, key: str) -> DataFrame:
    """(key, char_start, char_end) of the abstract: from its heading in the first pages to the next heading of that page or the page's end."""
    early = pages.where((F.col("page_num") <= ABSTRACT_PAGES) & F.col("markdown").rlike(ABSTRACT))
    head = F.regexp_extract("markdown", ABSTRACT, 0)
    at = F.length(F.regexp_extract("markdown", r"(?s)\A(.*?)" + ABSTRACT.replace("(?im)", "(?im:") + ")", 1))
    found = early.withColumn("_at", at).withColumn("_rest", F.substring(F.col("markdown"), at + F.length(head) + 1, F.length("markdown")))
    stop = F.length(F.split(F.col("_rest"), NEXT_HEADING, 2)[0])
    found = found.select(key, "page_num", (F.col("char_start") + F.col("_at")).alias("s"), (F.col("char_start") + F.col("_at") + F.length(head) + stop).alias("e"))
    return found.groupBy(key).agg(F.min_by(F.struct("s", "e"), "page_num").alias("a")).select(key, F.col("a.s").alias("char_start"), F.col("a.e").alias("char_end"))


def styled_abstracts(blocks: DataFrame, body: DataFrame, key: str) -> DataFrame:
    """(key, block) of the one long block of the first pages set in another style than the body, of documents of four pages or more.

    blocks: key, page_num, block, text, font, size, pages; body: key, font, size (the dominant style).
    """
    other = blocks.where((F.col("pages") >= 4) & (F.col("page_num") <= ABSTRACT_PAGES) & (F.length("text") >= LEAST_ABSTRACT) & ~F.contains("text", F.lit("@")))
    b = body.select(key, F.col("font").alias("_f"), F.col("size").alias("_s"))
    other = other.join(b, key).where((F.col("font") != F.col("_f")) | (F.col("size") != F.col("_s")))
    return other.groupBy(key).agg(F.count("*").alias("n"), F.min_by("block", F.struct("page_num", "block")).alias("block")).where("n = 1").select(key, "block")


def pages_in(pages: DataFrame, spans: DataFrame, key: str, labels: tuple[str, ...] = ("references", "appendix")) -> DataFrame:
    """Pages that start inside a section of one of the labels."""
    nested = spans.where(F.col("label").isin(*labels)).groupBy(key).agg(F.collect_list(F.struct("char_start", "char_end")).alias("_s"))
    return pages.join(nested, key).where(F.exists("_s", lambda s: (s["char_start"] <= F.col("char_start")) & (F.col("char_start") < s["char_end"]))).drop("_s")


def heading_captions(tables: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Uncaptioned tables (keys, table_index, y0, spacing) with the nearest short bold or italic line (keys, y1, text, styled) above them.

    The zone reaches four median line spacings up. Tables without such a line keep a null caption.
    """
    near = tables.where(F.coalesce("caption", F.lit("")) == "").drop("caption").join(lines.where("styled"), keys)
    gap = F.col("y0") - F.col("y1")
    words = F.size(F.split(stripped(F.col("text")), r"\s+"))
    near = near.where((gap >= 0) & (gap <= HEADING_LINES * F.col("spacing")) & (F.length("text") <= HEADING_CHARS) & (words <= HEADING_WORDS))
    best = near.groupBy(*keys, "table_index").agg(F.min_by(F.col("text"), F.struct(gap, F.col("text"))).alias("_c"))
    return tables.join(best, [*keys, "table_index"], "left").withColumn("caption", F.coalesce(F.when(F.col("caption") != "", F.col("caption")), F.col("_c"))).drop("_c")


def gap_captions(objects: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Objects (key, object_id, page_num, number, caption) whose caption number is missing between two others take it from the pages between.

    found: key, page_num, number, caption of all caption lines. A missing number is looked for between the pages of
    its neighbours; the first object without caption on that page takes it.
    """
    have = objects.where("number is not null").select(key, "number", "page_num").distinct()
    # only caption lines can fill a gap, so they are looked up among the numbers there are, not the gaps counted out
    every = have.select(key, "number", "page_num", F.lit(True).alias("held")).unionByName(found.select(key, "number", F.lit(None).cast("int").alias("page_num"), F.lit(False).alias("held")).distinct())
    by_number = every.groupBy(key, "number").agg(F.max("held").alias("held"), F.min("page_num").alias("p0"), F.max("page_num").alias("p1"))
    order = W.partitionBy(key).orderBy("number")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    gaps = by_number.withColumn("low", F.max("p1").over(before)).withColumn("high", F.min("p0").over(after)).where("not held and low is not null and high is not null")
    hits = gaps.select(key, "number", "low", "high").join(found.select(key, "number", F.col("page_num").alias("page_num"), F.col("caption").alias("found")), [key, "number"]).where("page_num between low and high")
    hits = hits.groupBy(key, "number").agg(F.min_by(F.struct("page_num", "found"), F.struct("page_num", "found")).alias("h")).select(key, "number", "h.page_num", "h.found")
    rank = lambda *o: F.row_number().over(W.partitionBy(key, "page_num").orderBy(*o))
    free = objects.where("caption is null").withColumn("_n", rank("object_id")).select(key, "page_num", "object_id", "_n")
    pairs = hits.withColumn("_n", rank("number")).join(free, [key, "page_num", "_n"]).select(key, "object_id", F.col("number").alias("_num"), "found")
    return objects.join(pairs, [key, "object_id"], "left").withColumn("caption", F.coalesce("caption", "found")).withColumn("number", F.coalesce("number", "_num")).drop("found", "_num").select(*objects.columns)


def completeness_rows(pages: DataFrame, captions: DataFrame, tables: DataFrame, figures: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Per document what was found and what is missing; the columns completeness.grade reads.

    captions: key, kind, number; tables and figures: key, caption.
    """
    base = pages.groupBy(key).agg(F.count("*").alias("total_pages"), F.sum(F.when(F.length(F.trim(F.coalesce("markdown", F.lit("")))) > 0, 1).otherwise(0)).alias("text_pages"))
    named = lambda k: F.count_distinct(F.when(F.col("kind") == k, F.col("number")))
    said = captions.groupBy(key).agg(named("figure").alias("figure_captions_found"), named("table").alias("table_captions_found"))
    have = lambda df, k: df.groupBy(key).agg(F.count("*").alias(f"{k}_found"), F.sum(F.when(F.coalesce("caption", F.lit("")) != "", 1).otherwise(0)).alias(f"{k}_with_captions"))
    told = spans.where("label not in ('preamble', 'unknown')").groupBy(key).agg(F.count("*").alias("sections_identified"))
    out = base
    for side in (said, have(tables, "tables"), have(figures, "figures"), told):
        out = out.join(side, key, "left")
    out = out.fillna(0)
    return out.withColumn("figures_missing", F.greatest(F.lit(0), F.col("figure_captions_found") - F.col("figures_found"))).withColumn("tables_missing", F.greatest(F.lit(0), F.col("table_captions_found") - F.col("tables_found")))


def with_reference_context(objects: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """``reference_context`` of objects whose caption really numbers a table or figure; others keep none."""
    c = contexts.select(*keys, F.col("passage").alias("_p"))
    return objects.join(c, keys, "left").withColumn("reference_context", F.when(F.col("caption").rlike(r"(?i)^(?:\*\*)?(?:Table|Tab\.?|Figure|Fig\.?)\s+\S"), F.col("_p"))).drop("_p")


def image_name(doc, page, index):
    """File name of a figure; it holds the document, so documents don't overwrite each other."""
    return F.format_string("%s_fig_p%03d_%02d.png", doc, page, index)


def request_batches(requests: DataFrame, size: str, limit: int = BATCH_BYTES) -> DataFrame:
    """``batch`` of each request: consecutive ones of a partition fill a batch up to ``limit`` bytes; a larger one stands alone."""

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, used = 0, 0
        for pdf in parts:
            numbers = []
            for n in pdf[size]:
                if used and used + n > limit:
                    batch, used = batch + 1, 0
                used += n
                numbers.append(batch)
            yield pdf.assign(batch=numbers)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", batch int"
    return requests.mapInPandas(fill, shape).withColumn("partition", F.spark_partition_id())
