"""Cutting documents into overlapping passages, and placing passages in pages and sections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.config import CONFIDENCE_FALLBACK, CONFIDENCE_SCHEME
from quillstack.functions.text import heading_text, section_of

# Ends of sentences, in the order in which they are looked for.
SENTENCE_ENDS = (". ", ".\n", "? ", "?\n", "! ", "!\n")


BOUNDS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def bounds_of(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the passages of a text, in one pass."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = start + size
        if end < n:
            low = start + int(size * 0.8)
            ends = (text.rfind(mark, low, end) for mark in SENTENCE_ENDS)
            end = next((at + len(mark) for mark, at in zip(SENTENCE_ENDS, ends) if at >= 0), end)
        else:
            end = n
        out.append((start, end))
        start = end - overlap if end - overlap > start else end
    return out


def chunk_bounds(text: Column, size: int, overlap: int) -> Column:
    """Array of (s, e), start and end of the passages in characters from 0; null for a null text.

    A passage ends after the last sentence end in the last fifth of its window, by the first kind that occurs there;
    else at the window's end. The next starts ``overlap`` before, or at the end where that would not move on. The walk
    is linear in the text, which a fold over substrings of UTF-8 is not, so it runs in Arrow batches.
    """

    def walk(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"s": s, "e": e} for s, e in bounds_of(t, size, overlap)] for t in texts])

    return F.pandas_udf(walk, BOUNDS)(text)


def chunks(docs: DataFrame, key: str, text: str, size_tokens: int = 400, overlap_tokens: int = 100) -> DataFrame:
    """(key, chunk_index, char_start, char_end, passage): passages stripped of outer blanks, empty ones left out."""
    size, overlap = size_tokens * 4, overlap_tokens * 4
    def cut_up(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"char_start": s, "char_end": e, "passage": t[s:e].strip()} for s, e in bounds_of(t, size, overlap)] for t in texts])

    shape = T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("passage", T.StringType())]))
    cut = docs.where(F.length(text) > 0).select(key, F.explode(F.pandas_udf(cut_up, shape)(text)).alias("b")).select(key, "b.*")
    kept = cut.where("passage <> ''")
    order = F.row_number().over(W.partitionBy(key).orderBy("char_start", "char_end")) - 1
    return kept.withColumn("chunk_index", order).select(key, "chunk_index", "char_start", "char_end", "passage")


def section_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, span_index, char_start, char_end, label, heading_text, confidence) from Markdown headings of levels 1 and 2.

    Spans cover the text without gaps: what stands before the first heading is the preamble, a heading that tells no
    section carries on the last told section, and a text without headings is one unknown span.
    """
    lines = docs.where(F.length(text) > 0).select(key, F.length(text).alias("total"), F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    by_doc = W.partitionBy(key).orderBy("n")
    start = F.coalesce(F.sum(F.length("line") + 1).over(by_doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = lines.withColumn("char_start", start).where(F.col("line").rlike(r"^#{1,2}\s+\S")).select(key, "char_start", heading_text(F.col("line")).alias("heading_text"))
    heads = heads.withColumn("told", section_of(F.col("heading_text")))
    order = W.partitionBy(key).orderBy("char_start")
    carried = F.last("told", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    label, sure = F.coalesce(carried, F.lit("unknown")), F.when(F.col("told").isNotNull(), 1.0).when(carried.isNotNull(), CONFIDENCE_SCHEME).otherwise(CONFIDENCE_FALLBACK)
    heads = heads.select(key, "char_start", "heading_text", label.alias("label"), sure.alias("confidence"))
    return build_spans(heads, docs.where(F.length(text) > 0).select(key, F.length(text).alias("total")), key)


def build_spans(heads: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, span_index, char_start, char_end, label, heading_text, confidence): from each heading to the next or the end.

    heads: key, char_start, label, heading_text, confidence; docs: key, total. What stands before the first heading is
    the preamble; a document without headings is one unknown span.
    """
    order = W.partitionBy(key).orderBy("char_start")
    placed = heads.join(docs, key).withColumn("next", F.lead("char_start").over(order)).withColumn("rank", F.row_number().over(order))
    spans = placed.select(key, "char_start", F.coalesce("next", "total").alias("char_end"), "label", "heading_text", "confidence")
    before = placed.where((F.col("rank") == 1) & (F.col("char_start") > 0)).select(key, F.lit(0).alias("char_start"), F.col("char_start").alias("char_end"), F.lit("preamble").alias("label"), F.lit("").alias("heading_text"), F.lit(1.0).alias("confidence"))
    bare = docs.join(heads.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("char_start"), F.col("total").alias("char_end"), F.lit("unknown").alias("label"), F.lit("").alias("heading_text"), F.lit(CONFIDENCE_FALLBACK).alias("confidence"))
    whole = spans.unionByName(before).unionByName(bare)
    whole = whole.select(key, *[F.col(c).cast("int") for c in ("char_start", "char_end")], "label", "heading_text", "confidence")
    return whole.withColumn("span_index", F.row_number().over(order) - 1)


def insert_abstract(spans: Column, start: Column, end: Column) -> Column:
    """Spans (struct char_start, char_end, label) with [start, end) carved out as the abstract; a span it cuts falls in up to three."""
    piece = lambda s, e, label: F.struct(s.alias("char_start"), e.alias("char_end"), label.alias("label"))
    parts = F.flatten(F.transform(spans, lambda x: F.array(piece(x["char_start"], F.least(x["char_end"], start), x["label"]), piece(F.greatest(x["char_start"], end), x["char_end"], x["label"]))))
    every = F.concat(parts, F.array(piece(start, end, F.lit("abstract"))))
    return F.array_sort(F.filter(every, lambda x: x["char_start"] < x["char_end"]))


def with_section(passages: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``section`` and ``section_confidence`` of each passage: the first span that holds its start, else unknown.

    The spans of a document travel as one array, so there is a single equi-join and no range join.
    """
    nested = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("span_index", "char_start", "char_end", "label", "confidence"))).alias("_spans"))
    hit = F.get(F.filter("_spans", lambda s: (s["char_start"] <= F.col("char_start")) & (F.col("char_start") < s["char_end"])), F.lit(0))
    return passages.join(nested, key, "left").withColumn("_hit", hit).withColumn("section", F.coalesce("_hit.label", F.lit("unknown"))).withColumn("section_confidence", F.coalesce("_hit.confidence", F.lit(CONFIDENCE_FALLBACK))).drop("_hit", "_spans")


def with_page(passages: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """``page_num`` of each passage: the last page that starts at or before it, else 1."""
    nested = pages.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("char_start", "page_num"))).alias("_pages"))
    hit = F.element_at(F.filter("_pages", lambda p: p["char_start"] <= F.col("char_start")), -1)
    return passages.join(nested, key, "left").withColumn("page_num", F.coalesce(F.when(F.size(F.filter("_pages", lambda p: p["char_start"] <= F.col("char_start"))) > 0, hit["page_num"]), F.lit(1))).drop("_pages")


def page_offsets(pages: DataFrame, key: str, text: str) -> DataFrame:
    """char_start of each page in the pages joined by line feeds; a null page counts as empty."""
    before = F.sum(F.length(F.coalesce(text, F.lit(""))) + 1).over(W.partitionBy(key).orderBy("page_num").rowsBetween(W.unboundedPreceding, -1))
    return pages.withColumn("char_start", F.coalesce(before, F.lit(0)))
