"""Completeness of an extraction and its grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions.text import has_ligatures, is_garbled, is_interleaved


def grade() -> Column:
    """Grade A to F from the counts of a completeness row.

    F: no text pages, or two or more kinds missed whole; D: one kind missed whole; A: nothing missing and sections
    found; C: captions on less than four fifths of the figures or tables; else B.
    """
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    missed = sum(
        (F.when((c(has) > 0) & (c(lacks) == 0), 1).otherwise(0) for has, lacks in (("tables_found", "tables_with_captions"), ("figures_found", "figures_with_captions"), ("figure_captions_found", "figures_found"), ("table_captions_found", "tables_found"))),
        F.lit(0),
    )
    missing = (c("figures_missing") > 0) | (c("tables_missing") > 0) | (c("figures_found") > c("figures_with_captions")) | (c("tables_found") > c("tables_with_captions"))
    poor = lambda found, captioned: (c(found) > 0) & (c(captioned) < 0.8 * c(found))
    return (
        F.when(c("text_pages") == 0, "F").when(missed >= 2, "F").when(missed == 1, "D").when(~missing & (c("sections_identified") > 0), "A")
        .when(poor("figures_found", "figures_with_captions") | poor("tables_found", "tables_with_captions"), "C").otherwise("B")
    )


def number_gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, gaps): runs (first, last) of whole numbers missing below a number that is there, in order.

    Runs, not the numbers themselves, so a number misread as a huge one costs nothing.
    """
    seen = rows.where(F.col(number) > 0).select(key, F.col(number).alias("_n")).distinct()
    before = F.coalesce(F.lag("_n").over(W.partitionBy(key).orderBy("_n")), F.lit(0))
    run = F.when(F.col("_n") > before + 1, F.struct((before + 1).cast("long").alias("first"), (F.col("_n") - 1).cast("long").alias("last")))
    return seen.withColumn("_run", run).groupBy(key).agg(F.array_sort(F.collect_list("_run")).alias("gaps"))


def unmatched_captions(captions: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Caption numbers found on pages that no object carries."""
    return captions.select(*keys).distinct().join(objects.select(*keys).distinct(), keys, "left_anti")


def repeated_captions(objects: DataFrame, key: str) -> DataFrame:
    """Captions carried by several objects of a document, continuations aside."""
    kept = objects.where(F.col("caption").isNotNull() & ~F.contains("caption", F.lit("(continued)")))
    return kept.groupBy(key, "caption").agg(F.count("*").alias("n")).where("n > 1")


def cell_quality(cells: DataFrame, key: str, cell: str) -> DataFrame:
    """(key, garbled, interleaved, ligatures): numbers of cells with each fault."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return cells.groupBy(key).agg(count(is_garbled(F.col(cell))).alias("garbled"), count(is_interleaved(F.col(cell))).alias("interleaved"), count(has_ligatures(F.col(cell))).alias("ligatures"))
