"""References to tables and figures in running text, and the passages that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = (("table", r"(?i)(?:Table|Tab\.?)\s+(\d+)"), ("figure", r"(?i)(?:Figure|Fig\.?)\s+(\d+)"))


def first_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, number, char_offset) of the first mention of each numbered table and figure."""
    found = None
    for kind, pattern in KINDS:
        # the text between two mentions and the mention itself alternate, so offsets are running sums of lengths
        rows = docs.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("num"))
        rows = rows.where(F.size("m") > 0).select(key, F.split("_t", pattern, -1).alias("gap"), "m", "num")
        rows = rows.select(key, F.posexplode(F.arrays_zip(F.slice("gap", F.lit(1), F.size("m")).alias("gap"), F.col("m").alias("m"), F.col("num").alias("num"))).alias("n", "x"))
        before = F.sum(F.length("x.gap") + F.length("x.m")).over(W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, -1))
        rows = rows.select(key, F.lit(kind).alias("kind"), F.col("x.num").try_cast("int").alias("number"), (F.coalesce(before, F.lit(0)) + F.length("x.gap")).cast("int").alias("char_offset"))
        rows = rows.where("number is not null").groupBy(key, "kind", "number").agg(F.min("char_offset").alias("char_offset"))
        found = rows if found is None else found.unionByName(rows)
    return found


def reference_chunks(references: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """(key, kind, number, chunk_index): the passage in which the first mention stands (the last that starts at or before it)."""
    nested = passages.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("char_start", "chunk_index"))).alias("_c"))
    at = F.filter("_c", lambda c: c["char_start"] <= F.col("char_offset"))
    return references.join(nested, key).select(key, "kind", "number", F.when(F.size(at) > 0, F.element_at(at, -1)["chunk_index"]).otherwise(0).alias("chunk_index"))


def anchors(objects: DataFrame, references: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Objects (key, kind, number, page_num) with the chunk that mentions them first, else the first chunk of their page, else -1."""
    mentioned = reference_chunks(references, passages, key).withColumnRenamed("chunk_index", "_m")
    first_on_page = passages.groupBy(key, "page_num").agg(F.min("chunk_index").alias("_p"))
    return objects.join(mentioned, [key, "kind", "number"], "left").join(first_on_page, [key, "page_num"], "left").withColumn("chunk_index", F.coalesce("_m", "_p", F.lit(-1))).drop("_m", "_p")


def table_mention(index: DataFrame, doc_id: str, caption_number: str | None) -> DataFrame:
    """The first text passage of a document that mentions the table (any table without a number)."""
    pattern = rf"(?i)\bTable\s+{caption_number}" if caption_number else r"(?i)\bTable\b"
    return index.where((F.col("doc_id") == doc_id) & (F.col("chunk_type") == "text") & F.col("passage").rlike(pattern)).orderBy("chunk_index").limit(1)
