"""Driver tables in the roles of the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.operators import tables as tables_op
from quillstack.runtime import table

QUERY_CHUNK = "(SELECT embeddings FROM usable ORDER BY chunk_id LIMIT 1)"

#: The same index in DuckDB's SQL.
INDEX_SQL = """
    c AS (SELECT DISTINCT chunk_id, item_key, chunk_index, page_num, section, section_confidence, char_start, char_end, embeddings FROM chunks),
    l AS (SELECT item_key, min(title) AS doc_title, min(authors) AS authors, min(year) AS year, min(citation_key) AS citation_key, min(publication) AS publication, min(doi) AS doi,
                 min(tags) AS tags, min(collections) AS collections, min(journal_quartile) AS journal_quartile FROM library_items GROUP BY item_key),
    e AS (SELECT DISTINCT item_key, full_markdown FROM document_extractions WHERE full_markdown IS NOT NULL),
    idx AS (SELECT c.chunk_id, 'text' AS chunk_type, c.item_key AS doc_id, c.chunk_index, c.page_num, coalesce(c.section, 'unknown') AS section, c.section_confidence, c.char_start, c.char_end,
                   substring(e.full_markdown, c.char_start + 1, c.char_end - c.char_start) AS passage, c.embeddings, l.* EXCLUDE (item_key)
            FROM c LEFT JOIN l USING (item_key) LEFT JOIN e USING (item_key)),
    usable AS (SELECT * FROM idx WHERE len(embeddings) = 96 AND list_dot_product(embeddings::DOUBLE[], embeddings::DOUBLE[]) > 0)
"""


def library(spark: SparkSession, d: str) -> DataFrame:
    """One row per item."""
    names = ("title", "authors", "year", "citation_key", "publication", "doi", "tags", "collections", "journal_quartile", "pdf_path")
    return table(spark, d, "library_items").groupBy("item_key").agg(*[F.min(c).alias(c) for c in names])


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_extractions").where("full_markdown is not null").select("item_key", "full_markdown", "config_id").dropDuplicates(["item_key"])


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_extractions").where("page_id is not null").dropDuplicates(["page_id"])


def passages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once each, their text cut from the document."""
    c = table(spark, d, "chunks").where("chunk_id is not null").dropDuplicates(["chunk_id"]).withColumn("section", F.coalesce("section", F.lit("unknown")))
    text = documents(spark, d).select("item_key", "full_markdown")
    return c.join(text, "item_key", "left").withColumn("passage", F.substring(F.col("full_markdown"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("full_markdown")


def index(spark: SparkSession, d: str) -> DataFrame:
    """Text passages with their document's attributes and vectors."""
    docs = library(spark, d).withColumnRenamed("title", "doc_title").drop("pdf_path")
    rows = passages(spark, d).join(docs, "item_key", "left").withColumn("chunk_type", F.lit("text"))
    return rows.withColumnRenamed("item_key", "doc_id").withColumnRenamed("embeddings", "embedding")


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the smallest chunk id that has a usable one: one row."""
    usable = (F.size("embeddings") == 96) & (F.aggregate("embeddings", F.lit(0.0), lambda a, x: a + x.cast("double") * x) > 0)
    row = table(spark, d, "chunks").where(usable).select("chunk_id", "embeddings").orderBy("chunk_id").first()
    return list(row["embeddings"]) if row else [0.0] * 96


def object_index(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Tables of the pages (or pages with images as figures) as index rows; their vector is that of the first chunk of the page."""
    first = table(spark, d, "chunks").where(F.size("embeddings") == 96).groupBy("item_key", "page_num").agg(F.min_by(F.struct("chunk_id", "chunk_index", "embeddings"), F.struct("chunk_index", "chunk_id")).alias("f"))
    if kind == "table":
        found = tables_op.markdown_tables(pages(spark, d), ["item_key", "page_num"]).withColumn("passage", tables_op.to_markdown(F.col("headers"), F.col("rows"), F.col("caption"), F.lit(None).cast("string"))).withColumn("number", F.col("table_index"))
    else:
        found = pages(spark, d).where("images_on_page > 0").select("item_key", "page_num", F.explode(F.sequence(F.lit(0), F.col("images_on_page") - 1)).alias("number")).withColumn("caption", F.concat(F.lit("Figure on page "), F.col("page_num").cast("string"))).withColumn("passage", F.col("caption"))
    docs = library(spark, d).withColumnRenamed("title", "doc_title").drop("pdf_path")
    rows = found.join(first, ["item_key", "page_num"]).join(docs, "item_key", "left")
    return rows.select(F.format_string("%s_%s_%04d_%02d", "item_key", F.lit(kind), "page_num", "number").alias("chunk_id"), F.lit(kind).alias("chunk_type"), F.col("item_key").alias("doc_id"), "f.chunk_index", "page_num", F.lit(kind).alias("section"), F.lit(1.0).alias("section_confidence"), F.col("number").alias("object_index"), "caption", "passage", F.col("f.embeddings").alias("embedding"), "doc_title", "authors", "year", "citation_key", "publication", "tags", "collections", "journal_quartile")


def creators(spark: SparkSession, d: str) -> DataFrame:
    """Authors of orders: the suppliers of its lines, in line order."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("lastname"), F.substring("s_name", 1, 1).alias("firstname"))
    order = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return lines.withColumn("orderindex", order).join(s, "l_suppkey").withColumnRenamed("l_orderkey", "itemid")


def costs(spark: SparkSession, d: str) -> DataFrame:
    """Events as entries of a cost log."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("table_id"), k.alias("input_tokens"), (k * 2).alias("output_tokens"), (k * 3).alias("cache_write_tokens"), (k * 4).alias("cache_read_tokens"), F.col("value").alias("cost_usd"))


def cites(spark: SparkSession, d: str) -> DataFrame:
    """Orders cite the parts on their lines."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.min("l_linenumber").alias("position"))


def works(spark: SparkSession, d: str) -> DataFrame:
    counts = cites(spark, d).groupBy(F.col("dst").alias("p_partkey")).agg(F.count("*").alias("cited_by_count"))
    return table(spark, d, "part").join(counts, "p_partkey", "left").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("authors"), (F.lit(1990) + F.col("p_size")).alias("year"), F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string")).alias("doi"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"))
