"""Queries of indexing, stores, streams, HTML, vision and box operators over the driver's tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.config import Settings
from quillstack.functions.html import html_table
from quillstack.operators import captions, geometry, indexing, layout, library_index, tables, vision
from quillstack.plans import adapters as ad
from quillstack.plans import reference
from quillstack.runtime import shared_dir, table
from quillstack.sources.index_store import IndexStore
from quillstack.streaming import intake

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillstack-{label}-{uuid.uuid4().hex}"


def paper_library(spark: SparkSession, d: str) -> DataFrame:
    """Library items with the hash of their text in the role of the file's."""
    text = ad.pages(spark, d).groupBy("item_key").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("page_num").cast("string"), F.md5(F.coalesce("markdown", F.lit("")))))), ",")).alias("hash"))
    return ad.library(spark, d).join(text, "item_key", "left").withColumn("pdf_path", F.coalesce("pdf_path", F.lit("held"))).where("hash is not null")


_TEXTS = """p AS (SELECT DISTINCT page_id, item_key, page_num, markdown FROM page_extractions WHERE page_id IS NOT NULL AND item_key IN (SELECT item_key FROM library_items)),
    k AS (SELECT item_key, count(*) AS n_pages, sum(length(coalesce(markdown, ''))) AS chars, bool_or(length(regexp_replace(coalesce(markdown, ''), '[\\s\\x{a0}]', '', 'g')) > 0) AS text FROM p GROUP BY 1)"""


@query("index_library", f"""WITH {_TEXTS} SELECT item_key, CASE WHEN text THEN 'indexed' ELSE 'empty' END AS status, CASE WHEN NOT text THEN n_pages || CASE WHEN chars = 0 THEN ' pages but no text' ELSE ' pages but no passages' END END AS reason FROM k""")
def index_library(spark: SparkSession, d: str) -> DataFrame:
    """The whole library into a new index; what became of each paper."""
    indexer = library_index.LibraryIndexer(spark, scratch(spark, "library"), Settings(embedding_dimensions=32), buckets=8)
    return indexer.run(paper_library(spark, d), ad.pages(spark, d)).results.select("item_key", "status", "reason")


@query("index_library_again", f"""WITH {_TEXTS} SELECT item_key, CASE WHEN item_key < 'H' THEN CASE WHEN text THEN 'indexed' ELSE 'empty' END ELSE 'skipped' END AS status FROM k WHERE item_key < 'H' OR NOT text""")
def index_library_again(spark: SparkSession, d: str) -> DataFrame:
    """A second run after the files of the papers below 'H' changed: these are worked on, the rest is current or known to be empty."""
    indexer = library_index.LibraryIndexer(spark, scratch(spark, "library"), Settings(embedding_dimensions=32), buckets=8)
    papers, pages = paper_library(spark, d), ad.pages(spark, d)
    indexer.run(papers, pages)
    return indexer.run(papers.withColumn("hash", F.when(F.col("item_key") < "H", F.concat("hash", F.lit("+"))).otherwise(F.col("hash"))), pages).results.select("item_key", "status")


@query("index_build", f"""{reference.CHUNKS_SQL}, {reference.TABLES_SQL}, ok AS (SELECT DISTINCT item_key FROM document_extractions WHERE full_markdown IS NOT NULL), {reference.ARTIFACTS_SQL}
    SELECT format('{{}}_chunk_{{:04d}}', item_key, chunk_index) AS chunk_id, 'text' AS chunk_type, item_key AS doc_id FROM pieces
    UNION ALL SELECT format('{{}}_table_{{:04d}}_{{:02d}}', item_key, page_num, table_index), 'table', item_key FROM kinds WHERE artifact_type IS NULL AND item_key IN (SELECT item_key FROM ok)
    UNION ALL SELECT format('{{}}_fig_{{:03d}}_{{:02d}}', item_key, page_num, n), 'figure', item_key FROM (SELECT item_key, page_num, unnest(range(0, images_on_page)) AS n FROM (SELECT DISTINCT page_id, item_key, page_num, images_on_page FROM page_extractions WHERE page_id IS NOT NULL)) WHERE item_key IN (SELECT item_key FROM ok)""")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the index rows of all documents: passages, real tables, figures."""
    meta = ad.library(spark, d).withColumnRenamed("title", "doc_title").drop("pdf_path")
    grades = table(spark, d, "document_extractions").groupBy("item_key").agg(F.max("quality_grade").alias("quality_grade"))
    docs = ad.documents(spark, d)
    meta = docs.select("item_key").join(meta, "item_key", "left").join(grades, "item_key", "left").withColumn("pdf_hash", F.lit(None).cast("string"))
    return library_index.index_rows(docs, ad.pages(spark, d), meta, indexing.HashedWords(32)).select("chunk_id", "chunk_type", "doc_id")


@query("index_store", "SELECT DISTINCT chunk_id, item_key AS doc_id, CASE WHEN item_key < 'N' THEN 'new' ELSE 'old' END AS version FROM chunks WHERE item_key < 'T'")
def index_store(spark: SparkSession, d: str) -> DataFrame:
    """Write, replace the documents below 'N', delete those from 'T' on, read."""
    rows = ad.passages(spark, d).select("chunk_id", F.col("item_key").alias("doc_id"), F.lit("text").alias("chunk_type"))
    store = IndexStore(spark, scratch(spark, "store"), 8)
    store.write(rows.withColumn("version", F.lit("old")))
    changed = rows.where("doc_id < 'N'").withColumn("version", F.lit("new"))
    store.replace(changed, changed)
    store.delete(rows.where("doc_id >= 'T'"))
    return store.read().select("chunk_id", "doc_id", "version")


@query("stream_intake", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_intake(spark: SparkSession, d: str) -> DataFrame:
    """All events through a stream of files, each file once; then the latest event of each user."""
    home = scratch(spark, "stream")
    table(spark, d, "events").select("event_id", "user_id").repartition(4).write.parquet(f"{home}/in")
    stream = intake.new_documents(spark, f"{home}/in", "event_id long, user_id long", max_files=2)
    intake.index_stream(stream, lambda df: intake.latest_only(df, "user_id", "event_id"), f"{home}/out", f"{home}/check").awaitTermination()
    return intake.latest_only(spark.read.schema("user_id long, event_id long, batch int").parquet(f"{home}/out").select("user_id", "event_id"), "user_id", "event_id")


@query("html_tables", """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber % 4 = 0 AS wide, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
    SELECT l_orderkey, 'part¦supplier' AS headers, string_agg(l_partkey || '¦' || CASE WHEN wide THEN l_partkey ELSE l_suppkey END, '¶' ORDER BY i) AS rows, 'note & more' AS footnotes FROM l GROUP BY 1""")
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every order's lines as an HTML table with heads, spans, entities and a note below."""
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = table(spark, d, "lineitem").withColumn("i", n)
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    cell = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("<tr><td colspan='2'>"), part, F.lit("</td></tr>"))).otherwise(F.concat(F.lit("<tr><td>"), part, F.lit("</td><td> "), supplier, F.lit("\n</td></tr>")))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", cell.alias("c")))), lambda x: x["c"]), "")
    html = lines.groupBy("l_orderkey").agg(F.concat(F.lit("<table><tr><th>part</th><th>supplier</th></tr>"), rows, F.lit("</table>note &amp; more")).alias("h"))
    flat = F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "¦")), "¶")
    return html.select("l_orderkey", html_table("h").alias("t")).select("l_orderkey", F.array_join("t.headers", "¦").alias("headers"), flat.alias("rows"), "t.footnotes")


@query("vision_parse", """SELECT p_partkey, p_partkey % 3 <> 0 AS parse_success, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '' END AS caption, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END AS headers,
    CASE WHEN p_partkey % 3 <> 0 THEN p_type ELSE '' END AS rows, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS is_incomplete, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS recrop_needed, CASE WHEN p_partkey % 3 <> 0 THEN p_size + 0.5 END AS bottom FROM part""")
def vision_parse(spark: SparkSession, d: str) -> DataFrame:
    """Answers in a fence with prose around them, and answers without a table."""
    odd = F.col("p_partkey") % 2 == 0
    recrop = F.struct(odd.alias("needed"), F.array(F.lit(0.0), F.lit(0.0), F.lit(50.0), F.col("p_size") + 0.5).alias("bbox_pct")).alias("recrop")
    good = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array("p_brand").alias("headers"), F.array(F.array("p_type")).alias("rows"), F.col("p_name").alias("caption"), odd.alias("is_incomplete"), recrop)), F.lit("\n```"))
    answers = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, good).otherwise("no table here").alias("a"))
    return answers.select("p_partkey", vision.parsed_response("a").alias("r")).select("p_partkey", "r.parse_success", "r.caption", F.array_join("r.headers", "¦").alias("headers"), F.array_join(F.flatten("r.rows"), "¦").alias("rows"), "r.is_incomplete", "r.recrop_needed", F.get("r.recrop_bbox_pct", F.lit(3)).alias("bottom"))


class PagesOnly:
    """A model without eyes: crops of odd ids are incomplete, pages give a table."""

    def answer(self, requests: list[dict]) -> list[str]:
        return [json.dumps({"headers": ["a"], "rows": [[r["request_id"]]] if r["scope"] == "page" or r["n"] % 2 == 0 else [], "is_incomplete": r["scope"] != "page" and r["n"] % 2 == 1}) for r in requests]


@query("vision_waves", "SELECT p_partkey::VARCHAR AS request_id, CASE WHEN p_partkey % 2 = 1 THEN 'page' ELSE 'crop' END AS wave FROM part")
def vision_waves(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("request_id"), F.col("p_partkey").alias("n"))
    return vision.waves(asked, PagesOnly()).select("request_id", "wave")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as boxes from top to bottom."""
    y = F.col("l_linenumber") * 100.0
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return lines.select("l_orderkey", F.col("l_linenumber").alias("object_id"), F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(80.0).alias("x1"), (y + 60.0).alias("y1"))


@query("caption_assign", "SELECT DISTINCT l_orderkey, l_linenumber AS object_id, 'Figure ' || dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) || '.' AS caption FROM lineitem")
def caption_assign(spark: SparkSession, d: str) -> DataFrame:
    objects = boxes(spark, d)
    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy("object_id"))
    found = objects.select("l_orderkey", (F.col("y1") + 5.0).alias("y"), F.concat(F.lit("Figure "), rank.cast("string"), F.lit(".")).alias("caption"), "x0", "y0", "x1", "y1")
    return captions.assign_captions(objects, found, ["l_orderkey"]).select("l_orderkey", "object_id", "caption")


@query("captions_above", "SELECT l_orderkey, l_linenumber AS region_id, CASE WHEN l_linenumber % 2 = 1 THEN 'C' || l_linenumber END AS caption FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber <= 2 AND (l_linenumber = 1 OR (l_orderkey, 1) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem))")
def captions_above(spark: SparkSession, d: str) -> DataFrame:
    lines = boxes(spark, d)
    with_first = lines.where("object_id = 1").select("l_orderkey")
    regions = lines.where("object_id <= 2").join(with_first, "l_orderkey", "left_semi").select("l_orderkey", F.col("object_id").alias("region_id"), "y0", F.lit(1000.0).alias("page_height"))
    found = lines.where("object_id = 1").select("l_orderkey", (F.col("y0") - 5.0).alias("y"), F.lit(1000.0).alias("page_height"), F.lit("C1").alias("caption"))
    return captions.captions_above(regions, found, ["l_orderkey"]).select("l_orderkey", "region_id", "caption")


@query("orphan_recovery", "SELECT l_orderkey, l_linenumber AS object_id, CASE WHEN l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 'lost' END AS caption FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def orphan_recovery(spark: SparkSession, d: str) -> DataFrame:
    objects = boxes(spark, d).select("l_orderkey", F.lit(1).alias("page_num"), "object_id", F.col("y0").alias("y"))
    floating = objects.groupBy("l_orderkey", "page_num").agg(F.lit("lost").alias("caption"), (F.min("y") + 1.0).alias("y"))
    return captions.recover_orphans(objects, floating, "l_orderkey").select("l_orderkey", "object_id", "caption")


@query("figure_boxes", "SELECT l_orderkey, count(*) AS n, min(l_linenumber) * 100.0 AS top FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber - dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM lineitem) GROUP BY l_orderkey, g")
def figure_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes 40 apart run together, those of missing lines part them."""
    merged = geometry.figure_boxes(boxes(spark, d).drop("object_id"), boxes(spark, d).limit(0).select("l_orderkey", F.col("y0").alias("y"), "x0", "x1"), ["l_orderkey"])
    return merged.select("l_orderkey", F.round((F.col("y1") - F.col("y0") + 40) / 100).cast("long").alias("n"), F.col("y0").alias("top"))


@query("figure_splits", """WITH c AS (SELECT p_partkey, p_size * 30.0::DOUBLE AS h, [150.0::DOUBLE, 2000.0::DOUBLE, 2015.0::DOUBLE, 2300.0::DOUBLE] AS ys FROM part),
    i AS (SELECT p_partkey, h, list_filter(ys, lambda y: y < h) AS cuts FROM c),
    b AS (SELECT p_partkey, h, unnest(list_zip([0.0::DOUBLE] || list_transform(cuts, lambda y: y + 40), cuts || [h])) AS z, len(cuts) AS n FROM i),
    k AS (SELECT p_partkey, h, z[1] AS y0, z[2] AS y1 FROM b WHERE n = 0 OR z[2] - z[1] > 100),
    t AS (SELECT p_partkey, max(h) AS h, count(*) AS n, sum(y1 - y0) AS high FROM k GROUP BY 1),
    s AS (SELECT p_partkey, unnest([2000.0::DOUBLE, 2300.0::DOUBLE]) AS y FROM t WHERE n < 4 AND high >= 1000)
    SELECT p_partkey, y0, y1 FROM k UNION ALL SELECT p_partkey, 0.0, h FROM i WHERE p_partkey NOT IN (SELECT p_partkey FROM k) UNION ALL SELECT p_partkey, y - 200, y - 10 FROM s""")
def figure_splits(spark: SparkSession, d: str) -> DataFrame:
    """One tall box a part and four captions: one in the box, three below it, two of these near to each other."""
    part = table(spark, d, "part")
    tall = part.select("p_partkey", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), (F.col("p_size") * 30.0).alias("y1"))
    found = part.select("p_partkey", F.explode(F.array(*map(F.lit, (150.0, 2000.0, 2015.0, 2300.0)))).alias("y"), F.lit(10.0).alias("x0"), F.lit(90.0).alias("x1"))
    return geometry.figure_boxes(tall, found, ["p_partkey"]).select("p_partkey", "y0", "y1")


@query("figure_data_tables", "SELECT DISTINCT l_orderkey, l_linenumber AS object_id FROM lineitem WHERE l_linenumber % 2 = 0")
def figure_data_tables(spark: SparkSession, d: str) -> DataFrame:
    found = boxes(spark, d).withColumn("caption", F.lit(None).cast("string"))
    figures = boxes(spark, d).where("object_id % 2 = 0").withColumn("y1", F.col("y0") + 40.0)
    return tables.figure_data_tables(found, figures, ["l_orderkey"]).select("l_orderkey", "object_id")


@query("recrop_boxes", "SELECT p_partkey, round(p_size * 0.1::DOUBLE, 6) AS x0, round(p_size * 0.25::DOUBLE, 6) AS y1 FROM part")
def recrop_boxes(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    box = geometry.recrop(F.lit(0.0), F.lit(0.0), size, size, F.array(F.lit(10.0), F.lit(-5.0), F.lit(200.0), F.lit(25.0)))
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", F.round("b.x0", 6).alias("x0"), F.round("b.y1", 6).alias("y1"))


@query("gap_captions", """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem), k AS (SELECT l_orderkey, min(n) FILTER (n <> 2) < 2 AND max(n) FILTER (n <> 2) > 2 AS inner_gap FROM l GROUP BY 1)
    SELECT l_orderkey, n AS object_id, n AS page_num, CASE WHEN n <> 2 OR inner_gap THEN n END AS number, CASE WHEN n <> 2 OR inner_gap THEN 'Table ' || n END AS caption FROM l JOIN k USING (l_orderkey)""")
def gap_captions(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    keep = F.col("l_linenumber") != 2
    objects = lines.select("l_orderkey", F.col("l_linenumber").alias("object_id"), F.col("l_linenumber").alias("page_num"), F.when(keep, F.col("l_linenumber")).alias("number"), F.when(keep, F.concat(F.lit("Table "), F.col("l_linenumber").cast("string"))).alias("caption"))
    found = lines.select("l_orderkey", F.col("l_linenumber").alias("page_num"), F.col("l_linenumber").alias("number"), F.concat(F.lit("Table "), F.col("l_linenumber").cast("string")).alias("caption"))
    return layout.gap_captions(objects, found, "l_orderkey")


@query("request_batches")
def request_batches(spark: SparkSession, d: str) -> DataFrame:
    return layout.request_batches(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 500).drop("partition")


@query("table_round_trip", """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
    SELECT l_orderkey, 'part¦supplier' AS headers, string_agg(l_partkey || '¦' || l_suppkey, '¶' ORDER BY i) AS rows, 'Table 1. Lines' AS caption FROM l GROUP BY 1""")
def table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows to a Markdown table and back."""
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("i", F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("r")))), lambda x: x["r"])
    rows = table(spark, d, "lineitem").withColumn("i", n).groupBy("l_orderkey").agg(cells.alias("rows"))
    text = rows.select("l_orderkey", tables.to_markdown(F.array(F.lit("part"), F.lit("supplier")), F.col("rows"), F.lit("Table 1. Lines"), F.lit("note")).alias("markdown"))
    return tables.markdown_tables(text, ["l_orderkey"]).select("l_orderkey", F.array_join("headers", "¦").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "¦")), "¶").alias("rows"), "caption")
