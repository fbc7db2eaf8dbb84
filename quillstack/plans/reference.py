"""Queries of the engine's own operators over the driver's tables, with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.operators import captions, chunking, citations, completeness, geometry, indexing, journals, layout, library, reference, search, stats, tables
from quillstack.plans import adapters as ad
from quillstack.plans.adapters import INDEX_SQL, QUERY_CHUNK
from quillstack.runtime import table
from quillstack.sources import index_store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def _score(e: str = "embeddings") -> str:
    return f"list_cosine_similarity({e}::DOUBLE[], {QUERY_CHUNK}::DOUBLE[])"


def _weights(d: dict) -> str:
    return " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items())


_SEC = f"(CASE section {_weights(search.SECTION_WEIGHTS)} ELSE 0.7 END)"
_JOU = f"(CASE journal_quartile {_weights(search.QUARTILE_WEIGHTS)} ELSE 0.7 END)"
_COMP = f"power(greatest(score, 0), 0.7) * {_SEC} * {_JOU}"


@query("cosine_topk", f"WITH {INDEX_SQL} SELECT chunk_id, round({_score()}, 6) AS score FROM usable ORDER BY {_score()} DESC, chunk_id LIMIT 50")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.cosine_top_k(ad.index(spark, d), ad.query_vector(spark, d), 50).select("chunk_id", F.round("score", 6).alias("score"))


@query("rerank", f"WITH {INDEX_SQL}, h AS (SELECT *, {_score()} AS score FROM usable ORDER BY score DESC, chunk_id LIMIT 150) SELECT chunk_id, round(score, 6) AS score, round({_COMP}, 6) AS composite_score FROM h WHERE {_COMP} > 0 ORDER BY {_COMP} DESC, score DESC, chunk_id LIMIT 50")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    return search.rerank(search.cosine_top_k(ad.index(spark, d), ad.query_vector(spark, d), 150), 50).select("chunk_id", F.round("score", 6).alias("score"), F.round("composite_score", 6).alias("composite_score"))


_FILTERED = f"""WITH {INDEX_SQL}, h AS (SELECT *, {_score()} AS score FROM usable WHERE year >= 2000 AND (year IS NULL OR year <= 2022) ORDER BY score DESC, chunk_id LIMIT 90),
    t AS (SELECT * FROM h WHERE contains(lower(coalesce(authors, '')), 'a')),
    x AS (SELECT t.*, (SELECT coalesce(string_agg(n.passage, chr(10) || chr(10) ORDER BY n.chunk_index), '') FROM idx n WHERE n.doc_id = t.doc_id AND n.chunk_index BETWEEN t.chunk_index - 1 AND t.chunk_index + 1 AND n.chunk_index >= 0 AND n.passage IS NOT NULL) AS around FROM t)
"""


@query("search_passages", f"{_FILTERED} SELECT chunk_id, doc_id, chunk_index, round(score, 6) AS score, round({_COMP}, 6) AS composite_score, length(around) AS context_length FROM x WHERE {_COMP} > 0 ORDER BY {_COMP} DESC, score DESC, chunk_id LIMIT 10")
def search_passages(spark: SparkSession, d: str) -> DataFrame:
    out = search.search_passages(ad.index(spark, d), ad.query_vector(spark, d), year_min=2000, year_max=2022, author="A")
    return out.select("chunk_id", "doc_id", "chunk_index", F.round("score", 6).alias("score"), F.round("composite_score", 6).alias("composite_score"), F.length("full_context").cast("long").alias("context_length"))


@query("required_terms", f"WITH {INDEX_SQL} SELECT chunk_id FROM idx WHERE regexp_matches(passage, '(?i)\\b(pattern)\\b') AND regexp_matches(passage, '(?i)\\b(sample)\\b')")
def required_terms(spark: SparkSession, d: str) -> DataFrame:
    return ad.index(spark, d).where(tx.has_terms(F.col("passage"), ["Pattern", "sample"])).select("chunk_id")


@query("text_filters", f"WITH {INDEX_SQL} SELECT chunk_id FROM idx WHERE (year IS NULL OR year <= 2010) AND contains(lower(coalesce(tags, '')), 'survey') AND contains(lower(coalesce(collections, '')), 'group')")
def text_filters(spark: SparkSession, d: str) -> DataFrame:
    return search.text_filter(search.native_filter(ad.index(spark, d), year_max=2010, chunk_types=["text"]), tag="Survey", collection="GROUP").select("chunk_id")


@query("search_topic", f"""WITH {INDEX_SQL}, h AS (SELECT *, {_score()} AS score FROM usable ORDER BY score DESC, chunk_id LIMIT 150), r AS (SELECT *, {_COMP} AS comp FROM h WHERE {_COMP} > 0)
    SELECT doc_id, round(avg(score), 3) AS avg_score, round(max(score), 3) AS best_chunk_score, round(avg(comp), 3) AS avg_composite_score, round(max(comp), 3) AS best_composite_score, count(*) AS num_relevant_chunks
    FROM r GROUP BY doc_id ORDER BY round(avg(comp), 3) DESC, doc_id LIMIT 10""")
def search_topic(spark: SparkSession, d: str) -> DataFrame:
    return search.search_topic(ad.index(spark, d), ad.query_vector(spark, d)).select("doc_id", "avg_score", "best_chunk_score", "avg_composite_score", "best_composite_score", "num_relevant_chunks")


def _objects(found: str) -> str:
    """Objects of pages with the vector of the page's first chunk, scored."""
    return f"""{INDEX_SQL}, fc AS (SELECT item_key, page_num, arg_min(embeddings, (chunk_index, chunk_id)) AS v FROM c WHERE len(embeddings) = 96 GROUP BY 1, 2), ob AS ({found}),
    sc AS (SELECT ob.*, list_cosine_similarity(v::DOUBLE[], {QUERY_CHUNK}::DOUBLE[]) AS score, journal_quartile FROM ob JOIN fc USING (item_key, page_num) LEFT JOIN l USING (item_key) WHERE list_dot_product(v::DOUBLE[], v::DOUBLE[]) > 0)"""


@query("search_figures", f"""WITH {_objects("SELECT item_key, page_num, format('{}_figure_{:04d}_{:02d}', item_key, page_num, n) AS chunk_id, 'Figure on page ' || page_num AS caption FROM (SELECT item_key, page_num, unnest(range(0, images_on_page)) AS n FROM (SELECT DISTINCT page_id, item_key, page_num, images_on_page FROM page_extractions WHERE page_id IS NOT NULL))")}
    SELECT chunk_id, caption, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, chunk_id LIMIT 30""")
def search_figures(spark: SparkSession, d: str) -> DataFrame:
    return search.search_objects(ad.object_index(spark, d, "figure"), ad.query_vector(spark, d), "figure", 30).select("chunk_id", "caption", F.round("score", 6).alias("score"))


@query("search_tables")
def search_tables(spark: SparkSession, d: str) -> DataFrame:
    return search.search_objects(ad.object_index(spark, d, "table"), ad.query_vector(spark, d), "table", 30).select("chunk_id", "caption", F.round("score", 6).alias("score"), F.round("composite_score", 6).alias("composite_score"))


@query("context_window", f"""WITH {INDEX_SQL}, h AS (SELECT *, {_score()} AS score FROM usable ORDER BY score DESC, chunk_id LIMIT 50), n AS (SELECT h.chunk_id, x.chunk_index < h.chunk_index AS before, x.chunk_index AS i, x.passage FROM h JOIN idx x ON x.doc_id = h.doc_id AND x.chunk_index <> h.chunk_index AND x.chunk_index >= 0 AND x.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2)
    SELECT h.chunk_id, coalesce(max(b.before_text), '') AS before, coalesce(max(b.after_text), '') AS after FROM h LEFT JOIN (SELECT chunk_id, string_agg(passage, '¶' ORDER BY i) FILTER (before) AS before_text, string_agg(passage, '¶' ORDER BY i) FILTER (NOT before) AS after_text FROM n GROUP BY 1) b USING (chunk_id) GROUP BY 1""")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    index = ad.index(spark, d)
    hits = search.cosine_top_k(index, ad.query_vector(spark, d), 50)
    return search.with_context(hits, index, 2).select("chunk_id", F.array_join("context_before", "¶").alias("before"), F.array_join("context_after", "¶").alias("after"))


@query("passage_context", f"WITH {INDEX_SQL}, f AS (SELECT min(doc_id) AS k FROM idx) SELECT chunk_id, chunk_index, chunk_index = 2 AS is_center FROM idx, f WHERE doc_id = k AND chunk_index BETWEEN 0 AND 4")
def passage_context(spark: SparkSession, d: str) -> DataFrame:
    index = ad.index(spark, d)
    return search.passage_window(index, index.agg(F.min("doc_id")).first()[0], 2).select("chunk_id", "chunk_index", "is_center")


_CHUNKS = """WITH RECURSIVE e AS (SELECT DISTINCT item_key, full_markdown AS t, length(full_markdown) AS n FROM document_extractions WHERE length(full_markdown) > 0),
    step AS (SELECT item_key, t, n, 0 AS s, CASE WHEN 1600 >= n THEN n ELSE NULL END AS e0 FROM e
        UNION ALL
        SELECT item_key, t, n, nxt AS s, CASE WHEN nxt + 1600 >= n THEN n ELSE NULL END FROM (
            SELECT item_key, t, n, s, fin, CASE WHEN fin - 400 > s THEN fin - 400 ELSE fin END AS nxt FROM (SELECT *, {fin} AS fin FROM step)) WHERE nxt < n),
    b AS (SELECT item_key, t, s, {fin} AS fin FROM step)
    SELECT item_key, (row_number() OVER (PARTITION BY item_key ORDER BY s, fin) - 1)::INT AS chunk_index, s::INT AS char_start, fin::INT AS char_end FROM b
    WHERE length(regexp_replace(substring(t, s + 1, fin - s), '[\\s\\x{{a0}}]', '', 'g')) > 0"""
_MARKS = ["' .'", "chr(10) || '.'", "' ?'", "chr(10) || '?'", "' !'", "chr(10) || '!'"]
_FIN = "coalesce(e0, " + ", ".join(f"CASE WHEN instr(reverse(substring(t, s + 1281, 320)), {m}) > 0 THEN s + 1280 + length(substring(t, s + 1281, 320)) - instr(reverse(substring(t, s + 1281, 320)), {m}) + 1 END" for m in _MARKS) + ", s + 1600)"


_HEAD, _TAIL = _CHUNKS.format(fin=_FIN).rsplit("\n    SELECT item_key, (row_number()", 1)
CHUNKS_SQL = f"{_HEAD},\n    pieces AS (SELECT item_key, (row_number(){_TAIL})"


@query("chunk_documents", f"{CHUNKS_SQL} SELECT * FROM pieces")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.documents(spark, d).repartition("item_key")
    return chunking.chunks(docs, "item_key", "full_markdown").select("item_key", "chunk_index", "char_start", "char_end")


_TOLD = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(h, '{w}')" for w in words)} THEN '{label}'" for label, words in tx.SECTION_WORDS) + f" WHEN contains(h, 'summary') AND ({' OR '.join(f"contains(h, '{w}')" for w in tx.SUMMARY_OF_RESULTS)}) THEN 'results' WHEN contains(h, 'summary') THEN 'conclusion' END"
_SPANS = f"""e AS (SELECT DISTINCT item_key, full_markdown AS t, length(full_markdown) AS total FROM document_extractions WHERE length(full_markdown) > 0),
    p AS (SELECT item_key, total, string_split(t, chr(10)) AS ls FROM e), l AS (SELECT item_key, total, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM p),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY item_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
    hd AS (SELECT *, trim(regexp_replace(line, '^#+\\s*', '')) AS heading_text, lower(line) AS h FROM o WHERE regexp_matches(line, '^#{{1,2}}\\s+\\S')), tl AS (SELECT *, {_TOLD} AS told FROM hd),
    ct AS (SELECT *, last_value(told IGNORE NULLS) OVER (PARTITION BY item_key ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried, coalesce(lead(s) OVER (PARTITION BY item_key ORDER BY s), total) AS e1, row_number() OVER (PARTITION BY item_key ORDER BY s) AS r FROM tl),
    sp AS (SELECT item_key, s::INT AS char_start, e1::INT AS char_end, coalesce(carried, 'unknown') AS label, heading_text, CASE WHEN told IS NOT NULL THEN 1.0 WHEN carried IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM ct
        UNION ALL SELECT item_key, 0, s::INT, 'preamble', '', 1.0 FROM ct WHERE r = 1 AND s > 0
        UNION ALL SELECT item_key, 0, total::INT, 'unknown', '', 0.5 FROM e WHERE item_key NOT IN (SELECT item_key FROM hd)),
    spans AS (SELECT *, (row_number() OVER (PARTITION BY item_key ORDER BY char_start) - 1)::INT AS span_index FROM sp)"""


@query("section_spans", f"WITH {_SPANS} SELECT * FROM spans")
def section_spans(spark: SparkSession, d: str) -> DataFrame:
    return chunking.section_spans(ad.documents(spark, d), "item_key", "full_markdown")


@query("section_assign", f"""WITH {_SPANS}, c AS (SELECT DISTINCT chunk_id, item_key, char_start FROM chunks)
    SELECT c.chunk_id, coalesce(arg_min(label, span_index), 'unknown') AS section, coalesce(arg_min(confidence, span_index), 0.5) AS section_confidence
    FROM c LEFT JOIN spans ON spans.item_key = c.item_key AND spans.char_start <= c.char_start AND c.char_start < spans.char_end GROUP BY 1""")
def section_assign(spark: SparkSession, d: str) -> DataFrame:
    spans = chunking.section_spans(ad.documents(spark, d), "item_key", "full_markdown")
    return chunking.with_section(ad.passages(spark, d).select("chunk_id", "item_key", "char_start"), spans, "item_key").select("chunk_id", "section", "section_confidence")


@query("page_assign", """WITH p AS (SELECT DISTINCT page_id, item_key, page_num, char_start AS ps FROM page_extractions WHERE page_id IS NOT NULL), c AS (SELECT DISTINCT chunk_id, item_key, char_start FROM chunks)
    SELECT chunk_id, coalesce(arg_max(page_num, (ps, page_num)), 1) AS page_num FROM c LEFT JOIN p ON p.item_key = c.item_key AND p.ps <= c.char_start GROUP BY chunk_id""")
def page_assign(spark: SparkSession, d: str) -> DataFrame:
    return chunking.with_page(ad.passages(spark, d).select("chunk_id", "item_key", "char_start"), ad.pages(spark, d), "item_key").select("chunk_id", "page_num")


@query("page_offsets", """WITH p AS (SELECT DISTINCT page_id, item_key, page_num, markdown FROM page_extractions WHERE page_id IS NOT NULL)
    SELECT page_id, coalesce(sum(length(coalesce(markdown, '')) + 1) OVER (PARTITION BY item_key ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM p""")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_offsets(ad.pages(spark, d), "item_key", "markdown").select("page_id", F.col("char_start").cast("long").alias("char_start"))


@query("page_stats", """WITH p AS (SELECT DISTINCT page_id, markdown FROM page_extractions WHERE page_id IS NOT NULL), n AS (SELECT length(trim(coalesce(markdown, ''))) AS n FROM p)
    SELECT count(*) AS total_pages, count(*) FILTER (n > 0)::BIGINT AS text_pages, count(*) FILTER (n = 0)::BIGINT AS empty_pages, 0::BIGINT AS ocr_pages FROM n""")
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.page_stats(ad.pages(spark, d))


def _mentions(kind: str, words: str) -> str:
    """Mentions of a kind with their offset: the text between mentions and the mentions themselves alternate."""
    p = f"(?i)(?:{words})\\s+(\\d+)"
    return f"""SELECT item_key, '{kind}' AS kind, try_cast(num[i] AS INT) AS number, (list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda g: length(g))), 0))::INT AS pos
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT item_key, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', 1) AS num, string_split_regex(t, '{p}') AS gap FROM rd))"""


_FIRST = f"""rd AS (SELECT DISTINCT item_key, full_markdown AS t FROM document_extractions WHERE length(full_markdown) > 0),
    rm AS ({_mentions('table', 'Table|Tab[.]?')} UNION ALL {_mentions('figure', 'Figure|Fig[.]?')}), rf AS (SELECT item_key, kind, number, min(pos) AS char_offset FROM rm WHERE number IS NOT NULL GROUP BY ALL)"""


@query("reference_first_match", f"WITH {_FIRST} SELECT * FROM rf")
def reference_first_match(spark: SparkSession, d: str) -> DataFrame:
    return reference.first_references(ad.documents(spark, d), "item_key", "full_markdown").select("item_key", "kind", "number", "char_offset")


@query("reference_anchors", f"""WITH {_FIRST}, c AS (SELECT DISTINCT item_key, char_start, chunk_index FROM chunks WHERE chunk_id IS NOT NULL)
    SELECT item_key, kind, number, coalesce(arg_max(chunk_index, (char_start, chunk_index)) FILTER (char_start <= char_offset), 0) AS chunk_index FROM rf JOIN c USING (item_key) GROUP BY 1, 2, 3""")
def reference_anchors(spark: SparkSession, d: str) -> DataFrame:
    refs = reference.first_references(ad.documents(spark, d), "item_key", "full_markdown")
    return reference.reference_chunks(refs, ad.passages(spark, d), "item_key")


_WORDS = "w AS (SELECT DISTINCT item_key, unnest(regexp_split_to_array(lower(full_markdown), '[^\\pL\\pN]+')) AS word FROM document_extractions WHERE length(full_markdown) > 0)"


@query("boolean_and", f"WITH {_WORDS} SELECT item_key FROM w WHERE word IN ('sample', 'pattern', 'survey') GROUP BY item_key HAVING count(DISTINCT word) = 3")
def boolean_and(spark: SparkSession, d: str) -> DataFrame:
    return library.boolean_search(library.postings(ad.documents(spark, d), "item_key", "full_markdown"), "item_key", "Sample pattern survey", "AND")


@query("boolean_or", f"WITH {_WORDS} SELECT DISTINCT item_key FROM w WHERE word IN ('glacier', 'vaccine')")
def boolean_or(spark: SparkSession, d: str) -> DataFrame:
    return library.boolean_search(library.postings(ad.documents(spark, d), "item_key", "full_markdown"), "item_key", "glacier Vaccine", "OR")


@query("search_boolean", f"WITH {_WORDS}, l AS (SELECT item_key, min(title) AS title, min(year) AS year FROM library_items GROUP BY 1) SELECT item_key, title, year FROM l WHERE year >= 1990 AND item_key IN (SELECT item_key FROM w WHERE word IN ('sample', 'pattern') GROUP BY 1 HAVING count(DISTINCT word) = 2)")
def search_boolean(spark: SparkSession, d: str) -> DataFrame:
    keys = library.boolean_search(library.postings(ad.documents(spark, d), "item_key", "full_markdown"), "item_key", "sample pattern")
    return library.boolean_results(keys, ad.library(spark, d), year_min=1990).select("item_key", "title", "year")


@query("library_eav", """SELECT itemid, min(value) FILTER (f = 'title') AS title, min(value) FILTER (f = 'date') AS date, min(value) FILTER (f = 'publicationtitle') AS publication, min(value) FILTER (f = 'doi') AS doi
    FROM item_data JOIN (SELECT fieldid, lower(trim(fieldname)) AS f FROM item_fields) USING (fieldid) JOIN item_data_values USING (valueid) WHERE f IN ('title', 'date', 'publicationtitle', 'doi') GROUP BY itemid""")
def library_eav(spark: SparkSession, d: str) -> DataFrame:
    return library.eav_columns(table(spark, d, "item_data"), table(spark, d, "item_fields"), table(spark, d, "item_data_values"), {"title": "title", "date": "date", "publication": "publicationTitle", "doi": "DOI"})


@query("library_years", """SELECT itemid, coalesce(try_cast(regexp_extract(substring(min(value), 1, 4), '^\\s*(\\d+)', 1) AS INT), 0) AS year FROM item_data JOIN item_fields USING (fieldid) JOIN item_data_values USING (valueid) WHERE lower(trim(fieldname)) = 'date' GROUP BY itemid HAVING min(value) IS NOT NULL""")
def library_years(spark: SparkSession, d: str) -> DataFrame:
    dates = library.eav_columns(table(spark, d, "item_data"), table(spark, d, "item_fields"), table(spark, d, "item_data_values"), {"date": "date"})
    return dates.where("date is not null").select("itemid", tx.year_prefix(F.col("date")).alias("year"))


@query("pdf_resolution", """WITH h AS (SELECT DISTINCT "key" AS item_key, itemid % 5 AS m FROM zotero_items WHERE itemtypeid NOT IN (1, 14)), x AS (SELECT item_key, min(m) AS m FROM h GROUP BY 1)
    SELECT item_key, CASE m WHEN 0 THEN 'linked file (not supported)' WHEN 1 THEN 'no path on record' WHEN 2 THEN 'unexpected form of path: C:/a.pdf' WHEN 3 THEN 'file missing from storage' END AS reason FROM x""")
def pdf_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Items held in five ways: linked, without a path, with an odd one, lost and there."""
    m = F.col("m")
    items = library.base_items(table(spark, d, "zotero_items")).groupBy(F.col("key").alias("item_key")).agg(F.min(F.col("itemid") % 5).alias("m"))
    held = items.select("item_key", F.lit("t").alias("title"), F.concat(F.lit("A"), "item_key").alias("attachment_key"), F.when(m == 0, 2).otherwise(0).alias("linkmode"), F.when(m == 1, None).when(m == 2, "C:/a.pdf").otherwise("storage:a.pdf").alias("path"))
    files = items.where("m <> 3").select(F.concat(F.lit("storage/A"), "item_key", F.lit("/a.pdf")).alias("path"))
    return library.pdf_resolution(held, files).select("item_key", "reason")


@query("author_label", """WITH c AS (SELECT l_orderkey AS itemid, s_name AS lastname, substring(s_name, 1, 1) AS firstname, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS o FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    SELECT itemid, CASE WHEN count(*) = 1 THEN max(lastname) || ', ' || max(firstname) || '.' ELSE max(lastname) FILTER (o = 0) || ' et al.' END AS authors FROM c GROUP BY itemid""")
def author_label(spark: SparkSession, d: str) -> DataFrame:
    return library.author_labels(ad.creators(spark, d))


@query("joined_names", "SELECT o_custkey AS itemid, string_agg(o_orderpriority, '; ' ORDER BY o_orderpriority) AS tags FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def joined_names(spark: SparkSession, d: str) -> DataFrame:
    return library.joined_names(table(spark, d, "orders").select(F.col("o_custkey").alias("itemid"), "o_orderpriority"), "itemid", "o_orderpriority", "tags")


@query("base_items", "SELECT DISTINCT itemid FROM zotero_items WHERE itemtypeid NOT IN (1, 14) AND itemid NOT IN (SELECT itemid FROM zotero_items WHERE libraryid = 5)")
def base_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items")
    return library.base_items(items, items.where("libraryid = 5")).select("itemid").distinct()


@query("library_diagnostics", """WITH b AS (SELECT DISTINCT itemid FROM zotero_items WHERE itemtypeid NOT IN (1, 14)), a AS (SELECT DISTINCT itemid, CASE WHEN itemid % 3 = 0 THEN 'text/html' ELSE 'application/pdf' END AS t FROM b WHERE itemid % 4 <> 0)
    SELECT 'total' AS measure, count(*) AS n FROM b UNION ALL SELECT 'with_pdf', count(*) FROM a WHERE t = 'application/pdf' UNION ALL SELECT 'type:text/html', count(*) FROM a WHERE t = 'text/html' HAVING count(*) > 0 UNION ALL SELECT 'no_attachment', count(*) FROM b WHERE itemid NOT IN (SELECT itemid FROM a)""")
def library_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "zotero_items").dropDuplicates(["itemid"])
    held = items.where("itemid % 4 <> 0").select("itemid", F.lit(None).cast("long").alias("parentitemid"), F.when(F.col("itemid") % 3 == 0, "text/html").otherwise("application/pdf").alias("contenttype"))
    return library.diagnostics(items, held)


@query("index_stats", f"WITH {INDEX_SQL} SELECT count(DISTINCT doc_id) AS total_documents, count(*) AS total_chunks, round(count(*) / count(DISTINCT doc_id), 1) AS avg_chunks_per_doc FROM idx")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.index_totals(ad.index(spark, d))


@query("section_coverage", f"WITH {INDEX_SQL} SELECT section AS value, count(*) AS n FROM idx GROUP BY 1")
def section_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage(ad.index(spark, d), "section")


@query("journal_coverage", f"WITH {INDEX_SQL}, q AS (SELECT doc_id, max(journal_quartile) AS q FROM idx GROUP BY 1) SELECT coalesce(q, 'unknown') AS quartile, count(*) AS n FROM q GROUP BY 1")
def journal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.journal_coverage(ad.index(spark, d))


_COSTS = "costs AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"timestamp\", user_id::VARCHAR AS session_id, event_id AS table_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, value AS cost_usd FROM events)"


@query("cost_summary", f"WITH {_COSTS} SELECT round(sum(cost_usd), 6) AS total_cost_usd, count(*) AS total_tables, round(avg(cost_usd), 6) AS avg_cost_per_table_usd, sum(k)::BIGINT AS input_tokens, sum(k * 2)::BIGINT AS output_tokens, sum(k * 3)::BIGINT AS cache_write_tokens, sum(k * 4)::BIGINT AS cache_read_tokens FROM costs")
def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.cost_summary(ad.costs(spark, d))


@query("cost_sessions", f"WITH {_COSTS} SELECT session_id, min(\"timestamp\") AS started, count(*) AS tables, round(sum(cost_usd), 6) AS cost_usd FROM costs GROUP BY 1")
def cost_sessions(spark: SparkSession, d: str) -> DataFrame:
    return stats.cost_sessions(ad.costs(spark, d))


@query("recent_costs", f"WITH {_COSTS} SELECT \"timestamp\", table_id, cost_usd FROM costs ORDER BY \"timestamp\" DESC, table_id DESC LIMIT 10")
def recent_costs(spark: SparkSession, d: str) -> DataFrame:
    return stats.recent_costs(ad.costs(spark, d)).select("timestamp", "table_id", "cost_usd")


@query("token_cost", f"WITH {_COSTS} SELECT table_id, round(k * 1.0 / 1e6 + k * 2 * 5.0 / 1e6 + k * 3 * 1.25 / 1e6 + k * 4 * 0.1 / 1e6, 9) AS cost FROM costs")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    return ad.costs(spark, d).select("table_id", F.round(stats.token_cost(), 9).alias("cost"))


@query("grade_histogram", "SELECT g AS grade, count(quality_grade) AS n FROM (SELECT unnest(['A', 'B', 'C', 'D', 'F']) AS g) LEFT JOIN document_extractions ON quality_grade = g GROUP BY 1")
def grade_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.grade_histogram(table(spark, d, "document_extractions"))


@query("status_counts", "SELECT outcome AS status, count(*) AS n FROM index_log GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.status_counts(table(spark, d, "index_log"))


@query("index_tree", "SELECT item_key AS doc_id, string_agg(chunk_id, ',' ORDER BY coalesce(page_num, 0), coalesce(chunk_index, 0), chunk_id) AS entries FROM (SELECT DISTINCT chunk_id, item_key, page_num, chunk_index FROM chunks) GROUP BY 1")
def index_tree(spark: SparkSession, d: str) -> DataFrame:
    return stats.tree(ad.index(spark, d)).select("doc_id", F.array_join(F.transform("entries", lambda e: e["chunk_id"]), ",").alias("entries"))


@query("index_fences", """WITH v AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1 HAVING count(*) >= 3)
    SELECT o_custkey, v[(len(v) // 2) + 1] AS median, round(v[(3 * len(v) // 4) + 1] + (v[(3 * len(v) // 4) + 1] - v[(len(v) // 4) + 1]) * 1.5, 6) AS fence FROM v""")
def index_fences(spark: SparkSession, d: str) -> DataFrame:
    return stats.index_fences(table(spark, d, "orders"), "o_custkey", "o_totalprice").select("o_custkey", "median", F.round("fence", 6).alias("fence"))


@query("dominant_style", "WITH s AS (SELECT l_orderkey, l_returnflag, l_linestatus, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2, 3) SELECT l_orderkey, arg_max(l_returnflag, (w, l_returnflag, l_linestatus)) AS l_returnflag, arg_max(l_linestatus, (w, l_returnflag, l_linestatus)) AS l_linestatus FROM s GROUP BY 1")
def dominant_style(spark: SparkSession, d: str) -> DataFrame:
    return stats.dominant(table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"], "l_linenumber")


@query("incremental_plan", """WITH cur AS (SELECT doc_id::VARCHAR AS item_key, text AS t FROM documents), old AS (SELECT doc_id::VARCHAR AS item_key, CASE WHEN doc_id % 7 = 0 THEN 'x' WHEN doc_id % 11 = 0 THEN '' ELSE text END AS t, doc_id % 11 = 0 AS bare FROM documents WHERE doc_id % 5 <> 0)
    SELECT cur.item_key, CASE WHEN old.item_key IS NULL THEN 'new' WHEN bare AND NOT coalesce(old.item_key::BIGINT % 7 = 0, false) THEN 'no_hash' WHEN coalesce(old.t, '') <> coalesce(cur.t, '') THEN 'changed' ELSE 'current' END AS action FROM cur LEFT JOIN old USING (item_key)""")
def incremental_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_key"), "doc_id", "text")
    old = docs.where("doc_id % 5 <> 0").select("item_key", F.when(F.col("doc_id") % 7 == 0, indexing.text_hash(F.lit("x"))).when(F.col("doc_id") % 11 == 0, "").otherwise(indexing.text_hash(F.col("text"))).alias("old_hash"))
    return indexing.plan(docs.select("item_key", indexing.text_hash(F.col("text")).alias("hash")), old).select("item_key", "action")


_COUNTS = "SELECT item_key, count(*) FILTER (length(trim(coalesce(markdown, ''))) > 0) AS text_pages, sum(tables_on_page) AS tables_found, sum(images_on_page) AS figures_found, count(*) FILTER (tables_on_page > 0) AS tables_with_captions, count(*) FILTER (images_on_page > 0) AS figures_with_captions FROM (SELECT DISTINCT page_id, item_key, markdown, tables_on_page, images_on_page FROM page_extractions WHERE page_id IS NOT NULL) GROUP BY 1"


@query("grade", f"WITH k AS ({_COUNTS}) SELECT item_key, CASE WHEN text_pages = 0 THEN 'F' WHEN tables_found > tables_with_captions OR figures_found > figures_with_captions THEN CASE WHEN (tables_found > 0 AND tables_with_captions < 0.8 * tables_found) OR (figures_found > 0 AND figures_with_captions < 0.8 * figures_found) THEN 'C' ELSE 'B' END ELSE 'A' END AS grade FROM k")
def grade(spark: SparkSession, d: str) -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = ad.pages(spark, d).groupBy("item_key").agg(count(F.length(F.trim(F.coalesce("markdown", F.lit("")))) > 0).alias("text_pages"), F.sum("tables_on_page").alias("tables_found"), F.sum("images_on_page").alias("figures_found"), count(F.col("tables_on_page") > 0).alias("tables_with_captions"), count(F.col("images_on_page") > 0).alias("figures_with_captions"))
    for c, v in (("figure_captions_found", 0), ("table_captions_found", 0), ("figures_missing", 0), ("tables_missing", 0), ("sections_identified", 1)):
        rows = rows.withColumn(c, F.lit(v))
    return rows.select("item_key", completeness.grade().alias("grade"))


@query("number_gaps", """WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber * 3 AS n FROM lineitem), g AS (SELECT l_orderkey, n, coalesce(lag(n) OVER (PARTITION BY l_orderkey ORDER BY n), 0) AS b FROM s)
    SELECT l_orderkey, coalesce(string_agg((b + 1) || '-' || (n - 1), ',' ORDER BY n) FILTER (n > b + 1), '') AS gaps FROM g GROUP BY 1""")
def number_gaps(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 3).alias("n"))
    return completeness.number_gaps(lines, "l_orderkey", "n").select("l_orderkey", F.array_join(F.transform("gaps", lambda g: F.concat_ws("-", g["first"].cast("string"), g["last"].cast("string"))), ",").alias("gaps"))


def _detectors(c: str) -> str:
    """garbled, interleaved and ligatures of a text column."""
    ws = f"list_filter(string_split_regex({c}, '[\\s\\x{{a0}}\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: w <> '')"
    long_ = f"list_filter({ws}, lambda w: NOT contains(w, '-'))"
    return f"""(NOT regexp_matches({c}, '[\\x{{391}}-\\x{{3c9}}\\x{{2200}}-\\x{{22ff}}=±×÷²³]') AND len({long_}) > 0 AND list_sum(list_transform({long_}, lambda w: length(w))) > 25 * len({long_})) AS garbled,
        (len({ws}) >= greatest(5, length({c}) // 10) AND len(list_filter({ws}, lambda w: regexp_full_match(w, '\\pL'))) > 0.4 * len({ws})) AS interleaved, regexp_matches({c}, '[\\x{{FB00}}-\\x{{FB04}}]') AS ligatures"""


@query("quality_detectors", f"SELECT doc_id, {_detectors('text')} FROM documents WHERE length(text) > 0")
def quality_detectors(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", tx.is_garbled(t).alias("garbled"), tx.is_interleaved(t).alias("interleaved"), tx.has_ligatures(t).alias("ligatures"))


_STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"
#: Tables of the pages: lines, runs of lines with a bar, those whose second line is a rule.
TABLES_SQL = r"""tp AS (SELECT DISTINCT page_id, item_key, page_num, markdown FROM page_extractions WHERE page_id IS NOT NULL AND length(markdown) > 0),
    tx AS (SELECT item_key, page_num, page_id, unnest(string_split(markdown, chr(10))) AS line, unnest(range(1, len(string_split(markdown, chr(10))) + 1)) AS i FROM tp),
    tb AS (SELECT *, regexp_matches(line, '^\s*\|') AS bar FROM tx),
    tr AS (SELECT *, sum(CASE WHEN bar THEN 0 ELSE 1 END) OVER o AS run, last_value(CASE WHEN trim(line) <> '' THEN CASE WHEN bar THEN '' ELSE line END END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM tb WINDOW o AS (PARTITION BY page_id ORDER BY i)),
    tg AS (SELECT item_key, page_num, page_id, run, min(i) AS first, arg_min(above, i) AS above, list(line ORDER BY i) AS ls FROM tr WHERE bar GROUP BY ALL),
    tc AS (SELECT *, list_transform(ls, lambda l: list_transform(string_split(replace(regexp_replace(trim(l), '^\||\|$', '', 'g'), '\|', chr(1)), '|'), lambda c: replace(trim(c), chr(1), '\|'))) AS cells FROM tg WHERE len(ls) >= 2 AND regexp_matches(ls[2], '^\s*\|[\s:|\-]+\|?\s*$')),
    tt AS (SELECT item_key, page_num, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS table_index, cells[1] AS headers, cells[3:] AS rows,
        CASE WHEN regexp_matches(above, '(?i)^(?:\*\*)?(?:Table|Tab\.?)\s+(?:\d+|[IVXLCDM]+|[A-Z]\.\d+|S\d+)') THEN regexp_replace(above, '^\*+|\*+$', '', 'g') END AS caption FROM tc)""".replace("\\\\", "\\")


SQL["search_tables"] = f"""WITH {TABLES_SQL}, {_objects("SELECT item_key, page_num, format('{}_table_{:04d}_{:02d}', item_key, page_num, table_index) AS chunk_id, caption, 'table' AS section FROM tt")},
    h AS (SELECT * FROM sc ORDER BY score DESC, chunk_id LIMIT 90) SELECT chunk_id, caption, round(score, 6) AS score, round({_COMP}, 6) AS composite_score FROM h WHERE {_COMP} > 0 ORDER BY {_COMP} DESC, h.score DESC, chunk_id LIMIT 30"""


def _page_tables(spark: SparkSession, d: str) -> DataFrame:
    return tables.markdown_tables(ad.pages(spark, d), ["item_key", "page_num"])


def _flat():
    return F.array_join(F.transform("rows", lambda r: F.array_join(r, "¦", "")), "¶").alias("rows")


_FLAT_SQL = "coalesce(list_aggregate(list_transform(rows, lambda r: list_aggregate(r, 'string_agg', '¦')), 'string_agg', '¶'), '') AS rows"


@query("cell_quality", f"""WITH {TABLES_SQL}, c AS (SELECT item_key, unnest(headers || flatten(rows)) AS cell FROM tt), q AS (SELECT item_key, {_detectors('cell')} FROM c)
    SELECT item_key, count(*) FILTER (garbled) AS garbled, count(*) FILTER (interleaved) AS interleaved, count(*) FILTER (ligatures) AS ligatures FROM q GROUP BY 1""")
def cell_quality(spark: SparkSession, d: str) -> DataFrame:
    cells = _page_tables(spark, d).select("item_key", F.explode(F.flatten(F.concat(F.array("headers"), "rows"))).alias("cell"))
    return completeness.cell_quality(cells, "item_key", "cell")


def _numeric(c: str) -> str:
    return f"regexp_full_match({_STRIP(f"regexp_replace({c}, '[*†‡§№]+', '', 'g')")}, '[0-9.−\\-+, ]+')"


_WHOLE, _SPLIT, _MINUS = "replace(replace(replace(replace(replace(c, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl')", "^(\\d+)\\s*[−\\-]\\s*\\.\\s*(\\d*).*$", "^[−\\-]\\s*(\\d[\\d.]*).*$"


@query("cell_clean", f"""WITH {TABLES_SQL}, z AS (SELECT item_key, page_num, table_index, unnest(range(1, len(rows) + 1)) AS i, unnest(rows) AS r FROM tt), y AS (SELECT item_key, page_num, table_index, i, unnest(range(1, len(r) + 1)) AS j, unnest(r) AS c FROM z),
    c1 AS (SELECT * EXCLUDE (c), {_WHOLE} AS c FROM y), c2 AS (SELECT * EXCLUDE (c), CASE WHEN {_numeric('c')} AND regexp_matches({_STRIP('c')}, '{_SPLIT}') THEN regexp_replace({_STRIP('c')}, '{_SPLIT}', '-\\1.\\2') WHEN {_numeric('c')} AND regexp_matches({_STRIP('c')}, '{_MINUS}') THEN regexp_replace({_STRIP('c')}, '{_MINUS}', '-\\1') ELSE c END AS c FROM c1),
    c3 AS (SELECT * EXCLUDE (c), CASE WHEN {_numeric('c')} THEN regexp_replace(c, '(^|\\s)\\.(\\d)', '\\10.\\2', 'g') ELSE c END AS c FROM c2)
    SELECT item_key, page_num, table_index::INT AS table_index, i::INT AS line, j::INT AS col, replace({_STRIP("regexp_replace(replace(c, chr(10), ' '), '  +', ' ', 'g')")}, '−', '-') AS cell FROM c3""")
def cell_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _page_tables(spark, d).select("item_key", "page_num", "table_index", F.posexplode(tx.clean_table(F.col("rows"))).alias("line", "r"))
    return rows.select("item_key", "page_num", "table_index", (F.col("line") + 1).alias("line"), F.posexplode("r").alias("col", "cell")).withColumn("col", F.col("col") + 1)


@query("markdown_tables", f"WITH {TABLES_SQL} SELECT item_key, page_num, table_index::INT AS table_index, list_aggregate(headers, 'string_agg', '¦') AS headers, {_FLAT_SQL}, caption, len(rows)::INT AS n_rows, greatest(len(headers), coalesce(list_max(list_transform(rows, lambda r: len(r))), 0))::INT AS n_cols FROM tt")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    return _page_tables(spark, d).select("item_key", "page_num", "table_index", F.array_join("headers", "¦").alias("headers"), _flat(), "caption", "n_rows", "n_cols")


ARTIFACTS_SQL = f"""k AS (SELECT item_key, page_num, table_index, headers, coalesce(regexp_matches(caption, '{tables.NUMBERED}'), false) AS real, list_filter(headers || flatten(rows), lambda c: c IS NOT NULL) AS cells, len(rows) + CASE WHEN len(headers) > 0 THEN 1 ELSE 0 END AS total,
        list_filter(CASE WHEN len(headers) >= 3 THEN [headers] ELSE [] END || rows, lambda r: len(r) >= 3 AND regexp_matches(trim(r[1]), '{tables.BARE_NUMBER}') AND regexp_matches(trim(r[-1]), '{tables.BARE_NUMBER}')) AS spread FROM tt),
    m AS (SELECT *, len(list_filter(cells, lambda c: regexp_matches(trim(c), '{tables.CONTENTS_LINE}'))) AS listed, len(list_filter(cells, lambda c: len(regexp_extract_all(c, '{tables.CONTENTS_PACKED}')) >= 3)) > 0 AS packed FROM k),
    kinds AS (SELECT item_key, page_num, table_index::INT AS table_index, CASE WHEN NOT real AND regexp_matches(array_to_string(headers, ' '), '{tables.SPACED_BOX}') THEN 'article_info_box' WHEN listed >= 3 AND listed >= total * 0.4 THEN 'table_of_contents' WHEN NOT real AND packed THEN 'table_of_contents'
        WHEN NOT real AND total >= 2 AND len(spread) >= 2 AND len(spread) >= total * 0.4 THEN 'table_of_contents' WHEN NOT real AND regexp_matches(array_to_string(cells, ' '), '{tables.DIAGRAM}') THEN 'diagram_as_table' END AS artifact_type FROM m)"""


@query("table_artifacts", f"WITH {TABLES_SQL}, {ARTIFACTS_SQL} SELECT * FROM kinds")
def table_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return _page_tables(spark, d).select("item_key", "page_num", "table_index", tables.artifact(F.col("headers"), F.col("rows"), F.col("caption")).alias("artifact_type"))


@query("table_continuations")
def table_continuations(spark: SparkSession, d: str) -> DataFrame:
    return tables.continue_captions(tables.markdown_tables(ad.pages(spark, d), ["item_key", "page_num"]), "item_key").select("item_key", "page_num", "table_index", "caption")


@query("captions", r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE length(text) > 0), y AS (SELECT *, regexp_replace(trim(raw), '(?i)^(?:supplementary|suppl?\.?)\s+', '') AS line FROM x),
    z AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^(?:Figure|Fig\.?)\s+(?:\d+|[IVXLCDM]+|[A-Z]\.\d+|S\d+)\s*(?:[.:(\x{2014}\x{2013}-]|\*\*|$)') THEN 'figure' WHEN regexp_matches(line, '(?i)^(?:\*\*)?(?:Table|Tab\.?)\s+(?:\d+|[IVXLCDM]+|[A-Z]\.\d+|S\d+)\s*(?:[.:(\x{2014}\x{2013}-]|\*\*|$)') THEN 'table' END AS kind FROM y)
    SELECT doc_id, line_no::INT AS line_no, kind, nullif(regexp_extract(raw, '(?i)(?:Figure|Fig\.?|Table|Tab\.?)\s+((?:\d+|[IVXLCDM]+|[A-Z]\.\d+|S\d+))', 1), '') AS number, trim(replace(raw, '**', '')) AS caption FROM z WHERE kind IS NOT NULL""".replace("\\\\", "\\"))
def caption_lines(spark: SparkSession, d: str) -> DataFrame:
    return captions.captions(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query("normalize_title", "SELECT DISTINCT publication, trim(regexp_replace(regexp_replace(lower(publication), '[&:\\-/]', ' ', 'g'), '[\\s\\x{a0}]+', ' ', 'g')) AS norm FROM library_items WHERE publication IS NOT NULL")
def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "library_items").where("publication is not null").select("publication", tx.normalized_title(F.col("publication")).alias("norm")).distinct()


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scimago_quartiles").select(F.col("title_normalized").alias("title"), "quartile")


@query("quartile_exact", """WITH t AS (SELECT trim(regexp_replace(regexp_replace(lower(title_normalized), '[&:\\-/]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, min(quartile) AS quartile FROM scimago_quartiles WHERE quartile IS NOT NULL GROUP BY 1)
    SELECT DISTINCT publication, quartile FROM library_items JOIN t ON norm = trim(regexp_replace(regexp_replace(lower(publication), '[&:\\-/]', ' ', 'g'), '[\\s\\x{a0}]+', ' ', 'g'))""")
def quartile_exact(spark: SparkSession, d: str) -> DataFrame:
    return journals.quartiles(table(spark, d, "library_items"), _titles(spark, d), fuzzy=False).where("tier = 1").select("publication", "quartile")


@query("quartile_counts", "SELECT coalesce(quartile, 'none') AS quartile, count(*) AS n FROM scimago_quartiles GROUP BY 1")
def quartile_counts(spark: SparkSession, d: str) -> DataFrame:
    return journals.quartile_counts(table(spark, d, "scimago_quartiles"))


_CITES = "cites AS (SELECT l_orderkey AS src, l_partkey AS dst, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2), works AS (SELECT p_partkey AS work_id, p_name AS title, (SELECT count(*) FROM cites WHERE dst = p_partkey) AS cited_by_count FROM part)"


@query("references", f"WITH {_CITES}, f AS (SELECT min(src) AS k FROM cites) SELECT work_id, title, cited_by_count FROM cites JOIN works ON work_id = dst, f WHERE src = k")
def references(spark: SparkSession, d: str) -> DataFrame:
    cites = ad.cites(spark, d)
    return citations.references(ad.works(spark, d), cites, cites.agg(F.min("src")).first()[0]).select("work_id", "title", "cited_by_count")


@query("citing", f"""WITH {_CITES}, f AS (SELECT min(dst) AS k FROM cites) SELECT src AS work_id, o_orderpriority AS title, o_orderstatus AS authors, year(o_orderdate)::INT AS year FROM cites JOIN orders ON o_orderkey = src, f WHERE dst = k ORDER BY src LIMIT 20""")
def citing(spark: SparkSession, d: str) -> DataFrame:
    cites = ad.cites(spark, d)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_orderpriority").alias("title"), F.array("o_orderstatus").alias("authors"), F.year("o_orderdate").alias("year"), F.lit("").alias("doi"), F.lit(0).alias("cited_by_count"))
    return citations.citing(orders, cites, cites.agg(F.min("dst")).first()[0]).select("work_id", "title", "authors", "year")


@query("citation_count", """WITH e AS (SELECT DISTINCT -l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT w AS work_id, sum(i)::BIGINT AS cited_by_count, sum(o)::BIGINT AS reference_count FROM (SELECT dst AS w, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY 1""")
def citation_count(spark: SparkSession, d: str) -> DataFrame:
    return citations.citation_counts(ad.cites(spark, d).select((-F.col("src")).alias("src"), "dst"))


@query("crop_strips", """WITH h AS (SELECT p_partkey, p_size * 3.0::DOUBLE AS h FROM part), n AS (SELECT *, CASE WHEN h <= 10 THEN 1 ELSE ceil((h - 10) / 8.5)::INT + 1 END AS n FROM h)
    SELECT p_partkey, i AS strip, round(i * 8.5::DOUBLE, 6) AS y0, round(least(i * 8.5::DOUBLE + CASE WHEN n = 1 THEN h ELSE 10 END, h), 6) AS y1 FROM (SELECT *, unnest(range(0, n)) AS i FROM n)""")
def crop_strips(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("p_size") * 3.0
    cut = table(spark, d, "part").select("p_partkey", F.posexplode(geometry.strips(F.lit(0.0), F.lit(0.0), F.lit(10.0), h)).alias("strip", "s"))
    return cut.select("p_partkey", F.col("strip").cast("long").alias("strip"), F.round("s.y0", 6).alias("y0"), F.round("s.y1", 6).alias("y1"))


@query("render_dpi", "SELECT p_partkey, greatest(150, least(300, floor(1568 / (greatest(p_size * 20.0::DOUBLE, 100) / 72)))::INT) AS dpi FROM part")
def render_dpi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", geometry.render_dpi(F.lit(0.0), F.lit(0.0), F.col("p_size") * 20.0, F.lit(100.0)).alias("dpi"))


@query("crop_boxes", """WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag = 'N' THEN 'table' ELSE 'figure' END AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS y FROM lineitem)
    SELECT l_orderkey, y::DOUBLE AS y0, coalesce(lead(y) OVER (PARTITION BY l_orderkey ORDER BY y), 100)::DOUBLE AS crop_y1 FROM c QUALIFY kind = 'table'""")
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    y = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("double")
    caps = table(spark, d, "lineitem").select("l_orderkey", y.alias("y0"), F.when(F.col("l_returnflag") == "N", "table").otherwise("figure").alias("kind")).withColumn("y_center", F.col("y0")).withColumn("page_x0", F.lit(0.0)).withColumn("page_x1", F.lit(50.0)).withColumn("page_y1", F.lit(100.0))
    return geometry.crop_boxes(caps, ["l_orderkey"]).select("l_orderkey", "y0", "crop_y1")


_ABSTRACT = layout.ABSTRACT.replace("'", "''")


@query("abstract_spans", f"""WITH p AS (SELECT DISTINCT page_id, item_key, page_num, char_start, markdown FROM page_extractions WHERE page_id IS NOT NULL AND page_num <= {layout.ABSTRACT_PAGES} AND regexp_matches(markdown, '{_ABSTRACT}')),
    h AS (SELECT *, length(string_split_regex(markdown, '{_ABSTRACT}')[1]) AS a, length(regexp_extract(markdown, '{_ABSTRACT}')) AS n FROM p), r AS (SELECT *, length(string_split_regex(markdown[a + n + 1 :], '{layout.NEXT_HEADING}')[1]) AS stop FROM h)
    SELECT item_key, arg_min(char_start + a, page_num)::INT AS char_start, arg_min(char_start + a + n + stop, page_num)::INT AS char_end FROM r GROUP BY 1""")
def abstract_spans(spark: SparkSession, d: str) -> DataFrame:
    return layout.abstract_spans(ad.pages(spark, d), "item_key").select("item_key", F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"))


@query("pages_in_references", f"""WITH {_SPANS}, pg AS (SELECT DISTINCT page_id, item_key, page_num, char_start FROM page_extractions WHERE page_id IS NOT NULL)
    SELECT DISTINCT pg.* FROM pg JOIN spans ON spans.item_key = pg.item_key AND label IN ('references', 'appendix') AND spans.char_start <= pg.char_start AND pg.char_start < spans.char_end""")
def pages_in_references(spark: SparkSession, d: str) -> DataFrame:
    spans = chunking.section_spans(ad.documents(spark, d), "item_key", "full_markdown")
    return layout.pages_in(ad.pages(spark, d).select("page_id", "item_key", "page_num", "char_start"), spans, "item_key")


_CAPTION_LINES = r"""cx AS (SELECT item_key, page_num, unnest(string_split(markdown, chr(10))) AS raw FROM tp), cy AS (SELECT *, regexp_replace(trim(raw), '(?i)^(?:supplementary|suppl?\.?)\s+', '') AS line FROM cx),
    cz AS (SELECT item_key, nullif(regexp_extract(raw, '(?i)(?:Figure|Fig\.?|Table|Tab\.?)\s+((?:\d+|[IVXLCDM]+|[A-Z]\.\d+|S\d+))', 1), '') AS number, CASE WHEN regexp_matches(line, '(?i)^(?:Figure|Fig\.?)\s+(?:\d+|[IVXLCDM]+|[A-Z]\.\d+|S\d+)\s*(?:[.:(\x{2014}\x{2013}-]|\*\*|$)') THEN 'figure'
        WHEN regexp_matches(line, '(?i)^(?:\*\*)?(?:Table|Tab\.?)\s+(?:\d+|[IVXLCDM]+|[A-Z]\.\d+|S\d+)\s*(?:[.:(\x{2014}\x{2013}-]|\*\*|$)') THEN 'table' END AS kind FROM cy)""".replace("\\\\", "\\")


@query("completeness", f"""WITH {_SPANS}, {TABLES_SQL}, {_CAPTION_LINES}, ap AS (SELECT DISTINCT page_id, item_key, markdown, images_on_page FROM page_extractions WHERE page_id IS NOT NULL),
    ba AS (SELECT item_key, count(*) AS total_pages, count(*) FILTER (length(trim(coalesce(markdown, ''))) > 0) AS text_pages, count(*) FILTER (images_on_page > 0) AS figures_found, 0 AS figures_with_captions FROM ap GROUP BY 1),
    ca AS (SELECT item_key, count(DISTINCT number) FILTER (kind = 'figure') AS fc, count(DISTINCT number) FILTER (kind = 'table') AS tc FROM cz GROUP BY 1), ta AS (SELECT item_key, count(*) AS tf, count(*) FILTER (coalesce(caption, '') <> '') AS tw FROM tt GROUP BY 1),
    sa AS (SELECT item_key, count(*) AS si FROM spans WHERE label NOT IN ('preamble', 'unknown') GROUP BY 1),
    al AS (SELECT ba.*, coalesce(fc, 0) AS figure_captions_found, coalesce(tc, 0) AS table_captions_found, coalesce(tf, 0) AS tables_found, coalesce(tw, 0) AS tables_with_captions, coalesce(si, 0) AS sections_identified FROM ba LEFT JOIN ca USING (item_key) LEFT JOIN ta USING (item_key) LEFT JOIN sa USING (item_key)),
    mi AS (SELECT *, greatest(0, figure_captions_found - figures_found) AS figures_missing, greatest(0, table_captions_found - tables_found) AS tables_missing,
        (tables_found > 0 AND tables_with_captions = 0)::INT + (figures_found > 0 AND figures_with_captions = 0)::INT + (figure_captions_found > 0 AND figures_found = 0)::INT + (table_captions_found > 0 AND tables_found = 0)::INT AS missed FROM al)
    SELECT * EXCLUDE (missed), CASE WHEN text_pages = 0 OR missed >= 2 THEN 'F' WHEN missed = 1 THEN 'D' WHEN figures_missing = 0 AND tables_missing = 0 AND figures_found <= figures_with_captions AND tables_found <= tables_with_captions AND sections_identified > 0 THEN 'A'
        WHEN (figures_found > 0 AND figures_with_captions < 0.8 * figures_found) OR (tables_found > 0 AND tables_with_captions < 0.8 * tables_found) THEN 'C' ELSE 'B' END AS grade FROM mi""")
def completeness_of_documents(spark: SparkSession, d: str) -> DataFrame:
    pages = ad.pages(spark, d)
    spans = chunking.section_spans(ad.documents(spark, d), "item_key", "full_markdown")
    found = tables.markdown_tables(pages, ["item_key", "page_num"]).select("item_key", "caption")
    figures = pages.where("images_on_page > 0").select("item_key", F.lit(None).cast("string").alias("caption"))
    rows = layout.completeness_rows(pages, captions.captions(pages, ["item_key", "page_num"]), found, figures, spans, "item_key")
    return rows.withColumn("grade", completeness.grade())


def _heading(c: str) -> str:
    """A heading without marks, section numbers and list letters."""
    trim = lambda x: f"regexp_replace({x}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"
    bare = trim(f"regexp_replace(regexp_replace({c}, '^#{{1,6}}\\s*', ''), '[*_]+', '', 'g')")
    numbered = trim(f"regexp_replace({bare}, '^(?:\\d+(?:\\.\\d+)*\\.?|[IVXLC]+\\.)\\s+', '')")
    return trim(f"regexp_replace({numbered}, '^\\([a-z]\\)\\s*', '')")


_LINES = "SELECT DISTINCT line FROM (SELECT unnest(string_split(full_markdown, chr(10))) AS line FROM document_extractions) WHERE regexp_matches(line, '^#{1,6}[\\s]')"


def _headings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "document_extractions").select(F.explode(F.split("full_markdown", "\n", -1)).alias("line"))
    return lines.where(F.col("line").rlike(r"^#{1,6}\s")).distinct()


@query("heading_strip", f"SELECT line, {_heading('line')} AS heading FROM ({_LINES})")
def heading_strip(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).select("line", tx.heading_text(F.col("line")).alias("heading"))


@query("section_labels", f"SELECT line, {_TOLD} AS label FROM (SELECT line, lower({_heading('line')}) AS h FROM ({_LINES}))")
def section_labels(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).select("line", tx.section_of(tx.heading_text(F.col("line"))).alias("label"))


_BOXES = f"""e AS (SELECT DISTINCT item_key, full_markdown AS t, length(full_markdown) AS total FROM document_extractions WHERE length(full_markdown) > 0),
    l AS (SELECT item_key, total, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM e),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY item_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s FROM l),
    b AS (SELECT item_key, total, s, line, i, {_heading('line')} AS heading, lower({_heading('line')}) AS h, length(regexp_extract(line, '^#+')) AS level FROM o WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S'))"""


def _header_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Headings of documents in the role of header boxes: all on one page, at their offset."""
    lines = ad.documents(spark, d).where("length(full_markdown) > 0").select("item_key", F.posexplode(F.split("full_markdown", "\n", -1)).alias("n", "text"))
    at = F.coalesce(F.sum(F.length("text") + 1).over(W.partitionBy("item_key").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("char_offset", at.cast("int")).where(F.col("text").rlike(r"^#{1,6}\s+\S")).select("item_key", F.lit(1).alias("page_num"), F.col("n").alias("box_index"), "text", "char_offset")


_LAYOUT_SPANS = """, ct AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY item_key ORDER BY s), total) AS e1, row_number() OVER (PARTITION BY item_key ORDER BY s) AS r FROM k),
    sp AS (SELECT item_key, s AS char_start, e1 AS char_end, label, confidence FROM ct UNION ALL SELECT item_key, 0, s, 'preamble', 1.0::DOUBLE FROM ct WHERE r = 1 AND s > 0
        UNION ALL SELECT item_key, 0, total::INT, 'unknown', 0.5::DOUBLE FROM e WHERE item_key NOT IN (SELECT item_key FROM k)) SELECT * FROM sp"""


@query("layout_sections", f"""WITH {_BOXES}, k AS (SELECT item_key, total, s, coalesce({_TOLD}, 'unknown') AS label, CASE WHEN {_TOLD} IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM b WHERE NOT regexp_full_match(heading, 'R?\\d+')){_LAYOUT_SPANS}""")
def layout_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a contents list: sections from their header boxes."""
    boxes = _header_boxes(spark, d)
    docs = ad.documents(spark, d).where("length(full_markdown) > 0").select("item_key", F.length("full_markdown").alias("total"))
    toc = boxes.limit(0).select("item_key", F.col("box_index").alias("entry"), F.lit(1).alias("level"), F.col("text").alias("title"), "page_num")
    return layout.document_sections(docs, toc, boxes, "item_key").select("item_key", "char_start", "char_end", "label", "confidence")


@query("contents_sections", f"""WITH {_BOXES}, en AS (SELECT *, {_TOLD} AS told FROM b WHERE h <> ''), kept AS (SELECT * FROM en WHERE level <= 2 OR (level = 3 AND told IN ('results', 'conclusion', 'methods'))),
    m AS (SELECT n.item_key, n.total, n.i AS entry, n.level, n.told, min((x.i, x.s)) AS hit FROM kept n JOIN b x ON x.item_key = n.item_key AND x.h <> '' AND (contains(x.h, n.h) OR contains(n.h, x.h)) GROUP BY ALL),
    z AS (SELECT item_key, total, entry, level, told, hit[2] AS s FROM m),
    w AS (SELECT *, last_value(CASE WHEN level = 1 THEN told END IGNORE NULLS) OVER (PARTITION BY item_key ORDER BY s, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM z)
    SELECT item_key, entry - 1 AS entry, coalesce(told, CASE WHEN level >= 2 THEN above END, 'unknown') AS label, CASE WHEN told IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM w""")
def contents_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings as contents lists, matched with themselves as boxes: words, weights of deep levels, inheritance."""
    boxes = _header_boxes(spark, d)
    toc = boxes.select("item_key", F.col("box_index").cast("long").alias("entry"), F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.col("text").alias("title"), "page_num")
    return layout.toc_sections(layout.toc_matches(layout.counted(toc), boxes, "item_key"), "item_key").select("item_key", "entry", "label", "confidence")


@query("doi_normalise", "SELECT DISTINCT doi, regexp_replace('https://doi.org/' || doi, '^https?://(dx\\.)?doi\\.org/', '') AS bare FROM library_items WHERE doi IS NOT NULL")
def doi_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "library_items").where("doi is not null").select("doi", tx.bare_doi(F.concat(F.lit("https://doi.org/"), "doi")).alias("bare")).distinct()


def _expanded(source: str) -> str:
    """CTEs x0, x1, ...: forms (publication, f) with the first place of each abbreviation replaced in every way."""
    out = [f"x0 AS (SELECT DISTINCT publication, lower(publication) AS f FROM {source})"]
    for i, (short, fulls) in enumerate(tx.ABBREVIATIONS):
        options = ", ".join(f"'{full}'" for full in fulls)
        out.append(f"x{i + 1} AS (SELECT publication, CASE WHEN o IS NULL THEN f ELSE f[1 : instr(f, '{short}') - 1] || o || f[instr(f, '{short}') + {len(short)} :] END AS f FROM (SELECT publication, f, unnest(CASE WHEN contains(f, '{short}') THEN [{options}] ELSE [NULL] END) AS o FROM x{i}))")
    return ", ".join(out)


_LAST = f"x{len(tx.ABBREVIATIONS)}"
_NORM = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[&:\\-/]', ' ', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g'))"


@query("title_expansions", f"WITH {_expanded('library_items WHERE publication IS NOT NULL')} SELECT DISTINCT publication, {_NORM('f')} AS form FROM {_LAST}")
def title_expansions(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "library_items").where("publication is not null").select("publication").distinct()
    return names.select("publication", F.explode(tx.title_expansions(F.col("publication"))).alias("form"))


#: All pairs: those whose edits the bound allows, then the longest common subsequence row by row.
_FUZZY = f"""nm AS (SELECT DISTINCT publication, {_NORM('publication')} AS norm FROM library_items WHERE trim(publication) <> ''), tl AS (SELECT {_NORM('title_normalized')} AS title, min(quartile) AS quartile FROM scimago_quartiles WHERE title_normalized IS NOT NULL AND quartile IS NOT NULL GROUP BY 1),
    {_expanded("nm")}, h1 AS (SELECT publication, quartile, 1 AS tier, 100.0::DOUBLE AS score FROM nm JOIN tl ON title = norm), h2 AS (SELECT DISTINCT publication, quartile, 2 AS tier, 100.0::DOUBLE AS score FROM {_LAST} JOIN tl ON title = {_NORM('f')}),
    pr AS (SELECT publication, norm, title, quartile FROM nm JOIN tl ON levenshtein(norm, title) * 10 <= length(norm) + length(title) WHERE length(norm) > 0 AND length(title) > 0 AND publication NOT IN (SELECT publication FROM h1 UNION ALL SELECT publication FROM h2)),
    dp AS (SELECT publication, norm, title, quartile, 0 AS i, list_transform(range(0, length(title) + 1), lambda z: 0) AS r FROM pr
        UNION ALL SELECT publication, norm, title, quartile, i + 1, list_reduce(range(1, length(title) + 1), lambda acc, j: list_append(acc, greatest(acc[j], r[j + 1], r[j] + CASE WHEN norm[i + 1 : i + 1] = title[j : j] THEN 1 ELSE 0 END)), [0]) FROM dp WHERE i < length(norm)),
    h3 AS (SELECT publication, quartile, 3 AS tier, 200.0 * r[-1] / (length(norm) + length(title)) AS score FROM dp WHERE i = length(norm) AND 200.0 * r[-1] / (length(norm) + length(title)) >= 90),
    hs AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3), best AS (SELECT publication, min((tier, -score, quartile)) AS b FROM hs GROUP BY 1)"""


@query("quartile_lookup", f"WITH RECURSIVE {_FUZZY} SELECT publication, b[3] AS quartile, b[1] AS tier FROM nm LEFT JOIN best USING (publication)")
def quartile_lookup(spark: SparkSession, d: str) -> DataFrame:
    return journals.quartiles(table(spark, d, "library_items"), _titles(spark, d))


@query("upsert_latest", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey - 1, 'changed' FROM orders WHERE o_orderkey % 3 = 0")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """A third of the orders changed, and as many new ones."""
    old = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    some = old.where("o_orderkey % 3 = 0").withColumn("status", F.lit("changed"))
    return index_store.upserted(old, some.unionByName(some.withColumn("o_orderkey", -F.col("o_orderkey") - 1)), ["o_orderkey"])


@query("content_hash", "SELECT doc_id, sha256(encode(text)[1:65536]) AS hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", indexing.content_hash(F.encode("text", "UTF-8")).alias("hash"))


@query("hashed_embedding")
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return indexing.embedded(docs, "text", indexing.HashedWords(32)).select("doc_id", "embedding")
