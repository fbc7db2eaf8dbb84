"""Indexing a library from end to end: plan, extraction, passages, tables, figures, vectors, store, ledger, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.config import Settings
from quillstack.operators import captions, chunking, completeness, indexing, journals, layout, reference, stats, tables
from quillstack.operators.indexing import Embedder, HashedWords
from quillstack.runtime import written
from quillstack.sources.index_store import IndexStore


def documents_of(pages: DataFrame) -> DataFrame:
    """(item_key, full_markdown) from pages, joined in order by line feeds; a null page counts as empty."""
    texts = F.array_sort(F.collect_list(F.struct("page_num", "page_id", F.coalesce("markdown", F.lit("")).alias("t"))))
    return pages.groupBy("item_key").agg(F.array_join(F.transform(texts, lambda p: p["t"]), "\n").alias("full_markdown"))


def index_rows(docs: DataFrame, pages: DataFrame, meta: DataFrame, embedder: Embedder, size: int = 400, overlap: int = 100) -> DataFrame:
    """Index rows of documents: passages with page and section, real tables and figures at the passage that mentions them, vectors.

    docs: item_key, full_markdown; pages: item_key, page_num, markdown, char_start, images_on_page; meta: item_key and
    the attributes of indexing.META. Tables that are something else (contents lists and the like) are left out; a table
    or figure whose caption numbers it carries the passage of its first mention as ``reference_context``.
    """
    passages = chunking.chunks(docs.repartition("item_key"), "item_key", "full_markdown", size, overlap)
    passages = chunking.with_page(passages, pages, "item_key")
    passages = written(chunking.with_section(passages, chunking.section_spans(docs, "item_key", "full_markdown"), "item_key"), "passages")
    refs = written(reference.first_references(docs, "item_key", "full_markdown"), "references")
    found = tables.markdown_tables(pages, ["item_key", "page_num"]).withColumn("kind", F.lit("table")).withColumn("number", tables.number_of(F.col("caption")))
    found = found.where(tables.artifact(F.col("headers"), F.col("rows"), F.col("caption")).isNull())
    images = pages.where("images_on_page > 0").select("item_key", "page_num", F.explode(F.sequence(F.lit(0), F.col("images_on_page") - 1)).alias("figure_index"))
    nth = F.row_number().over(W.partitionBy("item_key", "page_num").orderBy("line_no")) - 1
    named = captions.captions(pages, ["item_key", "page_num"]).where("kind = 'figure'").select("item_key", "page_num", nth.alias("figure_index"), "caption")
    images = images.join(named, ["item_key", "page_num", "figure_index"], "left").withColumn("kind", F.lit("figure")).withColumn("number", tables.number_of(F.col("caption"))).withColumn("image_path", layout.image_name("item_key", "page_num", "figure_index"))
    mentions = reference.reference_chunks(refs, passages, "item_key").join(passages.select("item_key", "chunk_index", "passage"), ["item_key", "chunk_index"]).drop("chunk_index")
    context = lambda objects: layout.with_reference_context(reference.anchors(objects, refs, passages, "item_key"), mentions, ["item_key", "kind", "number"])
    as_text = tables.to_markdown(F.col("headers"), F.col("rows"), F.col("caption"), F.lit(None).cast("string"))
    table_rows = indexing.table_rows(context(found).withColumn("markdown", as_text).withColumn("caption", tables.synthetic_caption("table", F.col("caption"), F.col("page_num"))), meta)
    figure_rows = indexing.figure_rows(context(images).withColumn("caption", tables.synthetic_caption("figure", F.col("caption"), F.col("page_num"))), meta)
    rows = indexing.text_rows(passages, meta).unionByName(table_rows, allowMissingColumns=True).unionByName(figure_rows, allowMissingColumns=True)
    return indexing.embedded(rows, "passage", embedder)


@dataclass
class IndexReport:
    """What a run did. ``results``: item_key, title, status (indexed, empty, skipped, failed), reason, n_chunks, n_tables, quality_grade."""

    results: DataFrame
    counts: dict[str, int]
    grades: dict[str, int]
    pages: dict[str, int]
    settings_changed: bool

    def markdown(self) -> str:
        return stats.report(self.results)


RESULT = "item_key string, title string, status string, reason string, n_chunks bigint, n_tables bigint, quality_grade string"


class LibraryIndexer:
    """Keeps an index below ``root`` up to date with a library.

    The store, the ledger of documents without text and the fingerprint of the settings are published in one step.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), embedder: Embedder | None = None, buckets: int = 64):
        self.spark, self.settings = spark, settings
        self.store = IndexStore(spark, root, buckets)
        self.embedder = embedder or HashedWords(settings.embedding_dimensions)

    def ledger(self) -> DataFrame:
        """(item_key, hash) of documents known to give no text."""
        folder = self.store.state().get("ledger")
        return self.store.log.load([folder]) if folder else self.spark.createDataFrame([], "item_key string, hash string")

    def run(self, library: DataFrame, pages: DataFrame, titles: DataFrame | None = None, force: bool = False, limit: int | None = None, item_key: str | None = None, title_pattern: str | None = None) -> IndexReport:
        """One run over ``library`` (item_key, title, hash of the file, pdf_path and attributes) and the ``pages`` extracted from it.

        pages: page_id, item_key, page_num, markdown, images_on_page and, if extraction can fail, status and reason: a
        document with a failed row is reported, the others go on. Only new and changed documents are worked on, or all
        with ``force``. Documents that vanished from the library stay in the index. Null keys take no part.
        """
        problems = self.settings.problems()
        if problems:
            raise ValueError("; ".join(problems))
        state = self.store.state()
        fingerprint = self.settings.fingerprint()
        items = indexing.select_items(library.where("item_key is not null").dropDuplicates(["item_key"]), item_key, title_pattern, limit)
        items = written(items, "items")
        rows = self.store.read()
        if rows is None:
            have = self.spark.createDataFrame([], "item_key string, old_hash string")
        else:
            have = rows.groupBy(F.col("doc_id").alias("item_key")).agg(F.max("pdf_hash").alias("old_hash"))
        have = have.join(items.select("item_key"), "item_key", "left_semi")
        ledger = self.ledger()
        current = items.select("item_key", F.coalesce("hash", F.lit("")).alias("hash"))
        if force:
            plan = current.withColumn("action", F.lit("new"))
        else:
            plan = indexing.plan(current, have, ledger)
        plan = written(plan, "plan")
        todo = plan.where(F.col("action").isin("new", "changed", "no_hash")).select("item_key", "hash")
        pages = pages.join(todo.select("item_key"), "item_key", "left_semi")
        if "status" not in pages.columns:
            pages = pages.withColumn("status", F.lit("ok")).withColumn("reason", F.lit(None).cast("string"))
        broken = pages.where("status = 'failed'").groupBy("item_key").agg(F.min("reason").alias("why"))
        pages = written(pages.where("status <> 'failed'").join(broken, "item_key", "left_anti").dropDuplicates(["page_id"]), "pages")
        pages = chunking.page_offsets(pages, "item_key", "markdown")
        docs = written(documents_of(pages), "documents")
        grades = self.grades(docs, pages)
        meta = items.join(todo.select("item_key"), "item_key", "left_semi")
        if titles is not None and "publication" in meta.columns:
            found = journals.quartiles(meta, titles).select("publication", F.col("quartile").alias("journal_quartile"))
            meta = meta.drop("journal_quartile").join(found, "publication", "left")
        meta = meta.withColumnRenamed("title", "doc_title").withColumnRenamed("hash", "pdf_hash").join(grades, "item_key", "left")
        for c in indexing.META:
            if c not in meta.columns:
                meta = meta.withColumn(c, F.lit(None).cast("string"))
        new = written(index_rows(docs, pages, meta.select("item_key", *indexing.META), self.embedder, self.settings.chunk_size, self.settings.chunk_overlap), "index")
        made = new.groupBy(F.col("doc_id").alias("item_key")).agg(F.sum((F.col("chunk_type") == "text").cast("long")).alias("n_chunks"), F.sum((F.col("chunk_type") == "table").cast("long")).alias("n_tables"))
        sizes = pages.groupBy("item_key").agg(F.count("*").alias("n_pages"), F.sum(F.length(F.coalesce("markdown", F.lit("")))).alias("chars"))
        told = todo.join(items.select("item_key", "title"), "item_key").join(broken, "item_key", "left").join(sizes, "item_key", "left").join(made, "item_key", "left").join(grades, "item_key", "left")
        pages_said = F.concat(F.col("n_pages").cast("string"), F.lit(" pages"))
        why = F.when(F.col("n_pages").isNull(), "no pages (corrupt or unreadable)").when(F.col("chars") == 0, F.concat(pages_said, F.lit(" but no text"))).otherwise(F.concat(pages_said, F.lit(" but no passages")))
        n = F.coalesce("n_chunks", F.lit(0))
        status = F.when(F.col("why").isNotNull(), "failed").when(n > 0, "indexed").otherwise("empty")
        done = told.select("item_key", "title", status.alias("status"), F.when(F.col("why").isNotNull(), F.col("why")).when(n == 0, why).alias("reason"), n.alias("n_chunks"), F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.when(F.col("why").isNull(), F.coalesce("quality_grade", F.lit("F"))).alias("quality_grade"))
        skipped = plan.where("action = 'empty'").join(items.select("item_key", "title"), "item_key").select("item_key", "title", F.lit("skipped").alias("status"), F.lit("no text (unchanged file)").alias("reason"), F.lit(0).cast("long").alias("n_chunks"), F.lit(0).cast("long").alias("n_tables"), F.lit(None).cast("string").alias("quality_grade"))
        results = written(done.unionByName(skipped), "results")
        counts = {r["status"]: r["n"] for r in results.groupBy("status").agg(F.count("*").alias("n")).collect()}  # four statuses
        counts = {s: counts.get(s, 0) for s in ("indexed", "failed", "empty", "skipped")}
        counts["already_indexed"] = plan.where("action = 'current'").count()
        empty = results.where("status = 'empty'").join(todo, "item_key").select("item_key", "hash")
        kept = ledger.join(todo.select("item_key"), "item_key", "left_anti")
        # tables of documents without any passage are no index
        good = new.join(results.where("status = 'indexed'").select(F.col("item_key").alias("doc_id")), "doc_id", "left_semi")
        state = {"ledger": self.store.log.save(kept.select("item_key", "hash").unionByName(empty), self.store.log.last()[0] + 1, "ledger"), "fingerprint": state.get("fingerprint")}
        changed = state["fingerprint"] not in (None, fingerprint) and not force
        if counts["indexed"] or counts["already_indexed"]:
            state["fingerprint"] = fingerprint
        self.store.replace(good if counts["indexed"] else None, todo.select(F.col("item_key").alias("doc_id")), state)
        histogram = {r["grade"]: r["n"] for r in stats.grade_histogram(results).collect()}  # five grades
        return IndexReport(results, counts, histogram, stats.page_stats(pages).first().asDict(), changed)

    def grades(self, docs: DataFrame, pages: DataFrame) -> DataFrame:
        """(item_key, quality_grade) of documents from what was found on their pages."""
        spans = chunking.section_spans(docs, "item_key", "full_markdown")
        found = tables.markdown_tables(pages, ["item_key", "page_num"]).where(tables.artifact(F.col("headers"), F.col("rows"), F.col("caption")).isNull()).select("item_key", "caption")
        named = captions.captions(pages, ["item_key", "page_num"])
        on_page = named.where("kind = 'figure'").groupBy("item_key", "page_num").agg(F.count("*").alias("named"))
        figures = pages.where("images_on_page > 0").join(on_page, ["item_key", "page_num"], "left").select("item_key", F.explode(F.sequence(F.lit(1), "images_on_page")).alias("n"), "named")
        figures = figures.select("item_key", F.when(F.col("n") <= F.col("named"), "named").alias("caption"))
        rows = layout.completeness_rows(pages, named, found, figures, spans, "item_key")
        return rows.select("item_key", completeness.grade().alias("quality_grade"))
