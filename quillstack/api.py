"""The query tools over an index: each takes plain arguments and returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.config import NO_QUARTILE, QUARTILE_WEIGHTS, SECTION_WEIGHTS, Settings, check_search
from quillstack.operators import citations, library, reference, search, stats
from quillstack.operators.captions import caption_number
from quillstack.operators.indexing import Embedder, HashedWords
from quillstack.operators.library_index import IndexReport, LibraryIndexer


@dataclass
class Engine:
    """Tables and settings the tools work on. ``index`` holds chunks with ``embedding``; the other tables may be absent."""

    index: DataFrame
    settings: Settings = Settings()
    embedder: Embedder | None = None
    library: DataFrame | None = None
    words: DataFrame | None = None
    works: DataFrame | None = None
    cites: DataFrame | None = None
    costs: DataFrame | None = None

    @staticmethod
    def index_library(root: str, library: DataFrame, pages: DataFrame, settings: Settings = Settings(), embedder: Embedder | None = None, titles: DataFrame | None = None, force_reindex: bool = False, limit: int | None = None, item_key: str | None = None, title_pattern: str | None = None) -> IndexReport:
        """Bring the index below ``root`` up to date with a library; ``Engine.open`` reads it."""
        return LibraryIndexer(library.sparkSession, root, settings, embedder).run(library, pages, titles, force_reindex, limit, item_key, title_pattern)

    @classmethod
    def open(cls, spark: SparkSession, root: str, settings: Settings = Settings(), **tables) -> Engine:
        """An engine over the last version of an index."""
        index = LibraryIndexer(spark, root, settings).store.read()
        if index is None:
            raise ValueError(f"no index below {root}")
        return cls(index, settings, **tables)

    def _vector(self, query: str | list[float]) -> list[float]:
        if not isinstance(query, str):
            return list(query)
        model = self.embedder or HashedWords(self.settings.embedding_dimensions)
        return model.embed([query], query=True)[0]

    def _ranking(self, given: dict) -> dict:
        check_search(given.get("chunk_types"), given.get("section_weights"), given.get("journal_weights"))
        s = self.settings
        out = dict(given, alpha=s.rerank_alpha, multiplier=s.oversample_multiplier, enabled=s.rerank_enabled)
        out["journal_weights"] = s.journal_weights | (given.get("journal_weights") or {})
        return out

    def search_papers(self, query, top_k: int = 10, context_chunks: int = 1, **filters) -> DataFrame:
        given = self._ranking(filters)
        given["section_weights"] = self.settings.section_weights | (filters.get("section_weights") or {})
        return search.search_passages(self.index, self._vector(query), top_k, context_chunks, **given)

    def search_topic(self, query, num_papers: int = 10, **filters) -> DataFrame:
        given = self._ranking(filters)
        given["section_weights"] = self.settings.section_weights | (filters.get("section_weights") or {})
        return search.search_topic(self.index, self._vector(query), num_papers, topic_factor=self.settings.topic_oversample_factor, **given)

    def search_tables(self, query, top_k: int = 10, **filters) -> DataFrame:
        return search.search_objects(self.index, self._vector(query), "table", top_k, **self._ranking(filters))

    def search_figures(self, query, top_k: int = 10, **filters) -> DataFrame:
        return search.search_objects(self.index, self._vector(query), "figure", top_k, **{k: v for k, v in filters.items() if k != "journal_weights"})

    def get_passage_context(self, doc_id: str, chunk_index: int = 0, window: int = 2, table_page: int | None = None, table_index: int | None = None) -> DataFrame:
        """One row: the document, its passages around a position in order (the centre marked), and their merged text.

        With a table's page and index the position is the first mention of the table; table_caption, table_page,
        table_index, reference_found_in_chunk and, where there is none, ``note`` tell of it.
        """
        caption = note = None
        about_table = table_page is not None and table_index is not None
        if about_table:
            at = self.index.where((F.col("doc_id") == doc_id) & (F.col("chunk_type") == "table") & (F.col("page_num") == table_page) & (F.col("table_index") == table_index))
            row = at.select("table_caption", caption_number(F.col("table_caption")).alias("n")).first()
            if row is None:
                raise ValueError(f"no table {table_index} on page {table_page} of {doc_id}")
            caption = row["table_caption"]
            found = reference.table_mention(self.index, doc_id, row["n"]).select("chunk_index").first()
            chunk_index = found["chunk_index"] if found else None
            if found is None:
                note = "no text mentions this table"
        near = search.passage_window(self.index, doc_id, -1 if chunk_index is None else chunk_index, window)
        if about_table:
            near = near.where("chunk_type = 'text'") if chunk_index is not None else near.limit(0)
        of = self.index.where(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.min("doc_title").alias("doc_title"), F.min("citation_key").alias("citation_key"))
        passage = F.struct("chunk_index", "chunk_id", F.col("page_num").alias("page"), F.coalesce("section", F.lit("unknown")).alias("section"), F.col("passage").alias("text"), "is_center")
        passages = near.groupBy("doc_id").agg(F.array_sort(F.collect_list(passage)).alias("passages"))
        out = of.join(passages, "doc_id", "left").withColumn("merged_text", F.coalesce(F.array_join(F.transform("passages", lambda p: p["text"]), "\n\n"), F.lit("")))
        if about_table:
            said = lambda v, kind: F.lit(v).cast(kind)
            out = out.select("*", said(caption, "string").alias("table_caption"), said(table_page, "int").alias("table_page"), said(table_index, "int").alias("table_index"), said(chunk_index, "int").alias("reference_found_in_chunk"), said(note, "string").alias("note"))
        return out

    def get_index_stats(self) -> DataFrame:
        """One row: totals, and the coverage of sections, journals and chunk types as maps, over all rows."""
        return stats.index_stats(self.index)

    def get_reranking_config(self) -> dict:
        s = self.settings
        return {"enabled": s.rerank_enabled, "alpha": s.rerank_alpha, "section_weights": SECTION_WEIGHTS | s.section_weights, "journal_weights": QUARTILE_WEIGHTS | {"unknown": NO_QUARTILE} | s.journal_weights, "valid_sections": sorted(SECTION_WEIGHTS), "valid_quartiles": sorted(QUARTILE_WEIGHTS), "oversample_multiplier": s.oversample_multiplier}

    def search_boolean(self, query: str, operator: str = "AND", year_min: int | None = None, year_max: int | None = None) -> DataFrame:
        if self.words is None or self.library is None:
            raise ValueError("boolean search needs the tables words and library")
        return library.boolean_results(library.boolean_search(self.words, "item_key", query, operator), self.library, year_min, year_max)

    def _work(self, doc_id: str):
        """Work of a document by its DOI; raises if document, DOI or work is missing."""
        if self.works is None or self.cites is None:
            raise ValueError("citation lookups need the tables works and cites")
        row = self.index.where(F.col("doc_id") == doc_id).select("doi").first()
        if row is None:
            raise ValueError(f"no document {doc_id}")
        if not row["doi"]:
            raise ValueError(f"document {doc_id} has no DOI")
        work = citations.work_of(self.works, row["doi"]).first()
        if work is None:
            raise ValueError(f"no work with the DOI {row['doi']}")
        return work

    def find_citing_papers(self, doc_id: str, limit: int = 20) -> DataFrame:
        return citations.citing(self.works, self.cites, self._work(doc_id)["work_id"], limit)

    def find_references(self, doc_id: str, limit: int = 50) -> DataFrame:
        return citations.references(self.works, self.cites, self._work(doc_id)["work_id"], limit)

    def get_citation_count(self, doc_id: str) -> DataFrame:
        """doc_id, doi, work_id, cited_by_count, reference_count; only edges of the work are counted."""
        work = self._work(doc_id)
        edges = self.cites.where((F.col("src") == work["work_id"]) | (F.col("dst") == work["work_id"]))
        counts = citations.citation_counts(edges).where(F.col("work_id") == work["work_id"])
        asked = self.index.where(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.min("doi").alias("doi")).withColumn("work_id", F.lit(work["work_id"]))
        none = F.lit(0).cast("long")
        return asked.join(counts, "work_id", "left").select("doc_id", "doi", "work_id", F.coalesce("cited_by_count", none).alias("cited_by_count"), F.coalesce("reference_count", none).alias("reference_count"))

    def get_vision_costs(self, last_n: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Totals, sessions and the last entries."""
        if self.costs is None:
            raise ValueError("cost queries need the table costs")
        return stats.cost_summary(self.costs), stats.cost_sessions(self.costs), stats.recent_costs(self.costs, last_n)
