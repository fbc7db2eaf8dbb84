"""Passage, topic, table and figure search: filters, cosine top-k, context windows, reranking, topic scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.config import NO_QUARTILE, OTHER_SECTION, QUARTILE_WEIGHTS, SECTION_WEIGHTS
from quillstack.functions.text import has_terms
from quillstack.functions.vector import cosine, literal

FETCH_CAP, TOPIC_CAP, OBJECT_CAP = 150, 600, 90
TOP_CAP, OBJECT_TOP_CAP = 50, 30


def native_filter(rows: DataFrame, year_min: int | None = None, year_max: int | None = None, chunk_types: list[str] | None = None) -> DataFrame:
    """Filters that reach the scan. 0 and None set no bound; an unknown year (null) passes year_max and fails year_min."""
    if year_min:
        rows = rows.where(F.col("year") >= year_min)
    if year_max:
        rows = rows.where(F.col("year").isNull() | (F.col("year") <= year_max))
    if chunk_types:
        rows = rows.where(F.col("chunk_type").isin(*chunk_types))
    return rows


def text_filter(rows: DataFrame, author: str | None = None, tag: str | None = None, collection: str | None = None) -> DataFrame:
    """Substrings of authors, tags and collections, whatever their case; all must hold."""
    for column, part in (("authors", author), ("tags", tag), ("collections", collection)):
        if part:
            rows = rows.where(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(part.lower())))
    return rows


def cosine_top_k(rows: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The k rows most similar to the query, exactly; ``score`` is the cosine, ``fetch_rank`` counts from 1. Ties go by key."""
    scored = rows.withColumn("score", cosine(F.col(vector), literal(query))).where(F.col("score").isNotNull())
    top = scored.orderBy(F.desc("score"), key).limit(k)  # TakeOrderedAndProject: k rows per task meet
    return top.withColumn("fetch_rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def weight(column: Column, weights: dict[str, float], other: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, column), F.lit(other))


def composite(score: Column, section: Column, quartile: Column, alpha: float = 0.7, section_weights: dict | None = None, journal_weights: dict | None = None, guard: bool = True) -> Column:
    """max(similarity, 0)^alpha x section weight x journal weight; overrides are clamped to [0, 1].

    Without ``guard``, for the score of a single row, a negative similarity has no score: null.
    """
    clamp = lambda given: {k: min(1.0, max(0.0, float(v))) for k, v in (given or {}).items()}
    journals = QUARTILE_WEIGHTS | clamp(journal_weights)
    unknown = journals.pop("unknown", NO_QUARTILE)
    sections = SECTION_WEIGHTS | clamp(section_weights)
    base = F.greatest(score, F.lit(0.0)) if guard else F.when(score >= 0, score)
    return F.pow(base, F.lit(alpha)) * weight(F.coalesce(section, F.lit("unknown")), sections, OTHER_SECTION) * weight(F.coalesce(quartile, F.lit("")), journals, unknown)


def rerank(hits: DataFrame, top_k: int, alpha: float = 0.7, section_weights: dict | None = None, journal_weights: dict | None = None, enabled: bool = True) -> DataFrame:
    """Hits with ``composite_score``, best first, those of 0 left out; equal ones keep the order of similarity."""
    score = composite(F.col("score"), F.col("section"), F.col("journal_quartile"), alpha, section_weights, journal_weights) if enabled else F.col("score")
    ranked = hits.withColumn("composite_score", score)
    if enabled:
        ranked = ranked.where("composite_score > 0")
    return ranked.orderBy(F.desc("composite_score"), "fetch_rank").limit(top_k)


def with_context(hits: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """``context_before``, ``context_after`` (arrays by position) and ``full_context`` of each hit; one band join for all hits.

    ``hits`` is the bounded result of a search, so it is the side that is broadcast.
    """
    near = index.select(F.col("doc_id").alias("n_doc"), F.col("chunk_index").alias("n_index"), F.col("passage").alias("n_passage")).where(F.col("n_index") >= 0)
    small = F.broadcast(hits.select("chunk_id", "doc_id", "chunk_index"))
    band = near.join(small, (F.col("n_doc") == F.col("doc_id")) & (F.col("n_index") != F.col("chunk_index")) & F.col("n_index").between(F.col("chunk_index") - window, F.col("chunk_index") + window))
    side = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n_index", "n_passage")))), lambda x: x["n_passage"])
    around = band.groupBy("chunk_id").agg(side(F.col("n_index") < F.col("chunk_index")).alias("context_before"), side(F.col("n_index") > F.col("chunk_index")).alias("context_after"))
    none = F.array().cast("array<string>")
    out = hits.join(around, "chunk_id", "left").withColumn("context_before", F.coalesce("context_before", none)).withColumn("context_after", F.coalesce("context_after", none))
    return out.withColumn("full_context", F.array_join(F.concat("context_before", F.array("passage"), "context_after"), "\n\n"))


def fetch_size(top_k: int, multiplier: int, filtered: bool, cap: int = FETCH_CAP, factor: int = 3) -> int:
    return min(top_k * multiplier, cap) * (factor if filtered else 1)


def search_passages(index: DataFrame, query: list[float], top_k: int = 10, context: int = 1, year_min=None, year_max=None, author=None, tag=None, collection=None, chunk_types=None, section_weights=None, journal_weights=None, required_terms=None, alpha: float = 0.7, multiplier: int = 3, enabled: bool = True) -> DataFrame:
    """The top passages for a query vector, filtered, in context, reranked."""
    top_k = max(1, min(top_k, TOP_CAP))
    filtered = bool(author or tag or collection or required_terms)
    hits = cosine_top_k(native_filter(index, year_min, year_max, chunk_types), query, fetch_size(top_k, multiplier, filtered))
    hits = text_filter(hits, author, tag, collection)
    hits = with_context(hits, index, max(0, min(context, 3)))
    if required_terms:
        hits = hits.where(has_terms(F.concat_ws("\n", "passage", "full_context"), required_terms))
    return rerank(hits, top_k, alpha, section_weights, journal_weights, enabled)


def search_topic(index: DataFrame, query: list[float], num_papers: int = 10, year_min=None, year_max=None, author=None, tag=None, collection=None, chunk_types=None, section_weights=None, journal_weights=None, alpha: float = 0.7, multiplier: int = 3, topic_factor: int = 5, enabled: bool = True) -> DataFrame:
    """Papers by their passages: average and best scores, number and best one of the relevant passages."""
    num_papers = max(1, min(num_papers, TOP_CAP))
    size = fetch_size(num_papers * topic_factor, multiplier, bool(author or tag or collection), TOPIC_CAP, 2)
    hits = text_filter(cosine_top_k(native_filter(index, year_min, year_max, chunk_types), query, size), author, tag, collection)
    ranked = rerank(hits, size, alpha, section_weights, journal_weights, enabled)
    best = F.max_by(F.struct("passage", "page_num", "section", "section_confidence", "composite_score", "chunk_index"), F.struct("composite_score", -F.col("fetch_rank")))
    papers = ranked.groupBy("doc_id").agg(
        F.round(F.avg("score"), 3).alias("avg_score"), F.round(F.max("score"), 3).alias("best_chunk_score"), F.round(F.avg("composite_score"), 3).alias("avg_composite_score"), F.count("*").alias("num_relevant_chunks"),
        best.alias("best"), *[F.min(c).alias(c) for c in ("doc_title", "authors", "year", "citation_key", "publication", "journal_quartile")],
    )
    flat = papers.select("doc_id", "doc_title", "authors", "year", "citation_key", "publication", "journal_quartile", "avg_score", "best_chunk_score", "avg_composite_score", F.round("best.composite_score", 3).alias("best_composite_score"), F.col("best.section").alias("best_passage_section"), F.col("best.section_confidence").alias("best_passage_section_confidence"), "num_relevant_chunks", F.col("best.passage").alias("best_passage"), F.col("best.page_num").alias("best_passage_page"), F.col("best.chunk_index").alias("best_chunk_index"))
    return flat.orderBy(F.desc("avg_composite_score"), "doc_id").limit(num_papers)


def search_objects(index: DataFrame, query: list[float], kind: str, top_k: int = 10, year_min=None, year_max=None, author=None, tag=None, collection=None, journal_weights=None, alpha: float = 0.7, multiplier: int = 3, enabled: bool = True) -> DataFrame:
    """Tables (reranked) or figures (by similarity alone)."""
    top_k = max(1, min(top_k, OBJECT_TOP_CAP))
    size = fetch_size(top_k, 3 if kind == "figure" else multiplier, bool(author or tag or collection), OBJECT_CAP, 2)
    hits = text_filter(cosine_top_k(native_filter(index, year_min, year_max, [kind]), query, size), author, tag, collection)
    if kind == "figure":
        return hits.orderBy("fetch_rank").limit(top_k)
    return rerank(hits, top_k, alpha, None, journal_weights, enabled)


def passage_window(index: DataFrame, doc_id: str, chunk_index: int, window: int = 2) -> DataFrame:
    """Passages around a position of one document, marked at the centre; all chunk types anchored there are among them."""
    window = max(1, min(window, 5))
    near = index.where((F.col("doc_id") == doc_id) & F.col("chunk_index").between(chunk_index - window, chunk_index + window))
    return near.withColumn("is_center", F.col("chunk_index") == chunk_index).orderBy("chunk_index", "chunk_id")


def merged_text(window: DataFrame) -> DataFrame:
    """One row per document: its window's passages joined by blank lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "passage"))), lambda x: x["passage"])
    return window.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("merged_text"))
