"""Planning and running of indexing: what is new or changed, extraction, embedding, rows of the index."""

from __future__ import annotations

import hashlib
import math
import time
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import stripped

HASHED_BYTES = 65_536
EMBED_BATCH, EMBED_TRIES, EMBED_WAIT, EMBED_TIMEOUT = 100, 3, 2.0, 120.0  # texts a request, tries, first pause and longest wait in seconds


class Embedder(Protocol):
    """Texts to vectors; shipped to the executors."""

    dimensions: int

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]: ...


class HashedWords:
    """A deterministic embedder without a model: signed hashes of words and their pairs, length one."""

    def __init__(self, dimensions: int = 96):
        self.dimensions = dimensions

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            words = (text or "").lower().split()
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            size = math.sqrt(float(v @ v))
            out.append((v / size if size else v).tolist())
        return out


class EmbeddingError(RuntimeError):
    """A batch could not be embedded after all tries."""


def embed_all(embedder: Embedder, texts: list[str], batch: int = EMBED_BATCH, tries: int = EMBED_TRIES, wait: float = EMBED_WAIT, timeout: float = EMBED_TIMEOUT) -> list[list[float]]:
    """Vectors of texts in batches; a batch that fails or takes too long is tried again after a growing pause."""
    out: list[list[float]] = []
    with ThreadPoolExecutor(1) as pool:
        for at in range(0, len(texts), batch):
            for turn in range(tries):
                try:
                    out += pool.submit(embedder.embed, texts[at : at + batch]).result(timeout)
                    break
                except Exception as e:
                    if turn == tries - 1:
                        raise EmbeddingError(f"{len(texts[at : at + batch])} texts: {type(e).__name__}: {e}") from e
                    time.sleep(wait * 2**turn)
    return out


def embedded(rows: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """Rows with the vector of a text column, embedded in Arrow batches, each in requests of EMBED_BATCH texts with retries."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(embed_all(embedder, ["" if t is None else t for t in texts]))

    return rows.withColumn(out, vectors(text))


def content_hash(content: Column) -> Column:
    """Hash of the first 64 KiB of a file."""
    return F.sha2(F.substring(content, 1, HASHED_BYTES), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def plan(current: DataFrame, indexed: DataFrame, empty: DataFrame | None = None, key: str = "item_key") -> DataFrame:
    """(key, hash, action): new, changed, no_hash (indexed without one), current, empty (known to have no text), gone.

    current: key, hash; indexed: key, old_hash; empty: key, hash of documents that gave no text.
    """
    known = indexed.select(key, F.col("old_hash"), F.lit(True).alias("_known"))
    out = current.select(key, "hash").join(known, key, "full")
    if empty is not None:
        out = out.join(empty.select(key, F.col("hash").alias("_empty")), key, "left")
    else:
        out = out.withColumn("_empty", F.lit(None).cast("string"))
    action = (
        F.when(F.col("hash").isNull() & F.col("_known").isNotNull(), "gone").when(F.col("_known").isNull() & (F.col("_empty") == F.col("hash")), "empty").when(F.col("_known").isNull(), "new")
        .when(F.coalesce("old_hash", F.lit("")) == "", "no_hash").when(F.col("old_hash") != F.col("hash"), "changed").otherwise("current")
    )
    return out.select(key, "hash", action.alias("action"))


def select_items(library: DataFrame, item_key: str | None = None, title_pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Items to consider: with a PDF, of one key, whose title matches a pattern, the first ``limit`` by key (0: all)."""
    rows = library.where(F.col("pdf_path").isNotNull())
    if item_key:
        rows = rows.where(F.col("item_key") == item_key)
    if title_pattern:
        rows = rows.where(F.col("title").rlike("(?i)" + title_pattern))
    return rows.orderBy("item_key").limit(limit) if limit else rows


def chunk_id(doc: Column, kind: str, *numbers: Column) -> Column:
    pattern = {"text": "%s_chunk_%04d", "table": "%s_table_%04d_%02d", "figure": "%s_fig_%03d_%02d"}[kind]
    return F.format_string(pattern, doc, *numbers)


META = ("pdf_hash", "doc_title", "authors", "year", "citation_key", "publication", "doi", "tags", "collections", "journal_quartile", "quality_grade")


def text_rows(passages: DataFrame, documents: DataFrame, key: str = "item_key") -> DataFrame:
    """Index rows of text passages with their document's attributes."""
    total = passages.groupBy(key).agg(F.count("*").alias("total_chunks"))
    return passages.join(documents, key).join(total, key).select(chunk_id(F.col(key), "text", F.col("chunk_index")).alias("chunk_id"), F.lit("text").alias("chunk_type"), F.col(key).alias("doc_id"), "chunk_index", "page_num", "section", "section_confidence", "char_start", "char_end", "total_chunks", "passage", *META)


def table_rows(tables: DataFrame, documents: DataFrame, key: str = "item_key") -> DataFrame:
    """Index rows of tables; the passage is the table's Markdown."""
    return tables.join(documents, key).select(chunk_id(F.col(key), "table", F.col("page_num"), F.col("table_index")).alias("chunk_id"), F.lit("table").alias("chunk_type"), F.col(key).alias("doc_id"), "chunk_index", "page_num", F.lit("table").alias("section"), F.lit(1.0).alias("section_confidence"), "table_index", F.col("caption").alias("table_caption"), "n_rows", "n_cols", "reference_context", F.col("markdown").alias("passage"), *META)


def figure_text(caption: Column, page: Column, context: Column) -> Column:
    """Searchable text of a figure: caption, or its page, and the passage that mentions it."""
    head = F.coalesce(F.when(stripped(caption) != "", caption), F.concat(F.lit("Figure on page "), page.cast("string")))
    return F.concat_ws("\n", head, F.when(F.coalesce(context, F.lit("")) != "", context))


def figure_rows(figures: DataFrame, documents: DataFrame, key: str = "item_key") -> DataFrame:
    """Index rows of figures (key, page_num, figure_index, caption, image_path, reference_context, chunk_index)."""
    return figures.join(documents, key).select(chunk_id(F.col(key), "figure", F.col("page_num"), F.col("figure_index")).alias("chunk_id"), F.lit("figure").alias("chunk_type"), F.col(key).alias("doc_id"), "chunk_index", "page_num", F.lit("figure").alias("section"), F.lit(1.0).alias("section_confidence"), "figure_index", "caption", "image_path", "reference_context", figure_text(F.col("caption"), F.col("page_num"), F.col("reference_context")).alias("passage"), *META)


def extract(files: DataFrame, extractor, schema: str) -> DataFrame:
    """Pages of binary files (key, content) by ``extractor(key, content) -> list of dicts``; a file that fails gives one row with its reason.

    ``schema`` must hold the columns status and reason.
    """

    def batches(parts):
        for pdf in parts:
            rows = []
            for key, content in zip(pdf.iloc[:, 0], pdf["content"]):
                try:
                    rows += [dict(r, status="ok", reason=None) for r in extractor(key, content)]
                except Exception as e:  # one broken file must not stop the others
                    rows.append({pdf.columns[0]: key, "status": "failed", "reason": str(e)[:200]})
            names = [x.split()[0] for x in schema.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(batches, schema)
