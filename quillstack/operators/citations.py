"""Citation lookups over works and citation edges; all are one step away, so they are plain joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import bare_doi

PAGE_CAP = 200


def work_of(works: DataFrame, doi: Column | str) -> DataFrame:
    return works.where(F.lower(bare_doi(F.col("doi"))) == F.lower(bare_doi(F.lit(doi) if isinstance(doi, str) else doi)))


def shown() -> list[Column]:
    """The columns of a listed work; of its authors the first three."""
    return [F.col("title"), F.array_join(F.slice("authors", 1, 3), ", ").alias("authors"), F.col("year"), F.col("doi"), F.col("cited_by_count"), F.col("work_id")]


def citing(works: DataFrame, cites: DataFrame, work_id, limit: int = 20) -> DataFrame:
    """Works that cite ``work_id``, the most cited first. cites: src cites dst."""
    src = cites.where(F.col("dst") == work_id).select(F.col("src").alias("work_id")).distinct()
    return works.join(src, "work_id", "left_semi").select(*shown()).orderBy(F.desc("cited_by_count"), "work_id").limit(max(1, min(limit, PAGE_CAP)))


def references(works: DataFrame, cites: DataFrame, work_id, limit: int = 50) -> DataFrame:
    """Works cited by ``work_id``, in the order of its bibliography (column ``position`` of cites)."""
    dst = cites.where(F.col("src") == work_id).groupBy(F.col("dst").alias("work_id")).agg(F.min("position").alias("position"))
    return works.join(dst, "work_id").orderBy("position", "work_id").limit(max(1, min(limit, PAGE_CAP))).select(*shown())


def citation_counts(cites: DataFrame) -> DataFrame:
    """(work_id, cited_by_count, reference_count) of every work in the edges; repeated edges count once."""
    edges = cites.select("src", "dst").distinct()
    both = edges.select(F.col("dst").alias("work_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("work_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("work_id").agg(F.sum("i").alias("cited_by_count"), F.sum("o").alias("reference_count"))
