"""Statistics over the index, runs, pages and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADES = ("A", "B", "C", "D", "F")
# Prices per million tokens.
TOKEN_PRICES = {"input_tokens": 1.0, "output_tokens": 5.0, "cache_write_tokens": 1.25, "cache_read_tokens": 0.10}


def index_totals(index: DataFrame) -> DataFrame:
    """total_documents, total_chunks, avg_chunks_per_doc in one pass over two columns."""
    out = index.agg(F.count_distinct("doc_id").alias("total_documents"), F.count("*").alias("total_chunks"))
    return out.withColumn("avg_chunks_per_doc", F.when(F.col("total_documents") > 0, F.round(F.col("total_chunks") / F.col("total_documents"), 1)).otherwise(0.0))


def coverage(index: DataFrame, column: str) -> DataFrame:
    """(value, n) of sections or chunk types."""
    return index.groupBy(F.coalesce(column, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def journal_coverage(index: DataFrame) -> DataFrame:
    """(quartile, n): documents, not chunks, by quartile."""
    docs = index.groupBy("doc_id").agg(F.max("journal_quartile").alias("q"))
    return docs.groupBy(F.coalesce("q", F.lit("unknown")).alias("quartile")).agg(F.count("*").alias("n"))


def index_stats(index: DataFrame) -> DataFrame:
    """One row: index_totals, and section_coverage, journal_coverage (documents) and chunk_types as maps from value to number."""
    tag = lambda df, what, value: df.select(F.lit(what).alias("what"), F.col(value).alias("value"), "n")
    every = tag(coverage(index, "section"), "section", "value").unionByName(tag(journal_coverage(index), "journal", "quartile")).unionByName(tag(coverage(index, "chunk_type"), "type", "value"))
    total = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0))
    as_map = lambda what: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("value", "n")))))
    out = every.agg(total("journal").alias("total_documents"), total("type").alias("total_chunks"), as_map("section").alias("section_coverage"), as_map("journal").alias("journal_coverage"), as_map("type").alias("chunk_types"))
    mean = F.when(F.col("total_documents") > 0, F.round(F.col("total_chunks") / F.col("total_documents"), 1)).otherwise(0.0)
    return out.select("total_documents", "total_chunks", mean.alias("avg_chunks_per_doc"), "section_coverage", "journal_coverage", "chunk_types")


def token_cost():
    """Cost of a call from its four token counts."""
    total = F.lit(0.0)
    for name, price in TOKEN_PRICES.items():
        total = total + F.col(name) * price / 1e6
    return total


def cost_summary(log: DataFrame) -> DataFrame:
    """Total and mean cost (6 places), entries and tokens."""
    return log.agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"), F.count("*").alias("total_tables"), F.round(F.coalesce(F.avg("cost_usd"), F.lit(0.0)), 6).alias("avg_cost_per_table_usd"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKEN_PRICES])


def cost_sessions(log: DataFrame) -> DataFrame:
    """Each session's first time (blank ones don't count), entries and cost."""
    first = F.min(F.when(F.col("timestamp") != "", F.col("timestamp")))
    return log.groupBy("session_id").agg(first.alias("started"), F.count("*").alias("tables"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def recent_costs(log: DataFrame, last_n: int = 10) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), F.desc("table_id")).limit(max(0, last_n)).orderBy("timestamp", "table_id")


def page_stats(pages: DataFrame) -> DataFrame:
    """Pages in all, with text, empty, and recognised by OCR (hardly any native text, though there is text)."""
    n = F.length(F.trim(F.coalesce("markdown", F.lit(""))))
    native = F.col("native_chars") if "native_chars" in pages.columns else n
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return pages.agg(F.count("*").alias("total_pages"), count((n > 0) & ~((native < 20) & (n > 20))).alias("text_pages"), count(n == 0).alias("empty_pages"), count((native < 20) & (n > 20)).alias("ocr_pages"))


def grade_histogram(rows: DataFrame, column: str = "quality_grade") -> DataFrame:
    """(grade, n) of the five grades, those without any as 0."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(column).alias("grade")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(g,) for g in GRADES], "grade string").join(counts, "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("n"))


def status_counts(log: DataFrame, column: str = "outcome") -> DataFrame:
    return log.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))


def tree(index: DataFrame) -> DataFrame:
    """Per document its chunks by type, ordered by page and position: what an index viewer shows."""
    entry = F.struct(F.coalesce("page_num", F.lit(0)).alias("page_num"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "chunk_id")
    return index.groupBy("doc_id", "chunk_type").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def index_fences(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median and upper fence q3 + 1.5 (q3 - q1) of each key with at least three values; quartiles are taken by index, not interpolated."""
    sorted_ = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("v")).where(F.size("v") >= 3)
    n = F.size("v")
    at = lambda i: F.get("v", F.floor(i).cast("int"))
    q1, q3 = at(n / 4), at(n * 3 / 4)
    return sorted_.select(key, at(n / 2).alias("median"), (q3 + (q3 - q1) * 1.5).alias("fence"))


def dominant(rows: DataFrame, keys: list[str], by: list[str], weight: str) -> DataFrame:
    """The combination of ``by`` with the greatest summed weight for each key, as the body font of a document."""
    sums = rows.groupBy(*keys, *by).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*keys).agg(F.max_by(F.struct(*by), F.struct("_w", *by)).alias("d")).select(*keys, "d.*")


def report(results: DataFrame, most: int = 200) -> str:
    """A Markdown report over index results (item_key, title, status, reason, n_chunks, n_tables, quality_grade).

    Counts by status and grade, then a list for each status. A list shows ``most`` items at most and says how many more
    there are; ``results`` holds them all.
    """
    counts = {r["status"]: r["n"] for r in results.groupBy("status").agg(F.count("*").alias("n")).collect()}  # four statuses
    grades = {r["grade"]: r["n"] for r in grade_histogram(results).collect()}
    rank = F.row_number().over(W.partitionBy("status").orderBy("item_key"))
    shown = results.withColumn("_n", rank).where(F.col("_n") <= most).orderBy("status", "item_key").collect()  # ``most`` rows a status
    safe = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["# Index report", "", "| status | items |", "|---|---|", *[f"| {s} | {n} |" for s, n in sorted(counts.items())], "", "| grade | items |", "|---|---|", *[f"| {g} | {grades.get(g, 0)} |" for g in GRADES]]
    for status in sorted(counts):
        rows = [r.asDict() for r in shown if r["status"] == status]
        last = ("chunks", "tables", "grade") if status == "indexed" else ("reason",)
        lines += ["", f"| {status} | title | {' | '.join(last)} |", "|---|---|" + "---|" * len(last)]
        for r in rows:
            tail = (r.get("n_chunks"), r.get("n_tables"), r.get("quality_grade")) if status == "indexed" else (r.get("reason"),)
            lines.append(f"| {safe(r['item_key'])} | {safe((r['title'] or '')[:40])} | {' | '.join(map(safe, tail))} |")
        if counts[status] > len(rows):
            lines.append(f"| ... | and {counts[status] - len(rows)} more | {' | '.join('' for _ in last)} |")
    return "\n".join(lines) + "\n"


def running_index(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Position from 0 of each row within its keys."""
    return rows.withColumn("running_index", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
