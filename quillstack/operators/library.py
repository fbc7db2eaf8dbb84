"""Library queries over bibliographic tables, boolean word search, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import author_label, year_prefix
from quillstack.runtime import small_side

NOT_ITEMS = (1, 14)  # notes and attachments
LINKED = (0, 1, 2)


def eav_columns(item_data: DataFrame, fields: DataFrame, values: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per itemid with a column per wanted field: one pass and one grouping instead of a join per field.

    ``names`` maps columns to field names, whatever their case and the blanks around them; a name may stand under
    several ids. Of several values the smallest is taken, so the result is the same every time.
    """
    bare = F.lower(F.trim("fieldname"))
    wanted = small_side(fields.where(bare.isin(*[n.lower() for n in names.values()])).select("fieldid", bare.alias("_field")))
    rows = item_data.select("itemid", "fieldid", "valueid").join(wanted, "fieldid").join(values.select("valueid", "value"), "valueid")
    return rows.groupBy("itemid").agg(*[F.min(F.when(F.col("_field") == field.lower(), F.col("value"))).alias(column) for column, field in names.items()])


def base_items(items: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Items that are neither notes nor attachments nor deleted."""
    kept = items.where(~F.col("itemtypeid").isin(*NOT_ITEMS))
    return kept.join(deleted.select("itemid"), "itemid", "left_anti") if deleted is not None else kept


def author_labels(creators: DataFrame, key: str = "itemid") -> DataFrame:
    """authors of each item from rows (key, firstname, lastname, orderindex)."""
    return creators.groupBy(key).agg(author_label(F.count("*"), F.max("lastname"), F.max("firstname"), F.max(F.when(F.col("orderindex") == 0, F.col("lastname")))).alias("authors"))


def joined_names(rows: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Names of each key joined by '; ' in alphabetical order."""
    return rows.where(F.col(name).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), "; ").alias(out))


def pdf_path(link_mode: Column, path: Column, attachment_key: Column) -> Column:
    """Place of an attachment: stored files lie in their folder, linked ones (mode 2) have none here."""
    stored = F.concat(F.lit("storage/"), attachment_key, F.lit("/"), F.regexp_replace(path, "^storage:", ""))
    return F.when(link_mode == 2, None).when(F.startswith(path, F.lit("storage:")), stored)


def items_with_pdfs(items: DataFrame, attachments: DataFrame, attributes: DataFrame, authors: DataFrame, tags: DataFrame, collections: DataFrame, deleted: DataFrame | None = None, citation_keys: DataFrame | None = None) -> DataFrame:
    """The library: one row per item with a PDF (of several the one with the lowest attachment key), absent texts as ''."""
    keys = items.select(F.col("itemid").alias("_aid"), F.col("key").alias("attachment_key"))
    pdfs = attachments.where((F.col("contenttype") == "application/pdf") & F.col("linkmode").isin(*LINKED)).join(keys, F.col("itemid") == F.col("_aid"))
    pdfs = pdfs.groupBy(F.coalesce("parentitemid", "itemid").alias("itemid")).agg(F.min(F.struct("attachment_key", "linkmode", "path")).alias("pdf"))
    out = base_items(items, deleted).select("itemid", F.col("key").alias("item_key")).join(pdfs, "itemid")
    for side in (attributes, authors, tags, collections):
        out = out.join(side, "itemid", "left")
    if citation_keys is not None:
        out = out.join(citation_keys, "item_key", "left")
    else:
        out = out.withColumn("citation_key", F.lit(""))
    text = lambda c, other="": F.coalesce(c, F.lit(other)).alias(c)
    return out.select("itemid", "item_key", text("title", "[No Title]"), text("authors", "[No Author]"), F.when(F.col("date").isNotNull(), year_prefix(F.col("date"))).alias("year"), text("publication"), text("doi"), text("tags"), text("collections"), text("citation_key"), pdf_path(F.col("pdf.linkmode"), F.col("pdf.path"), F.col("pdf.attachment_key")).alias("pdf_path"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, key): the distinct words of each document."""
    return docs.where(F.length(text) > 0).select(F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("word"), key).where("word <> ''")


def boolean_search(words: DataFrame, key: str, query: str, operator: str = "AND") -> DataFrame:
    """Keys of documents that hold all words (AND) or any word (every other operator); no words find nothing.

    Only the postings of the asked words are read and grouped.
    """
    asked = sorted({w.lower() for w in query.split()})
    hits = words.where(F.col("word").isin(*asked) if asked else F.lit(False))
    if operator.upper() != "AND":
        return hits.select(key).distinct()
    return hits.groupBy(key).agg(F.count_distinct("word").alias("n")).where(F.col("n") == len(asked)).select(key)


def boolean_results(keys: DataFrame, library: DataFrame, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """Library rows of found keys, newest first; unknown years come last."""
    rows = library.join(keys, "item_key", "left_semi")
    if year_min:
        rows = rows.where(F.col("year") >= year_min)
    if year_max:
        rows = rows.where(F.col("year") <= year_max)
    return rows.orderBy(F.desc(F.coalesce("year", F.lit(0))), "item_key")


def diagnostics(items: DataFrame, attachments: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """(measure, n): items in all, with a PDF, with only other attachments by type, and without any."""
    base = base_items(items, deleted).select("itemid")
    held = attachments.select(F.coalesce("parentitemid", "itemid").alias("itemid"), "contenttype").join(base, "itemid", "left_semi")
    pdf = held.where("contenttype = 'application/pdf'").select("itemid").distinct()
    other = held.join(pdf, "itemid", "left_anti")
    total = base.agg(F.lit("total").alias("measure"), F.count("*").alias("n"))
    with_pdf = pdf.agg(F.lit("with_pdf").alias("measure"), F.count("*").alias("n"))
    by_type = other.groupBy(F.concat(F.lit("type:"), F.coalesce("contenttype", F.lit("unknown"))).alias("measure")).agg(F.count_distinct("itemid").alias("n"))
    none = base.join(held.select("itemid").distinct(), "itemid", "left_anti").agg(F.lit("no_attachment").alias("measure"), F.count("*").alias("n"))
    return total.unionByName(with_pdf).unionByName(by_type).unionByName(none)


def pdf_resolution(pdfs: DataFrame, files: DataFrame) -> DataFrame:
    """(item_key, title, path, reason) of each item with a PDF attachment: the first by attachment key; reason is null where its file is there.

    pdfs: item_key, title, attachment_key, linkmode, path; files: path of what the storage folder holds.
    """
    first = pdfs.groupBy("item_key").agg(F.min(F.struct("attachment_key", "linkmode", "path", "title")).alias("p")).select("item_key", "p.*")
    first = first.withColumn("place", pdf_path(F.col("linkmode"), F.col("path"), F.col("attachment_key")))
    there = files.select(F.col("path").alias("place"), F.lit(True).alias("_there")).distinct()
    reason = (
        F.when(F.col("linkmode") == 2, "linked file (not supported)").when(F.col("path").isNull(), "no path on record")
        .when(F.col("place").isNull(), F.concat(F.lit("unexpected form of path: "), F.substring("path", 1, 50))).when(F.col("_there").isNull(), "file missing from storage")
    )
    return first.join(there, "place", "left").select("item_key", F.coalesce("title", F.lit("[No Title]")).alias("title"), F.col("place").alias("path"), reason.alias("reason"))
