"""Queries of the core training-data operators, over their whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillstack.operators import incremental, packed, wide
from quillstack.runtime import shared_dir, table


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.wide_table(table(spark, d, "item_data"), table(spark, d, "item_fields"), table(spark, d, "item_data_values"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.unfilled_cells(p2_wide(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack_library(table(spark, d, "library_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One run over a new store in the shared folder; its committed keys."""
    store = f"{shared_dir(spark).rstrip('/')}/quillstack-runs-{uuid.uuid4().hex}"
    runs = incremental.KeyRuns(spark, store)
    return runs.run(table(spark, d, "zotero_items"), table(spark, d, "index_log"), table(spark, d, "index_runs")).select("item_key")


QUERIES = {"p2_found": p2_found, "p2_wide": p2_wide, "p4_found": p4_found, "p6_found": p6_found}

_AROUND = "volume|vol|v|band|bd|no|nr|num|number|issue|heft|edition|ed|pages|page|pp|p|s|ca|circa|c|series|part"

SQL = {
    "p2_found": rf"""
        WITH f AS (SELECT fieldid, lower(trim(fieldname)) AS fieldname, valuetype FROM item_fields WHERE trim(fieldname) <> ''),
        v AS (SELECT valueid, value, trim(translate(value, '０１２３４５６７８９', '0123456789')) AS t FROM item_data_values WHERE value IS NOT NULL AND regexp_replace(value, '[\s\x{{a0}}]', '', 'g') <> ''),
        n AS (SELECT *, regexp_extract(regexp_replace(t, '^(\d),(\d\d\d)$', '\1\2'), '(?i)^(?:(?:(?:{_AROUND})\b\.?|[#(])\s*)*(\d+)(?:\.0+)?(?:st|nd|rd|th)?[.)]?\s*(?:(?:{_AROUND})\b\.?\s*)*$', 1) AS d1,
                 regexp_extract(t, '(?i)^v\.?(\d+)$', 1) AS d2, regexp_extract(t, '^(M*(?:CM|CD|D?C*)(?:XC|XL|L?X*)(?:IX|IV|V?I*))$', 1) AS roman,
                 list_distinct(list_transform(list_filter(string_split_regex(t, '\D+'), lambda x: length(x) = 4 OR (length(x) = 8 AND try_cast(x[5:6] AS INT) <= 12 AND try_cast(x[7:8] AS INT) <= 31)), lambda x: try_cast(x[1:4] AS INT))) AS ys FROM v),
        r AS (SELECT valueid, value, CASE WHEN d1 <> '' THEN d1::BIGINT WHEN d2 <> '' THEN d2::BIGINT
                 WHEN roman <> '' THEN list_sum(list_transform(range(1, length(roman) + 1), lambda i: (CASE roman[i] WHEN 'M' THEN 1000 WHEN 'D' THEN 500 WHEN 'C' THEN 100 WHEN 'L' THEN 50 WHEN 'X' THEN 10 WHEN 'V' THEN 5 ELSE 1 END)
                    * (CASE WHEN i < length(roman) AND instr('IVXLCDM', roman[i]) < instr('IVXLCDM', roman[i + 1]) THEN -1 ELSE 1 END)))::BIGINT END AS num,
                 list_filter(ys, lambda y: y BETWEEN 1500 AND 2100) AS ys, lower(regexp_replace(value, '[\s\x{{a0}}]', '', 'g')) AS txt FROM n),
        c AS (SELECT itemid, fieldname, CASE valuetype WHEN 'integer' THEN num::VARCHAR WHEN 'date' THEN CASE WHEN len(ys) = 1 THEN ys[1]::VARCHAR END ELSE txt END AS reading FROM item_data JOIN f USING (fieldid) JOIN r USING (valueid) WHERE itemid IS NOT NULL)
        SELECT itemid, fieldname FROM c GROUP BY ALL HAVING count(DISTINCT reading) <> 1
    """.replace("\\\\", "\\"),
    "p6_found": """
        WITH k AS (SELECT "key" AS item_key, max(CASE WHEN datemodified LIKE '____-__-__ __:__:__' THEN try_cast(datemodified || '+00' AS TIMESTAMPTZ) ELSE try_cast(datemodified AS TIMESTAMPTZ) END) AS modified
                   FROM zotero_items WHERE "key" IS NOT NULL AND coalesce(itemtypeid, 0) NOT IN (1, 14) GROUP BY 1),
        s AS (SELECT item_key, max(CASE WHEN datemodified_seen LIKE '____-__-__ __:__:__' THEN try_cast(datemodified_seen || '+00' AS TIMESTAMPTZ) ELSE try_cast(datemodified_seen AS TIMESTAMPTZ) END) AS seen, 1 AS known
              FROM index_log WHERE outcome IN ('indexed', 'empty') AND run_id IN (SELECT run_id FROM index_runs WHERE status = 'succeeded') GROUP BY 1)
        SELECT k.item_key FROM k LEFT JOIN s USING (item_key)
        WHERE known IS NULL OR (modified IS NOT NULL AND (seen IS NULL OR modified > seen))
    """,
}
