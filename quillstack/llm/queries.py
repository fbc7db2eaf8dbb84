"""Queries of the training-data operators for language models, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import bpe, canonical, mixing, neighbours, pieces, scans, subjects
from quillstack.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found_titles(table(spark, d, "library_items"), table(spark, d, "scimago_quartiles"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_publications(table(spark, d, "library_items"), table(spark, d, "scimago_quartiles"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found_noise(table(spark, d, "page_extractions"))


def p3_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_pages(table(spark, d, "page_extractions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.found_cuts(table(spark, d, "document_extractions"), table(spark, d, "chunk_config"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_texts(table(spark, d, "document_extractions"), table(spark, d, "chunk_config"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document decoded again."""
    return bpe.decode_texts(p8_ids(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_corpus(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing.used_shares(mixing.mix(documents, targets), documents, targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_shares(spark, d).select("doc_id", "subject")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_examples"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_text": p3_text, "p5_found": p5_found, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_ids": p8_ids, "p8_texts": p8_texts, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_shares": p10_shares}

SQL = {
    "p7_found": r"""
        SELECT DISTINCT item_key,
            CASE WHEN list_max(list_transform(string_split_regex(full_markdown, '[ \t\n\r]'), lambda x: length(x))) > 4 * chunk_size THEN 'forced' ELSE 'natural' END AS cut
        FROM document_extractions JOIN chunk_config USING (config_id)
        WHERE length(full_markdown) > 4 * chunk_size
    """,
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    # the cuts one after another, each the furthest of the strongest kind of boundary within reach
    "p7_pieces": r"""
        WITH RECURSIVE docs AS (
            SELECT DISTINCT item_key, full_markdown AS t, 4 * chunk_size AS lim, least(4 * coalesce(chunk_overlap, 0), 4 * chunk_size - 1) AS lap
            FROM document_extractions JOIN chunk_config USING (config_id) WHERE length(full_markdown) > 4 * chunk_size),
        cuts AS (
            SELECT item_key, t, lim, lap, 0 AS piece_no, 0 AS c0, 0 AS c1 FROM docs
            UNION ALL
            SELECT item_key, t, lim, lap, piece_no + 1, c1, c1 + CASE
                WHEN length(t) - c1 <= lim - lap THEN length(t) - c1
                WHEN para >= half THEN para WHEN sent >= half THEN sent WHEN line >= half THEN line WHEN blank >= 1 THEN blank
                WHEN stretch <= lim THEN stretch ELSE lim - lap END
            FROM (SELECT *, greatest(1, (lim - lap) // 2) AS half,
                    length(regexp_extract(w, '(?s)^.*\n[ \t]{0,3}\r?\n')) AS para, length(regexp_extract(w, '(?s)^.*[.!?。][\])"''’”]{0,2}[ \t\n\r]')) AS sent,
                    length(regexp_extract(w, '(?s)^.*\n')) AS line, length(regexp_extract(w, '(?s)^.*[ \t\n\r]')) AS blank,
                    length(regexp_extract(v, '^[^ \t\n\r]+')) AS stretch
                  FROM (SELECT *, t[c1 + 1 : c1 + lim - lap] AS w, t[c1 + 1 : c1 + lim + 1] AS v FROM cuts WHERE c1 < length(t)))),
        laps AS (SELECT *, least(lap, lim - (c1 - c0), c0) AS l FROM cuts WHERE piece_no > 0)
        SELECT item_key, piece_no, c0 - l AS char_start, c1 AS char_end,
            CASE WHEN regexp_matches(t[c1 : c1], '[^ \t\n\r]') AND regexp_matches(t[c1 + 1 : c1 + 1], '[^ \t\n\r]') THEN 'forced' ELSE 'natural' END AS cut,
            t[c0 - l + 1 : c1] AS piece
        FROM laps
    """.replace("\\\\", "\\"),
}
