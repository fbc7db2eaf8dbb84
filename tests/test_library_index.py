import pytest
from pyspark.sql import functions as F

from quillstack.api import Engine
from quillstack.config import Settings
from quillstack.operators import indexing, layout
from quillstack.operators.library_index import LibraryIndexer

LIBRARY = "item_key string, title string, hash string, pdf_path string, publication string, year int, doi string"
PAGES = "page_id long, item_key string, page_num int, markdown string, images_on_page int, status string, reason string"
TABLE = "Table 1. Numbers of cases\n\n| kind | n |\n|---|---|\n| a | 1 |\n| b | 2 |"
BOX = "| a r t i c l e | i n f o |\n|---|---|\n| history | received |"


def paper(n, text):
    return f"# Introduction\n\nThis is paper {n}. As Table 1 shows, cases differ. {text}\n\n# Results\n\n{TABLE}\n\n{BOX}\n\nFigure 1. A curve\n\nThe end of paper {n}."


def tables(spark, hashes=None):
    library = [("A", "Alpha", "h1", "a.pdf", "J. Sci.", 2001, "10.1/a"), ("B", "Beta", "h2", "b.pdf", None, None, None), ("C", "Gamma", "h3", "c.pdf", "x", 2003, None), ("D", "Delta", "h4", "d.pdf", "x", 2004, None), ("E", "Eps", "h5", None, "x", 2004, None), (None, "no key", "h", "n.pdf", None, None, None)]
    library = [(k, t, (hashes or {}).get(k, h), *rest) for k, t, h, *rest in library]
    pages = [(1, "A", 1, paper("A", "one"), 1, "ok", None), (1, "A", 1, paper("A", "one"), 1, "ok", None), (2, "A", 2, "More text on page two.", 0, "ok", None), (3, "B", 1, "", 0, "ok", None), (4, "B", 2, None, 0, "ok", None), (None, "C", None, None, None, "failed", "ValueError: broken | file"), (5, "D", 1, paper("D", "x" * 3000), 0, "ok", None)]
    return spark.createDataFrame(library, LIBRARY), spark.createDataFrame(pages, PAGES)


def outcome(report):
    return {r["item_key"]: (r["status"], r["reason"]) for r in report.results.collect()}


def test_runs(spark, tmp_path):
    settings = Settings(embedding_dimensions=8)
    library, pages = tables(spark)
    first = Engine.index_library(str(tmp_path), library, pages, settings)
    assert outcome(first) == {"A": ("indexed", None), "B": ("empty", "2 pages but no text"), "C": ("failed", "ValueError: broken | file"), "D": ("indexed", None)}
    assert first.counts == {"indexed": 2, "failed": 1, "empty": 1, "skipped": 0, "already_indexed": 0} and not first.settings_changed
    assert sum(first.grades.values()) == 3 and first.pages["total_pages"] == 5 and first.pages["empty_pages"] == 2
    text = first.markdown()
    assert "| failed | 1 |" in text and "broken \\| file" in text and "| A | Alpha |" in text
    engine = Engine.open(spark, str(tmp_path), settings)
    rows = engine.index
    found = {r["chunk_type"]: r["n"] for r in rows.groupBy("chunk_type").agg(F.count("*").alias("n")).collect()}
    assert found["table"] == 2 and found["figure"] == 1  # the box over the abstract is no table
    about = rows.where("chunk_type = 'table' and doc_id = 'A'").first()
    assert "As Table 1 shows" in about["reference_context"] and about["pdf_hash"] == "h1" and len(about["embedding"]) == 8
    assert rows.where("chunk_type = 'figure'").first()["caption"].startswith("Figure 1")
    whole = engine.get_index_stats().first()
    assert whole["total_documents"] == 2 and whole["chunk_types"]["table"] == 2 and whole["journal_coverage"] == {"unknown": 2} and sum(whole["section_coverage"].values()) == whole["total_chunks"]
    near = engine.get_passage_context("A", table_page=1, table_index=0).first()
    assert near["reference_found_in_chunk"] == 0 and near["note"] is None and "As Table 1 shows" in near["merged_text"] and [p["is_center"] for p in near["passages"]][0]
    with pytest.raises(ValueError):
        engine.get_passage_context("A", table_page=9, table_index=0)
    # nothing to do: the failed one is tried again, the empty one is known
    again = Engine.index_library(str(tmp_path), library, pages, settings)
    assert outcome(again) == {"B": ("skipped", "no text (unchanged file)"), "C": ("failed", "ValueError: broken | file")} and again.counts["already_indexed"] == 2
    # files change: the empty one is read again, an indexed one without text now leaves the index
    changed, _ = tables(spark, {"A": "h1b", "B": "h2b"})
    now = pages.where("item_key <> 'A'").unionByName(spark.createDataFrame([(9, "A", 1, " ", 0, "ok", None)], PAGES))
    third = Engine.index_library(str(tmp_path), changed, now, Settings(embedding_dimensions=8, chunk_size=200))
    assert outcome(third)["A"] == ("empty", "1 pages but no passages") and outcome(third)["B"][0] == "empty" and third.settings_changed
    assert {r["doc_id"] for r in Engine.open(spark, str(tmp_path)).index.select("doc_id").distinct().collect()} == {"D"}
    forced = Engine.index_library(str(tmp_path), library, pages, settings, force_reindex=True, title_pattern="^(alpha|beta)", limit=1)
    assert outcome(forced) == {"A": ("indexed", None)} and not forced.settings_changed
    assert {r["doc_id"] for r in Engine.open(spark, str(tmp_path)).index.select("doc_id").distinct().collect()} == {"A", "D"}


def test_filters_and_bad_settings(spark, tmp_path):
    library, pages = tables(spark)
    assert outcome(Engine.index_library(str(tmp_path), library, pages, item_key="D")) == {"D": ("indexed", None)}
    assert outcome(Engine.index_library(str(tmp_path), library, pages, item_key="nobody")) == {}
    with pytest.raises(ValueError):
        LibraryIndexer(spark, str(tmp_path), Settings(chunk_size=0)).run(library, pages)
    with pytest.raises(ValueError):
        Engine.open(spark, str(tmp_path / "none"))


def test_embedding_in_batches_with_retries():
    asked = []

    class Shaky:
        dimensions = 1

        def embed(self, texts, query=False):
            asked.append(len(texts))
            if len(asked) == 1:
                raise OSError("try again")
            return [[1.0]] * len(texts)

    assert len(indexing.embed_all(Shaky(), ["t"] * 250, wait=0.0)) == 250 and asked == [100, 100, 100, 50]

    class Dead:
        dimensions = 1

        def embed(self, texts, query=False):
            raise OSError("gone")

    with pytest.raises(indexing.EmbeddingError, match="gone"):
        indexing.embed_all(Dead(), ["t"], wait=0.0)


def test_sections_of_layouts(spark):
    docs = spark.createDataFrame([("a", 1000), ("b", 500), ("c", 10)], "k string, total int")
    toc = spark.createDataFrame([("a", 1, 1, "Methods", 1), ("a", 2, 3, "Results of it", 2), ("a", 3, 3, "Some detail", 2), ("a", 4, 2, "Cohort", 1), ("a", 5, 4, "Results deep", 2)], "k string, entry int, level int, title string, page_num int")
    boxes = spark.createDataFrame([("a", 1, 0, "## Methods", 100), ("a", 1, 1, "### Cohort", 200), ("a", 2, 0, "#### Results of it", 600), ("a", 2, 1, "Some detail", 700), ("b", 1, 0, "R17", 0), ("b", 1, 1, "**Discussion**", 50), ("b", 2, 0, "Ethics", 300)], "k string, page_num int, box_index int, text string, char_offset int")
    got = [(r["k"], r["char_start"], r["char_end"], r["label"]) for r in layout.document_sections(docs, toc, boxes, "k").orderBy("k", "char_start").collect()]
    assert got == [("a", 0, 100, "preamble"), ("a", 100, 200, "methods"), ("a", 200, 600, "methods"), ("a", 600, 1000, "results"), ("b", 0, 50, "preamble"), ("b", 50, 300, "discussion"), ("b", 300, 500, "unknown"), ("c", 0, 10, "unknown")]
