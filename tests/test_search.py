import pytest
from pyspark.sql import functions as F

from quillstack.api import Engine
from quillstack.config import Settings, check_search, load
from quillstack.operators import chunking, citations, journals, library, reference, search
from quillstack.operators.indexing import HashedWords

ROW = "chunk_id string, doc_id string, chunk_index int, chunk_type string, passage string, embedding array<float>, year int, authors string, tags string, collections string, section string, section_confidence double, journal_quartile string, page_num int, doc_title string, citation_key string, publication string, doi string, table_index int, table_caption string"


def row(i, doc="D", kind="text", vec=(1.0, 0.0), year=2000, section="results", quartile="Q1", authors="Ann Lee", text=None, caption=None, table_index=None, doi="10.1/a"):
    return (f"{doc}_{kind}_{i}", doc, i, kind, text or f"text {i}", list(vec), year, authors, "heart; rate", "Lab", section, 1.0, quartile, 1, "T", "k", "P", doi, table_index, caption)


@pytest.fixture(scope="module")
def index(spark):
    rows = [row(0, section="introduction"), row(1, vec=(0.9, 0.1)), row(2, vec=(0.0, 1.0)), row(3, vec=(-1.0, 0.0)), row(0, "E", vec=(0.8, 0.2), year=None, quartile=None, section="abstract"), row(0, "F", vec=(0.0, 0.0)), row(1, "F", vec=(0.7, 0.7), year=1990, authors="Bo"), row(2, "D", kind="table", vec=(1.0, 0.0), text="| a |", caption="Table 3. x", table_index=0)]
    rows += [row(5, "G", vec=(0.5, 0.5), text="see Table 3 here", quartile="Q4"), row(6, "G", vec=(0.5, 0.6))]
    return spark.createDataFrame(rows, ROW).cache()


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_composite(spark, index):
    got = spark.createDataFrame([(0.8, "results", "Q1"), (0.8, "references", None), (-0.5, "results", "Q1"), (0.8, None, "Q2"), (0.8, "figure", "Q1")], "s double, c string, q string").select(search.composite(F.col("s"), F.col("c"), F.col("q"))).collect()
    want = [0.8**0.7, 0.8**0.7 * 0.1 * 0.7, 0.0, 0.8**0.7 * 0.85 * 0.85, 0.8**0.7 * 0.7]
    assert all(abs(g[0] - w) < 1e-12 for g, w in zip(got, want))
    assert spark.range(1).select(search.composite(F.lit(1.0), F.lit("results"), F.lit("Q1"), section_weights={"results": 7})).first()[0] == 1.0


def test_search(index):
    top = search.cosine_top_k(index, [1.0, 0.0], 3)
    assert ids(top) == ["D_table_2", "D_text_0", "D_text_1"]
    got = search.search_passages(index, [1.0, 0.0], 2, chunk_types=["text"])
    assert ids(got)[0] == "D_text_1"
    r = got.where("chunk_id = 'D_text_1'").first()
    assert r["context_before"] == ["text 0"] and "text 0\n\ntext 1" in r["full_context"]
    assert ids(search.search_passages(index, [1.0, 0.0], required_terms=["nowhere"])) == []
    assert ids(search.search_passages(index.limit(0), [1.0, 0.0])) == []


def test_filters(index):
    assert "E_text_0" in ids(search.native_filter(index, year_max=1995)) and "E_text_0" not in ids(search.native_filter(index, year_min=1995))
    assert search.native_filter(index, 0, 0).count() == index.count()
    assert set(ids(search.text_filter(index, author="BO"))) == {"F_text_1"}


def test_topic_and_objects(index):
    got = search.search_topic(index, [1.0, 0.0]).collect()
    assert {r["doc_id"] for r in got} == {"D", "E", "F", "G"}
    best = next(r for r in got if r["doc_id"] == "D")
    assert best["best_chunk_score"] == 1.0
    assert ids(search.search_objects(index, [1.0, 0.0], "table")) == ["D_table_2"]
    assert ids(search.search_objects(index, [1.0, 0.0], "figure")) == []


def test_engine(spark, index):
    words = library.postings(spark.createDataFrame([("D", "Heart rate rate"), ("E", "heart ecg"), ("X", None)], "item_key string, t string"), "item_key", "t")
    lib = spark.createDataFrame([("D", 2001), ("E", None)], "item_key string, year int")
    works = spark.createDataFrame([(1, "t", ["a", "b", "c", "d"], 2000, "10.1/A", 5), (2, "u", ["x"], 2001, "10.1/b", 7)], "work_id long, title string, authors array<string>, year int, doi string, cited_by_count long")
    cites = spark.createDataFrame([(1, 2, 0), (1, 2, 1), (2, 1, 0)], "src long, dst long, position int")
    e = Engine(index, embedder=HashedWords(2), words=words, library=lib, works=works, cites=cites)
    assert e.search_papers("heart rate", 3).count() <= 3
    near = e.get_passage_context("D", 1, 1).first()
    assert [p["chunk_id"] for p in near["passages"]] == ["D_text_0", "D_text_1", "D_table_2", "D_text_2"] and [p["is_center"] for p in near["passages"]] == [False, True, False, False]
    assert near["merged_text"] == "\n\n".join(p["text"] for p in near["passages"])
    assert [r["item_key"] for r in e.search_boolean("heart").collect()] == ["D", "E"]
    assert [r["item_key"] for r in e.search_boolean("Heart RATE").collect()] == ["D"] and e.search_boolean("heart nothing").count() == 0
    assert {r["item_key"] for r in e.search_boolean("rate ecg", "or").collect()} == {"D", "E"} and e.search_boolean("").count() == 0
    assert e.find_references("D").first()["work_id"] == 2 and e.find_citing_papers("D").first()["authors"] == "x"
    count = e.get_citation_count("D").first()
    assert (count["doc_id"], count["work_id"], count["cited_by_count"], count["reference_count"]) == ("D", 1, 1, 1)
    assert e.get_reranking_config()["alpha"] == 0.7 and e.get_index_stats().first()["total_documents"] == 4
    with pytest.raises(ValueError):
        e.find_references("nobody")
    with pytest.raises(ValueError):
        e.search_papers("x", chunk_types=["video"])


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"chunk_size": 200, "other": 1}')
    assert load(str(p)).chunk_size == 200 and load(None) == Settings() and len(Settings().fingerprint()) == 16
    p.write_text('{"chunk_overlap": 900}')
    with pytest.raises(ValueError):
        load(str(p))
    with pytest.raises(ValueError):
        check_search(section_weights={"results": "high"})


def plain_chunks(text, size, lap):
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            low = start + int(size * 0.8)
            for mark in chunking.SENTENCE_ENDS:
                at = text.rfind(mark, low, end)
                if at >= 0:
                    end = at + len(mark)
                    break
        out.append((start, end))
        start = end - lap if end - lap > start else end
    return out


def test_chunks_against_a_loop(spark):
    texts = ["", "short", "A sentence. " * 60, "x" * 500, "One? Two! Three.\n" * 40, "ab " * 33 + "end. " * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {}
    for r in df.select("k", chunking.chunk_bounds(F.col("t"), 100, 20).alias("b")).collect():
        got[r["k"]] = [(x["s"], x["e"]) for x in r["b"] or []]
    assert got == {i: plain_chunks(t, 100, 20) for i, t in enumerate(texts)}
    rows = chunking.chunks(df, "k", "t", 25, 5).where("k = 5").orderBy("chunk_index").collect()
    assert [(r["char_start"], r["char_end"]) for r in rows] == got[5] and rows[0]["passage"] == texts[5][:100].strip()


def test_spans(spark):
    t = "Title\n# 1. Introduction\nabc\n## Sub\nx\n# Results\ny"
    df = spark.createDataFrame([("a", t), ("b", "plain"), ("c", None)], "k string, t string")
    rows = chunking.section_spans(df, "k", "t").orderBy("k", "span_index").collect()
    a = [r for r in rows if r["k"] == "a"]
    assert [r["label"] for r in a] == ["preamble", "introduction", "introduction", "results"]
    assert a[0]["char_start"] == 0 and a[-1]["char_end"] == len(t) and all(x["char_end"] == y["char_start"] for x, y in zip(a, a[1:]))
    assert [r["label"] for r in rows if r["k"] == "b"] == ["unknown"]
    cut = spark.range(1).select(chunking.insert_abstract(F.array(F.struct(F.lit(0).alias("char_start"), F.lit(10).alias("char_end"), F.lit("preamble").alias("label"))), F.lit(3), F.lit(6))).first()[0]
    assert [(s["char_start"], s["char_end"], s["label"]) for s in cut] == [(0, 3, "preamble"), (3, 6, "abstract"), (6, 10, "preamble")]


def test_references(spark):
    df = spark.createDataFrame([("a", "See Table 2 and Fig. 1. Table 2 again, table 10.")], "k string, t string")
    got = {(r["kind"], r["number"]): r["char_offset"] for r in reference.first_references(df, "k", "t").collect()}
    assert got == {("table", 2): 4, ("figure", 1): 16, ("table", 10): 39}
    passages = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 10, 1), ("a", 2, 30, 2)], "k string, chunk_index int, char_start int, page_num int")
    objects = spark.createDataFrame([("a", "table", 2, 1), ("a", "table", 9, 2), ("a", "table", 8, 7)], "k string, kind string, number int, page_num int")
    got = {r["number"]: r["chunk_index"] for r in reference.anchors(objects, reference.first_references(df, "k", "t"), passages, "k").collect()}
    assert got == {2: 0, 9: 2, 8: -1}


def test_journals(spark):
    titles = spark.createDataFrame([("ieee transactions on biomedical engineering", "Q1"), ("journal of physics", "Q2"), ("journal of physics", "Q1"), ("nature", None)], "title string, quartile string")
    over = spark.createDataFrame([("Odd Journal", "Q4")], "title string, quartile string")
    pubs = spark.createDataFrame([("IEEE Trans. on Biomed. Eng.",), ("Journal of Physics",), ("Journal of Physicss",), ("odd journal",), ("Nothing",), ("",), (None,)], "publication string")
    got = {r["publication"]: (r["quartile"], r["tier"]) for r in journals.quartiles(pubs, titles, over).collect()}
    assert got == {"IEEE Trans. on Biomed. Eng.": ("Q1", 2), "Journal of Physics": ("Q1", 1), "Journal of Physicss": ("Q1", 3), "odd journal": ("Q4", 0), "Nothing": (None, None)}


def test_citations_empty(spark):
    empty = spark.createDataFrame([], "src long, dst long, position int")
    assert citations.citation_counts(empty).count() == 0
