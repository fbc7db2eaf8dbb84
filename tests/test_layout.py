from pyspark.sql import functions as F

from quillstack.operators import layout


def test_contents(spark):
    toc = spark.createDataFrame([("d", 1, 1, "1 Methods", 2), ("d", 2, 2, "Fine detail", 2), ("d", 3, 1, "Odd", 3), ("d", 4, 2, "Below odd", 4), ("d", 5, 1, "Nowhere", 9)], "k string, entry int, level int, title string, page_num int")
    boxes = spark.createDataFrame([("d", 2, 0, "## **Methods**", 10), ("d", 3, 0, "Fine detail of it", 20), ("d", 3, 1, "Odd", 30), ("d", 4, 0, "Below odd", 40)], "k string, page_num int, box_index int, text string, char_offset int")
    got = layout.toc_sections(layout.toc_matches(toc, boxes, "k"), "k")
    assert {r["entry"]: r["label"] for r in got.collect()} == {1: "methods", 2: "methods", 3: "unknown", 4: "methods"}


def test_abstracts(spark):
    t1, t2 = "Title\n\n## Abstract\n\nText of it.\n\n# Intro\nx", "No heading here"
    pages = spark.createDataFrame([("a", 1, t1, 0), ("a", 2, t2, 100), ("b", 1, t2, 0), ("c", 1, None, 0)], "k string, page_num int, markdown string, char_start int")
    got = layout.abstract_spans(pages, "k").collect()
    assert len(got) == 1 and t1[got[0]["char_start"] : got[0]["char_end"]].strip() == "## Abstract\n\nText of it."
    blocks = spark.createDataFrame([("a", 1, 0, "x" * 120, "I", 9.0, 5), ("a", 1, 1, "y" * 120, "R", 10.0, 5), ("b", 1, 0, "x" * 120, "I", 9.0, 3)], "k string, page_num int, block int, text string, font string, size double, pages int")
    body = spark.createDataFrame([("a", "R", 10.0), ("b", "R", 10.0)], "k string, font string, size double")
    assert [tuple(r) for r in layout.styled_abstracts(blocks, body, "k").collect()] == [("a", 0)]


def test_pages_in(spark):
    pages = spark.createDataFrame([("a", 1, 0), ("a", 2, 50), ("a", 3, 99)], "k string, page_num int, char_start int")
    spans = spark.createDataFrame([("a", 0, 50, "results"), ("a", 50, 99, "references")], "k string, char_start int, char_end int, label string")
    assert [r["page_num"] for r in layout.pages_in(pages, spans, "k").collect()] == [2]


def test_heading_captions(spark):
    tables = spark.createDataFrame([("a", 0, 100.0, 10.0, None), ("a", 1, 300.0, 10.0, None), ("a", 2, 100.0, 10.0, "Table 1")], "k string, table_index int, y0 double, spacing double, caption string")
    lines = spark.createDataFrame([("a", 90.0, "Abbreviations", True), ("a", 70.0, "Further up", True), ("a", 95.0, "plain", False), ("a", 200.0, "too far", True)], "k string, y1 double, text string, styled boolean")
    assert {r["table_index"]: r["caption"] for r in layout.heading_captions(tables, lines, ["k"]).collect()} == {0: "Abbreviations", 1: None, 2: "Table 1"}


def test_gap_captions(spark):
    objects = spark.createDataFrame([("a", 1, 1, 1, "Table 1"), ("a", 2, 3, None, None), ("a", 3, 5, 3, "Table 3"), ("a", 4, 3, None, None)], "k string, object_id int, page_num int, number int, caption string")
    found = spark.createDataFrame([("a", 3, 2, "Table 2. x"), ("a", 9, 2, "Table 2. far")], "k string, page_num int, number int, caption string")
    got = {r["object_id"]: (r["number"], r["caption"]) for r in layout.gap_captions(objects, found, "k").collect()}
    assert got == {1: (1, "Table 1"), 2: (2, "Table 2. x"), 3: (3, "Table 3"), 4: (None, None)}


def test_completeness(spark):
    pages = spark.createDataFrame([("a", "x"), ("a", None)], "k string, markdown string")
    captions = spark.createDataFrame([("a", "table", "1"), ("a", "table", "1"), ("a", "table", "2")], "k string, kind string, number string")
    tables = spark.createDataFrame([("a", "Table 1")], "k string, caption string")
    figures = tables.limit(0)
    spans = spark.createDataFrame([("a", "results"), ("a", "unknown")], "k string, label string")
    r = layout.completeness_rows(pages, captions, tables, figures, spans, "k").first()
    assert (r["text_pages"], r["table_captions_found"], r["tables_missing"], r["sections_identified"], r["figures_found"]) == (1, 2, 1, 1, 0)
    from quillstack.operators.completeness import grade

    assert layout.completeness_rows(pages, captions, tables, figures, spans, "k").select(grade()).first()[0] == "B"


def test_batches_and_names(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([4, 4, 4, 20, 1])], "i int, n int").coalesce(1)
    assert [r["batch"] for r in layout.request_batches(df, "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    assert spark.range(1).select(layout.image_name(F.lit("D"), F.lit(3), F.lit(1))).first()[0] == "D_fig_p003_01.png"
    o = spark.createDataFrame([("a", "Table 1. x"), ("b", "Uncaptioned table")], "k string, caption string")
    c = spark.createDataFrame([("a", "ctx"), ("b", "ctx")], "k string, passage string")
    assert {r["k"]: r["reference_context"] for r in layout.with_reference_context(o, c, ["k"]).collect()} == {"a": "ctx", "b": None}
