from pyspark.sql import functions as F

from quillstack.operators import captions, completeness, geometry, indexing, stats, tables, vision


def test_markdown_round(spark):
    page = "Intro\n**Table 2. Caption**\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n\ntext\n| x |\n"
    df = spark.createDataFrame([("d", 1, page), ("d", 2, None), ("d", 3, "")], "k string, p int, markdown string")
    r = tables.markdown_tables(df, ["k", "p"]).collect()
    assert len(r) == 1 and r[0]["headers"] == ["a", "b"] and r[0]["rows"] == [["1", "2"], ["3"]] and r[0]["caption"] == "Table 2. Caption"
    md = tables.markdown_tables(df, ["k", "p"]).select(tables.to_markdown(F.col("headers"), F.col("rows"), F.col("caption"), F.lit("note"))).first()[0]
    assert md == "**Table 2. Caption**\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |\n\n*note*"


def test_artifacts(spark):
    rows = [(["a r t i c l e i n f o"], [["x"]], None), (["x"], [["1 Introduction 904"], ["2 Methods 907"], ["3 Results 910"]], None), (["No", "T", "P"], [["1", "Intro", "3"], ["2", "End", "9"]], None), (["a"], [["Figure 1. Block diagram"]], None), (["a", "b"], [["1", "2"]], "Table 1. ok"), ([], [], None)]
    got = [r[0] for r in spark.createDataFrame(rows, "h array<string>, r array<array<string>>, c string").select(tables.artifact(F.col("h"), F.col("r"), F.col("c"))).collect()]
    assert got == ["article_info_box", "table_of_contents", "table_of_contents", "diagram_as_table", None, None]


def test_continuations(spark):
    df = spark.createDataFrame([("d", 1, 0, ["a"], "Table 1"), ("d", 2, 0, ["a"], None), ("d", 4, 0, ["a"], None), ("d", 9, 0, ["a"], None), ("d", 2, 1, ["b"], None)], "k string, page_num int, table_index int, headers array<string>, caption string")
    got = {(r["page_num"], r["table_index"]): r["caption"] for r in tables.continue_captions(df, "k").collect()}
    assert got == {(1, 0): "Table 1", (2, 0): "Table 1 (continued)", (4, 0): "Table 1 (continued) (continued)", (9, 0): None, (2, 1): None}


def test_overlap(spark):
    t = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0, None), ("d", 1, 0.0, 0.0, 10.0, 10.0, "Table 1. x"), ("d", 2, 0.0, 0.0, 10.0, 10.0, "")], "k string, p int, x0 double, y0 double, x1 double, y1 double, caption string")
    f = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 6.0), ("d", 2, 9.0, 9.0, 20.0, 20.0)], "k string, p int, x0 double, y0 double, x1 double, y1 double")
    assert [r["p"] for r in tables.figure_data_tables(t, f, ["k", "p"]).collect()] == [1]


def test_captions(spark):
    df = spark.createDataFrame([("a", "**Table 1.** x\nFigure 2 shows\nFig. S3: y\nSupplementary Figure 4. z\nTable IV\nsee Table 5. no")], "k string, markdown string")
    got = [(r["line_no"], r["kind"], r["number"]) for r in captions.captions(df, ["k"]).orderBy("line_no").collect()]
    assert got == [(1, "table", "1"), (3, "figure", "S3"), (4, "figure", "4"), (5, "table", "IV")]


def test_assignment(spark):
    boxes = [(0, 0, 10, 10), (0, 20, 10, 30)]
    assert captions.match_boxes(boxes, [(31, "Figure 2. b", None), (11, "Figure 1. a", None)]) == ["Figure 1. a", "Figure 2. b"]
    beside = [(0, 0, 10, 10), (20, 0, 30, 10)]
    assert captions.match_boxes(beside, [(11, "Figure 1. a", (20, 11, 30, 12)), (11, "Figure 2. b", (0, 11, 10, 12))]) == ["Figure 2. b", "Figure 1. a"]
    assert captions.match_boxes(beside, []) == [None, None] and captions.match_boxes([], []) == []
    o = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 10.0, 10.0)], "k string, p int, object_id int, x0 double, y0 double, x1 double, y1 double")
    c = spark.createDataFrame([("d", 1, 11.0, "Figure 1. a", None, None, None, None)], "k string, p int, y double, caption string, x0 double, y0 double, x1 double, y1 double")
    assert captions.assign_captions(o, c, ["k", "p"]).first()["caption"] == "Figure 1. a"
    regions = spark.createDataFrame([("d", 1, 50.0, 100.0), ("d", 2, 90.0, 100.0)], "k string, region_id int, y0 double, page_height double")
    found = spark.createDataFrame([("d", 300.0, 1000.0, "low"), ("d", 100.0, 1000.0, "high")], "k string, y double, page_height double, caption string")
    assert {r["region_id"]: r["caption"] for r in captions.captions_above(regions, found, ["k"]).collect()} == {1: "low", 2: "high"}
    orphans = spark.createDataFrame([("d", 1, 1, 10.0), ("d", 1, 2, 20.0)], "k string, page_num int, object_id int, y double")
    floating = spark.createDataFrame([("d", 1, "near two", 19.0)], "k string, page_num int, caption string, y double")
    assert {r["object_id"]: r["caption"] for r in captions.recover_orphans(orphans, floating, "k").collect()} == {1: None, 2: "near two"}


def test_geometry(spark):
    one = spark.range(1)
    s = one.select(geometry.strips(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(25.0)).alias("s")).first()["s"]
    assert [(round(x["y0"], 2), round(x["y1"], 2)) for x in s] == [(0, 10), (8.5, 18.5), (17, 25)]
    assert one.select(geometry.render_dpi(F.lit(0.0), F.lit(0.0), F.lit(720.0), F.lit(72.0))).first()[0] == 156
    r = one.select(geometry.recrop(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(200.0), F.array(F.lit(-5.0), F.lit(10.0), F.lit(50.0), F.lit(300.0))).alias("r")).first()["r"]
    assert tuple(r) == (0.0, 20.0, 50.0, 200.0)


def box_rows(spark, rows, schema="k string, x0 double, y0 double, x1 double, y1 double"):
    return spark.createDataFrame(rows, schema)


CAPTIONS = "k string, y double, x0 double, x1 double"


def figures(spark, objects, found, schema="k string, x0 double, y0 double, x1 double, y1 double"):
    done = geometry.figure_boxes(box_rows(spark, objects, schema), spark.createDataFrame(found, CAPTIONS), ["k"])
    return [tuple(r)[2:] for r in sorted(done.collect())]


def test_boxes_merge(spark):
    near = [("d", 0.0, 0.0, 10.0, 10.0), ("d", 0.0, 30.0, 10.0, 40.0)]
    assert figures(spark, near, []) == [(0, 0, 10, 40)]
    assert figures(spark, [*near, ("d", 200.0, 0.0, 210.0, 10.0)], []) == [(0, 0, 10, 10), (200, 0, 210, 10), (0, 30, 10, 40)]  # the one beside comes between them
    assert figures(spark, [("d", 0.0, 0.0, 100.0, 50.0), ("d", 90.0, 20.0, 190.0, 70.0)], []) == [(0, 0, 100, 50), (90, 20, 190, 70)]
    assert figures(spark, [("d", 0.0, 0.0, 10.0, 10.0), ("d", 0.0, 60.0, 10.0, 70.0)], []) == [(0, 0, 10, 10), (0, 60, 10, 70)]
    assert figures(spark, [("d", None, 0.0, 10.0, 10.0), ("d", 5.0, 5.0, 5.0, 9.0)], []) == [] and figures(spark, [], [("d", 1.0, None, None)]) == []


def test_boxes_fit_captions(spark):
    tall = [("d", 0.0, 0.0, 100.0, 400.0)]
    assert figures(spark, tall, [("d", 200.0, None, None)]) == [(0, 0, 100, 400)]
    assert figures(spark, tall, [("d", 200.0, None, None), ("d", 390.0, None, None)]) == [(0, 0, 100, 200), (0, 240, 100, 390)]
    assert figures(spark, tall, [("d", 200.0, 95.0, 300.0), ("d", 390.0, None, None)]) == [(0, 0, 100, 390)]
    page = [("d", 0.0, 0.0, 100.0, 1000.0)]
    far = [("d", y, None, None) for y in (150.0, 1500.0, 1515.0, 1700.0)]
    assert figures(spark, page, far[:2]) == [(0, 0, 100, 150), (0, 190, 100, 1000)]
    assert figures(spark, page, [far[0], far[1], far[3]]) == [(0, 0, 100, 150), (0, 190, 100, 1000), (0, 1300, 100, 1490), (0, 1500, 100, 1690)]
    assert figures(spark, [("d", 0.0, 0.0, 100.0, 1500.0)], [("d", y, None, None) for y in (2000.0, 2015.0, 2100.0)])[1:] == [(0, 1800, 100, 1990), (0, 1900, 100, 2090)]


def test_box_sources(spark):
    schema = "k string, source string, x0 double, y0 double, x1 double, y1 double, page_x1 double, page_y1 double"
    rows = [("a", "table", 0.0, 0.0, 50.0, 50.0), ("a", "image", 0.0, 0.0, 60.0, 50.0), ("b", "image", 0.0, 0.0, 100.0, 100.0), ("b", "image", -20.0, 0.0, 60.0, 50.0), ("c", "drawing", 0.0, 0.0, 50.0, 50.0), ("d", "picture", 0.0, 0.0, 1.0, 1.0), ("d", "drawing", 0.0, 0.0, 40.0, 40.0)]
    done = geometry.figure_boxes(box_rows(spark, [(*r, 100.0, 100.0) for r in rows], schema), spark.createDataFrame([("b", 80.0, None, None), ("d", 80.0, None, None)], CAPTIONS), ["k"])
    assert sorted((r["k"], r["x0"], r["x1"]) for r in done.collect()) == [("a", 0, 50), ("b", 0, 60), ("d", 0, 40)]


class Scripted:
    """Answers by scope."""

    def answer(self, requests):
        good = '{"headers": ["a"], "rows": [["1"]], "caption": "c"}'
        first = '```json\n{"headers": ["a"], "rows": [], "is_incomplete": true, "recrop": {"needed": true, "bbox_pct": [0, 0, 50, 50]}}\n```'
        return [good if r["scope"] == "page" and r["request_id"] == "1" else first if r["scope"] == "crop" else good if r["request_id"] == "2" and r["scope"] == "recrop" else "no json" for r in requests]


def test_vision(spark):
    assert vision.parse_response("x")["parse_success"] is False and vision.parse_response('noise {"headers": ["h"], "rows": [[1]]} tail')["rows"] == [["1"]]
    assert vision.parse_response('{"headers": 1, "rows": []}')["parse_success"] is False and vision.parse_response(None)["parse_success"] is False
    got = {r["request_id"]: r["wave"] for r in vision.waves(spark.createDataFrame([("1",), ("2",), ("3",)], "request_id string"), Scripted()).collect()}
    assert got == {"1": "page", "2": "recrop", "3": "crop"}
    ids = spark.createDataFrame([("doc__p1_t0__transcriber",), ("plain",)], "i string").select(vision.cost_id(F.col("i")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in ids] == [("doc__p1_t0", "transcriber"), ("plain", "")]
    assert "Caption" in spark.range(1).select(vision.prompt_context(F.lit("t"), F.lit("c"), F.lit(True))).first()[0]


def test_grades(spark):
    base = dict(text_pages=3, tables_found=0, tables_with_captions=0, figures_found=0, figures_with_captions=0, figure_captions_found=0, table_captions_found=0, figures_missing=0, tables_missing=0, sections_identified=2)
    cases = [({}, "A"), ({"text_pages": 0}, "F"), ({"tables_found": 2}, "D"), ({"tables_found": 2, "figures_found": 1}, "F"), ({"tables_found": 10, "tables_with_captions": 7}, "C"), ({"tables_found": 10, "tables_with_captions": 9}, "B"), ({"figure_captions_found": 1}, "D"), ({"sections_identified": 0}, "B")]
    for change, want in cases:
        assert spark.createDataFrame([base | change]).select(completeness.grade()).first()[0] == want


def test_stats(spark):
    rows = spark.createDataFrame([("k", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("few", 1.0)], "k string, v double")
    assert [tuple(r) for r in stats.index_fences(rows, "k", "v").collect()] == [("k", 3.0, 4.0 + 1.5 * 2.0)]
    assert stats.page_stats(spark.createDataFrame([("x",), ("",), (None,)], "markdown string")).first()["empty_pages"] == 2
    res = spark.createDataFrame([("a", "T|x", "failed", "r", None), ("b", "U", "indexed", None, "A")], "item_key string, title string, status string, reason string, quality_grade string")
    text = stats.report(res)
    assert "| failed | 1 |" in text and "T\\|x" in text and "| A | 1 |" in text
    gaps = completeness.number_gaps(spark.createDataFrame([("a", 1), ("a", 4), ("b", 1)], "k string, n int"), "k", "n").collect()
    assert {r["k"]: [tuple(g) for g in r["gaps"]] for r in gaps} == {"a": [(2, 3)], "b": []}
    huge = completeness.number_gaps(spark.createDataFrame([("a", 1), ("a", 900_000_000)], "k string, n int"), "k", "n").first()
    assert tuple(huge["gaps"][0]) == (2, 899_999_999)
    one = spark.createDataFrame([("t",), ("f",)], "status string").withColumn("item_key", F.col("status")).withColumn("title", F.lit("x")).withColumn("quality_grade", F.lit(None).cast("string"))
    assert "and 1 more" not in stats.report(one, 1) and "and 1 more" in stats.report(one.unionByName(one), 1)


def test_plan(spark):
    cur = spark.createDataFrame([("n", "h"), ("c", "h2"), ("s", "h"), ("o", "h"), ("e", "h")], "item_key string, hash string")
    old = spark.createDataFrame([("c", "h"), ("s", "h"), ("o", ""), ("g", "h")], "item_key string, old_hash string")
    empty = spark.createDataFrame([("e", "h")], "item_key string, hash string")
    got = {r["item_key"]: r["action"] for r in indexing.plan(cur, old, empty).collect()}
    assert got == {"n": "new", "c": "changed", "s": "current", "o": "no_hash", "e": "empty", "g": "gone"}


def test_embed_and_extract(spark):
    df = spark.createDataFrame([("a", "heart rate"), ("b", None)], "k string, t string")
    got = {r["k"]: r["embedding"] for r in indexing.embedded(df, "t", indexing.HashedWords(8)).collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and sum(map(abs, got["b"])) == 0

    def reader(key, content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"path": key, "page_num": 1}]

    files = spark.createDataFrame([("x", bytearray(b"ok")), ("y", bytearray(b"bad"))], "path string, content binary")
    rows = {r["path"]: (r["status"], r["reason"]) for r in indexing.extract(files, reader, "path string, page_num double, status string, reason string").collect()}
    assert rows == {"x": ("ok", None), "y": ("failed", "broken")}


def test_block_captions(spark):
    line = lambda *spans: {"spans": [{"text": t, "font": f, "bold": b} for t, f, b in spans]}
    n = ("Times", False)
    blocks = [
        [line(("Figure 1. A curve", *n)), line(("with a tail", *n))],
        [line(("Figure 2 shows that", *n)), line(("nothing is known", *n))],  # a sentence, no caption
        [line(("Figure 2", "Times-Bold", True), (" A bold label", *n))],
        [line(("Table 3", *n)), line(("Numbers of cases", *n))],  # the label on its own line
        [line(("axis label 0 10 20", *n)), line(("Fig. S1: Hidden below", *n)), line(("more", *n))],
        [line((f"text {i}", *n)) for i in range(6)] + [line(("Table 9. Too far down", *n))],
        [line(("Supplementary Table A.1 (all)", *n))],
        [line(("Table IV on its own", "X", True))],
        [line(("  ", *n))],
        [],
    ]
    rows = [("d", i, 0.0, float(100 - i), 10.0, float(101 - i), b) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "k string, block int, x0 double, y0 double, x1 double, y1 double, lines array<struct<spans:array<struct<text:string,font:string,bold:boolean>>>>")
    got = [(r["block"], r["kind"], r["number"], r["caption"]) for r in captions.block_captions(df, ["k"]).collect()]
    assert got == [
        (7, "table", "IV", "Table IV on its own"), (6, "table", "A.1", "Supplementary Table A.1 (all)"), (4, "figure", "S1", "Fig. S1: Hidden below more"),
        (3, "table", "3", "Table 3 Numbers of cases"), (2, "figure", "2", "Figure 2 A bold label"), (0, "figure", "1", "Figure 1. A curve with a tail"),
    ]
