import pytest
from pyspark.sql import functions as F

from quillstack.functions import fuzzy, html, text, vector


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def test_titles(spark):
    assert one(spark, " Heart & Rhythm: A/B-C ", text.normalized_title) == "heart rhythm a b c"
    assert set(one(spark, "Proc. Int. Conf.", text.title_expansions)) == {"proceedings international conference"}
    assert set(one(spark, "J. Sci.", text.title_expansions)) == {"journal science", "journal sciences"}
    assert one(spark, None, text.normalized_title) is None


@pytest.mark.parametrize("heading,label", [("## 2.1 **Materials and Methods**", "methods"), ("# Summary", "conclusion"), ("Summary statistics", "results"), ("Acknowledgments", "appendix"), ("Foreword", None), ("REFERENCES", "references")])
def test_sections(spark, heading, label):
    assert one(spark, heading, lambda c: text.section_of(text.heading_text(c))) == label


@pytest.mark.parametrize("cell,clean", [(".047", "0.047"), ("18278 - .", "-18278."), ("- 5.2", "-5.2"), ("eﬃcient", "efficient"), ("a\n b", "a b"), ("−3", "-3"), ("well - known", "well - known"), (".5*", "0.5*"), ("", "")])
def test_cells(spark, cell, clean):
    assert one(spark, cell, text.clean_cell) == clean


def test_quality(spark):
    assert one(spark, "x" * 30, text.is_garbled) and not one(spark, "α" + "x" * 30, text.is_garbled) and not one(spark, "x" * 20 + "-" + "y" * 20, text.is_garbled)
    assert one(spark, "a b c d e word", text.is_interleaved) and not one(spark, "1 2 3 4 5 6", text.is_interleaved)
    assert not one(spark, None, text.is_garbled) and not one(spark, "", text.is_interleaved)


def test_terms(spark):
    assert one(spark, "Die Änderung ist klein.", lambda c: text.has_terms(c, ["änderung", "KLEIN"]))
    assert not one(spark, "heartbeat", lambda c: text.has_terms(c, ["heart"]))
    assert one(spark, "a.b", lambda c: text.has_terms(c, ["a.b"])) and not one(spark, "axb", lambda c: text.has_terms(c, ["a.b"]))


def test_small_ones(spark):
    assert one(spark, "https://doi.org/10.1/x", text.bare_doi) == "10.1/x"
    assert [one(spark, v, text.year_prefix) for v in ("2019-01", "abcd", "19", None)] == [2019, 0, 19, 0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [None, None, None]


def test_ratio(spark):
    assert fuzzy.ratio("abcd", "abcd") == 100 and fuzzy.ratio("", "") == 100 and fuzzy.ratio("abc", "xyz") == 0
    assert abs(fuzzy.ratio("journal of physics", "journal of physiks") - 200 * 17 / 36) < 1e-9
    df = spark.createDataFrame([("ab", "ac"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.indel_ratio("a", "b")).collect()] == [50.0, None]


def test_html(spark):
    t = html.read_table("<table><tr><th colspan=2>A</th><th>B</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr><tr><td>6</td><td>7</td><td>8</td></tr></table>note <b>x</b>")
    assert t == {"headers": ["A", "A", "B"], "rows": [["1", "2", "3"], ["1", "4", "5"], ["6", "7", "8"]], "footnotes": "note x"}
    assert html.read_table("") == {"headers": [], "rows": [], "footnotes": ""}
    assert html.read_table("<table><tr><td>h</td></tr><tr><td>r</td></tr></table>")["headers"] == ["h"]
    got = spark.createDataFrame([("<table><tr><td>h</td></tr></table>",), (None,)], "h string").select(html.html_table("h").alias("t")).select("t.*").collect()
    assert got[0]["headers"] == ["h"] and got[1]["headers"] == []


def test_controls_and_bare_scores(spark):
    from quillstack.operators.search import composite

    rows = spark.createDataFrame([("a\x02b", "CMSY10"), ("a\x02b", "Times"), ("a\x02b", None)], "t string, f string")
    assert [r[0] for r in rows.select(text.without_controls(F.col("t"), F.col("f"))).collect()] == ["a\x02b", "ab", "ab"]
    score = lambda v, guard: spark.range(1).select(composite(F.lit(v), F.lit("results"), F.lit("Q1"), 0.5, guard=guard)).first()[0]
    assert score(-0.25, True) == 0.0 and score(-0.25, False) is None and score(0.25, False) == 0.5
