import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillstack.llm import pieces

ROW = "item_key string, full_markdown string, config_id int, piece string, chunk_size int"
CONF = "config_id int, chunk_size int, chunk_overlap int, item_key string"


def check(spark, texts, size, lap):
    df = spark.createDataFrame([(str(i), t, 1, "clash", 7) for i, t in enumerate(texts)], ROW)
    conf = spark.createDataFrame([(1, size, lap, "clash")], CONF)
    limit = size * 4
    overlap = min(lap * 4, limit - 1)
    got: dict = {}
    for r in pieces.split_texts(df, conf).collect():
        got.setdefault(r["item_key"], []).append(r)
    kinds = {r["item_key"]: r["cut"] for r in pieces.found_cuts(df, conf).collect()}
    for i, t in enumerate(texts):
        if t is None or len(t) <= limit:
            assert str(i) not in got and str(i) not in kinds
            continue
        rows = sorted(got[str(i)], key=lambda r: r["piece_no"])
        end = 0
        for r in rows:
            assert len(r["piece"]) <= limit and t[r["char_start"] : r["char_end"]] == r["piece"] and r["char_start"] <= end < r["char_end"]
            tile = r["char_end"] - end
            # the overlap is whole after every cut; only a stretch that fits in the limit alone stands with less of it
            assert end - r["char_start"] == min(overlap, end) or (end - r["char_start"] == limit - tile and not any(c in t[end : r["char_end"]] for c in " \t\n\r"))
            end = r["char_end"]
        assert end == len(t)
        words = t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        assert kinds[str(i)] == ("forced" if max(map(len, words)) > limit else "natural")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab .\n😀"), max_size=300), min_size=1, max_size=20), st.integers(2, 12), st.integers(0, 14))
def test_against_definition(spark, texts, size, lap):
    check(spark, texts, size, lap)


def test_many_tiles(spark):
    check(spark, ["".join(f"w{i} " for i in range(9000)), "z" * 30_000], 5, 3)


def test_edges(spark):
    check(spark, [None, "", "x" * 40, "x" * 41, ("y" * 40 + " ") * 3, "y " * 400, "a" * 39 + " " + "b" * 41, "😀" * 41, "\n" * 100, "A sentence here. " * 3000], 10, 2)


def test_natural_boundaries(spark):
    text = "First sentence is here. Second one follows it.\n\nNew paragraph starts. " * 4
    df = spark.createDataFrame([("a", text, 1, "", 0)], ROW)
    conf = spark.createDataFrame([(1, 15, 0, "")], CONF)
    ends = [text[: r["char_end"]] for r in pieces.split_texts(df, conf).orderBy("piece_no").collect()]
    assert all(e.endswith((". ", "\n\n", ".\n")) for e in ends)


@pytest.mark.parametrize("conf", [[], [(2, 10, 1, "x")], [(1, 0, 0, "x")], [(1, None, None, "x")]])
def test_unknown_size(spark, conf):
    df = spark.createDataFrame([("a", "word " * 100, 1, "", 0), ("b", "word " * 100, None, "", 0)], ROW)
    c = spark.createDataFrame(conf, CONF)
    assert pieces.found_cuts(df, c).count() == 0 and pieces.split_texts(df, c).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([("a", "word " * 100, 1, "", 0)] * 3, ROW)
    c = spark.createDataFrame([(1, 10, 1, "x")], CONF)
    rows = pieces.split_texts(df, c).collect()
    assert len(rows) == len({r["piece_no"] for r in rows})
