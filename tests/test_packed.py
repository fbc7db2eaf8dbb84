import itertools
import math

import pytest

from quillstack.operators import packed


def entries(text):
    return [[packed.joined(p, g, 0, len(p) - 1)] if not k else p for p, g, k in packed.lex(text)]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a; b ; c", [["a "], ["b "], ["c"]]),
        ('"x; y" | b', [["x; y"], ["b"]]),
        ('"the ""quiet"" period"；b', [['the "quiet" period'], ["b"]]),
        ("one; maps, hand-drawn", [["one"], ["maps, hand-drawn"]]),
        ('["a, b", "c"]', [["a, b"], ["c"]]),
        (r"north\; upper;b", [["north; upper"], ["b"]]),
        ("'soil, alpine' | to-read", [["soil, alpine"], ["to-read"]]),
        ("l’Atlas|x", [["l’Atlas"], ["x"]]),
        (r"C:\path;b", [[r"C:\path"], ["b"]]),
        (" ;; ", []),
        ("", []),
    ],
)
def test_lex(text, expected):
    assert [[x.strip() for x in run] for run in entries(text)] == [[x.strip() for x in run] for run in expected]


def run(spark, rows, schema="item_key string, tags string, collections string, pos int, entry string"):
    df = packed.unpack_library(spark.createDataFrame([(*r, 9, "clash") for r in rows], schema))
    return sorted((r["item_key"], r["field_name"], r["pos"], r["entry"]) for r in df.collect())


def test_entries(spark):
    rows = [("K1", "alpha, beta, pre/post", "x"), ("K2", "pre/post", None), ("K3", "pre/post; alpha", ""), ("K4", "beta / alpha", "x, y"), ("K4", "beta / alpha", "x, y"), ("K5", "alpha", "y"), ("K6", "beta; beta", "x | y"), ("K7", "  ", None)]
    rows += [(f"N{i}", "alpha; beta; pre/post", "x; y") for i in range(20)]
    got = run(spark, rows)
    assert [x[3] for x in got if x[0] == "K1" and x[1] == "tags"] == ["alpha", "beta", "pre/post"]
    assert [x[3] for x in got if x[0] == "K4" and x[1] == "tags"] == ["beta", "alpha"]
    assert [x[3] for x in got if x[0] == "K4" and x[1] == "collections"] == ["x", "y"]
    assert [(x[2], x[3]) for x in got if x[0] == "K6" and x[1] == "tags"] == [(1, "beta"), (2, "beta")]
    assert not [x for x in got if x[0] == "K7"]


def test_empty_and_long(spark):
    assert run(spark, []) == []
    got = run(spark, [("K", "; ".join(f"t{i}" for i in range(3000)), ", ".join(f"c{i}" for i in range(300)))])
    assert len([x for x in got if x[1] == "tags"]) == 3000 and len([x for x in got if x[1] == "collections"]) == 300


def all_splits(n):
    for cuts in itertools.product((False, True), repeat=n - 1):
        ends = [g for g, c in enumerate(cuts) if c] + [n - 1]
        yield list(zip([0] + [e + 1 for e in ends[:-1]], ends))


def test_lattice_against_all_splits():
    seen = {(0, 0): 3.0, (1, 1): 1.0, (2, 3): 2.5, (0, 1): 0.5, (3, 3): 4.0}
    shares, size = [0.9, 0.2, 0.95], 20.0
    cut, keep = [math.log(x) for x in shares], [math.log(1 - x) for x in shares]
    net = packed.Lattice(4, seen, cut, keep, size)
    net.sums()

    def weight(split):
        w = 1.0
        for i, j in split:
            w *= (seen.get((i, j), 0.0) + packed.UNSEEN * (packed.UNSEEN / size) ** (j - i)) / size * math.prod(1 - x for x in shares[i:j]) * (shares[j] if j < 3 else 1.0)
        return w

    splits = list(all_splits(4))
    total = sum(map(weight, splits))
    assert math.isclose(math.exp(net.forward[4]), total) and math.isclose(math.exp(net.backward[0]), total)
    post = net.spans(1e-300)
    for i in range(4):
        for j in range(i, 4):
            assert math.isclose(post[i, j], sum(weight(s) for s in splits if (i, j) in s) / total)
    for g in range(3):
        assert math.isclose(net.boundary(g), sum(weight(s) for s in splits if any(j == g for _, j in s)) / total)
    assert net.best() == max(splits, key=weight)


@pytest.mark.parametrize("n", [60, 120, 400, 5000])
def test_many_separators(spark, n):
    names = [f"t{i}" for i in range(n)]
    wide = '"' + ", ".join(names) + '"'
    rows = [("Q", wide + ", x", "p"), ("P", ", ".join(f"u{x}" for x in names), "q"), ("S", "/".join(names), "r"), *[(f"N{i}", ", ".join(names[i : i + 4]), "s") for i in range(0, 40, 2)]]
    got = run(spark, rows)
    assert [x[3] for x in got if x[0] == "Q" and x[1] == "tags"] == [wide[1:-1], "x"]
    assert [x[3] for x in got if x[0] == "N4" and x[1] == "tags"] == names[4:8]
    assert [x[3] for x in got if x[0] == "P" and x[1] == "tags"] == [f"u{x}" for x in names]
    assert "/".join(x[3] for x in got if x[0] == "S" and x[1] == "tags") == "/".join(names)


def test_columns_learn_apart(spark):
    """A slash that separates tags doesn't separate collections."""
    rows = [(f"K{i}", f"a{i % 7}/b{i % 5}", f"c{i % 7}/d{i % 7}, e{i % 11}") for i in range(77)] + [(f"Z{i}", f"a{i}; b{i}", f"c{i}/d{i}; e{i}") for i in range(7)]
    got = run(spark, rows)
    assert [x[3] for x in got if x[0] == "K8"] == ["c1/d1", "e8", "a1", "b3"]


def plain_split(text):
    """Entries by hand-written rules, without anything learned: tight slashes never separate, commas only without semicolons."""
    import json
    import re

    if text.strip().startswith("["):
        return [x.strip() for x in json.loads(text)]
    bare = re.sub(r'"(?:[^"]|"")*"|“[^”]*”|\\.|(?:^|(?<=[;|,；\n\t])|(?<=[;|,；] ))\'[^\']*\'', "", text)
    marks = ";；|\n\t" + ("" if ";" in bare or "；" in bare else ",")
    out, buffer, i = [], "", 0
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text):
            buffer, i = buffer + text[i + 1], i + 2
        elif ch in "\"'“" and not buffer.strip() and (m := re.match(r'"((?:[^"]|"")*)"' if ch == '"' else r"'([^']*)'" if ch == "'" else r"“([^”]*)”", text[i:])):
            buffer, i = m.group(1).replace('""', '"') if ch == '"' else m.group(1), i + m.end()
        elif ch in marks or (ch == "/" and text[i - 1 : i] == " " and text[i + 1 : i + 2] in (" ", "")):
            out.append(buffer)
            buffer, i = "", i + 1
        else:
            buffer, i = buffer + ch, i + 1
    return [x.strip() for x in [*out, buffer]]


def test_against_a_plain_splitter(spark):
    items = spark.read.parquet("/root/testdata/sf0.01/library_items.parquet")
    want = set()
    for r in items.select("item_key", "tags", "collections").distinct().collect():
        for field in ("tags", "collections"):
            if r[field] is not None:
                entries_ = [e for e in plain_split(r[field]) if e]
                want |= {(r["item_key"], field, n, e) for n, e in enumerate(entries_, 1)}
    got = {tuple(r) for r in packed.unpack_library(items).collect()}
    assert got == want
