import numpy as np
import pytest

from quillstack.llm import scans
from quillstack.llm.boosting import BoostedTrees

PAGE = "page_id long, item_key string, page_num int, markdown string, key string, line_no string"


def test_boosting():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = BoostedTrees(rounds=60).fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert BoostedTrees().fit(np.empty((0, 3)), np.empty(0)).probability(x[:2]).shape == (2,)


@pytest.mark.parametrize("line,value", [("367", 367), ("— 1 —", 1), ("p. 12", 12), ("Page l3", 13), ("[110]", 110), ("1 / 8", 1), ("xiv", 14), ("· 3 ·", 3), ("- 9 -", 9), ("59 613", None), ("text", None), ("1974.5", None), ("", None), ("i", 1), ("ii", 2)])
def test_page_value(line, value):
    assert scans.page_value(line) == value


def test_skeletons():
    for wrong, right in (("stiidies", "studies"), ("winclholm", "windholm"), ("cr!minal", "criminal"), ("c1osing", "closing"), ("moriopoly", "monopoly"), ("rnedian", "median"), ("vvithout", "without"), ("(oastal", "coastal"), ("costlv", "costly")):
        assert any(scans.skeleton(a) == scans.skeleton(b) for a, b in ((wrong, right),)), (wrong, right)


NOUNS = "glacier river delta survey coast snowpack monsoon limestone aquifer basalt moraine stratum erosion rainfall permafrost".split()
VERBS = "followed shaped limited explained preceded altered delayed replaced".split()


def body(rng, n=9):
    """A line of running text."""
    words = []
    while len(words) < n:
        words += ["the", rng.choice(NOUNS), rng.choice(VERBS), "a", rng.choice(NOUNS), rng.choice(["near", "after", "before"])]
    return " ".join(words[:n])


@pytest.fixture(scope="module")
def noise(spark):
    import random

    rng = random.Random(9)
    pages = []
    for n in range(1, 7):
        lines = [f"ON THE DELTA OF OLDMERE    {n}" if n % 2 else "ON THE DELTA OF OLDMERE", "", body(rng), body(rng) + " sur-", ("v" + ("cy" if n == 2 else "ey") + " ") + body(rng) + " cross-", "sectional pattern near the glac1er " + body(rng, 3), body(rng), body(rng) + ".", "", f"— {n + 40} —"]
        pages.append([n, "SCAN", n, lines])
    pages[2][3][7] = body(rng) + " gla-"
    pages[3][3][2] = "cier " + body(rng)
    pages = [(*p[:3], "\n".join(p[3])) for p in pages]
    prose = lambda: ". ".join(body(rng, 12).capitalize() for _ in range(8)) + f". The cross-sectional pattern number {rng.random()} held."
    clean = [(100 + n, f"CLEAN{n // 3}", n % 3 + 1, f"# Results\n\n{prose()}\n\n| a | b |\n|---|---|\n| 1974 | 12 |\n\n{prose()}") for n in range(90)]
    rows = [(*r, "clash", "clash") for r in pages + clean + [pages[0]]] + [(900, "X", 1, None, "c", "c"), (901, "X", 2, "", "c", "c"), (902, "X", 3, "  \n ", "c", "c"), (None, "X", 4, "1", "c", "c"), (903, "LONG", 1, "word " * 30000, "c", "c")]
    return {tuple(r) for r in scans.found_noise(spark.createDataFrame(rows, PAGE)).collect()}


def test_furniture(noise):
    for n in range(1, 7):
        assert (n, 1, "running_header") in noise
    assert {(p, k) for p, _, k in noise if k == "page_number"} == {(n, "page_number") for n in range(1, 7)}


def test_divided_words(noise):
    divided = {(p, line) for p, line, k in noise if k == "hyphenation"}
    assert {(n, 4) for n in range(1, 7)} <= divided
    assert not any(line == 5 for _, line in divided)  # a compound at its own hyphen
    assert (3, 8) in divided  # goes on on the next page


def test_misread(noise):
    assert {(n, 6, "misread") for n in range(1, 7)} <= noise


def test_misread_half_counts_on_its_line(noise):
    assert (2, 5, "misread") in noise and (2, 4, "misread") not in noise and (2, 4, "hyphenation") in noise


def test_clean_pages_stay(noise):
    assert not [x for x in noise if x[0] and x[0] >= 100]


def test_empty(spark):
    assert scans.found_noise(spark.createDataFrame([], PAGE)).count() == 0


def test_confusions_no_table_knows(spark):
    """Words of the test pages misread by a confusion that is in no table, once each: found and read right; nothing else changes."""
    import re
    from collections import Counter

    pages = spark.read.parquet("/root/testdata/sf0.01/page_extractions.parquet").where("page_id is not null and length(markdown) > 0").dropDuplicates(["page_id"])
    rows = sorted(pages.select("page_id", "item_key", "page_num", "markdown").collect())
    counts = Counter(w for r in rows for _, _, w in scans.line_words(r["markdown"].split("\n")))
    left = sorted(w for w, n in counts.items() if n >= 40 and len(w) >= 7 and w.isalpha() and w.isascii())[::6]
    swap = {"a": "x", "e": "k", "o": "x", "r": "p", "t": "j", "n": "b"}
    planted, changed = {}, []
    for r in rows:
        text = r["markdown"]
        for w in left:
            at = next((i for i in range(1, len(w) - 1) if w[i] in swap), None)
            m = re.search(rf"(?<![\w-]){w}(?![\w-])", text)
            if m and at is not None and (wrong := w[:at] + swap[w[at]] + w[at + 1 :]) not in counts:
                left.remove(w)
                planted[r["page_id"], wrong] = w
                text = text[: m.start()] + wrong + text[m.end() :]
                break
        changed.append((r["page_id"], r["item_key"], r["page_num"], text))
    find = lambda df: {(r["page_id"], r["wrong"], r["right"]) for r in scans.noisy_lines(df).where("kind = 'misread'").collect()}
    before = find(pages)
    after = find(spark.createDataFrame(changed, "page_id long, item_key string, page_num int, markdown string"))
    hit = {(p, wrong, right) for (p, wrong), right in planted.items()} & after
    assert len(planted) >= 10 and len(hit) >= 0.9 * len(planted)
    assert len((after - hit) ^ before) <= 0.02 * len(before)
