import random
import textwrap

import pytest

from quillstack.llm import scans
from tests.llm.test_scans import NOUNS, PAGE, VERBS, body


def test_recased():
    assert scans.corrected("Glac1er,", {"glac1er": "glacier"}, False) == "Glacier,"
    assert scans.corrected("(oastal", {"(oastal": "coastal"}, False) == "coastal"
    assert scans.corrected("GLAC1ER", {"glac1er": "glacier"}, False) == "GLACIER"
    assert scans.corrected("(glac1er)", {"glac1er": "glacier"}, False) == "(glacier)"


def test_paragraphs():
    text = "HEAD\n\nThe glac1er and the rnoraine fol-\nlowed the cross-\nsectional coast that was long known\nand so on.\nThen the survey began, as expected.\n\n2. Methods\n| a | b |\n|---|---|\nIt ends with a gla-\n\n— 4 —"
    out, joins, goes_on = scans.paragraphs(text, {1, 14}, {3: None, 12: "cier"}, {"glac1er": "glacier", "rnoraine": "moraine"}, False, 36)
    assert out == ["The glacier and the moraine followed the cross-sectional coast that was long known and so on.", "Then the survey began, as expected.", "2. Methods", "| a | b |\n|---|---|", "It ends with a glacier"]
    assert joins and goes_on


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    pages = []
    for n in range(1, 7):
        words = f"{body(rng, 30)} near the glac1er and {body(rng, 40)}"
        lines = textwrap.wrap(words, 60)
        at = next((i for i, line in enumerate(lines[:-1]) if len(line) <= 56 and lines[i + 1].split()[0] in NOUNS + VERBS), None)
        if at is not None:
            lines[at], lines[at + 1] = f"{lines[at]} {lines[at + 1][:2]}-", lines[at + 1][2:]
        last = " gla-" if n == 3 else "."
        pages.append([n, "SCAN", n, ["ON THE DELTA OF OLDMERE", "", *["cier that was not yet known."] * (n == 4), *lines[:-1], lines[-1][:50] + last, "", f"— {n + 40} —"]])
    pages = [(*p[:3], "\n".join(p[3])) for p in pages]
    prose = lambda: ". ".join(body(rng, 12).capitalize() for _ in range(8)) + "."
    clean = [(100 + n, f"CLEAN{n // 3}", n % 3 + 1, f"# Results\n\n{prose()}\n\n| a | b |\n|---|---|\n| 1974 | 12 |\n\n{prose()}") for n in range(90)]
    rows = [(*r, "c", "c") for r in [*pages, *clean, pages[0], (900, "X", 1, None), (901, "X", 2, ""), (50, "WIDE", 1, "near the glac1er " + "the delta " * 60)]]
    out = {r["page_id"]: r["text"] for r in scans.repaired_pages(spark.createDataFrame(rows, PAGE)).collect()}
    return {r[0]: r[3] for r in rows}, out


def test_pages_are_repaired(texts):
    before, after = texts
    assert set(after) == set(before)
    for n in (1, 2, 5, 6):
        assert "OLDMERE" not in after[n] and "—" not in after[n] and "\n" not in after[n]
        assert "near the glacier and" in after[n] and "- " not in after[n]
    assert after[3].endswith(" glacier that was not yet known.") and "cier that" not in after[4].replace("glacier", "")


def test_a_paper_without_any_line_of_print_width(texts):
    assert texts[1][50].startswith("near the glacier the delta")


def test_clean_pages_are_unchanged(texts):
    before, after = texts
    assert all(after[n] == before[n] for n in before if n >= 100)


def test_misread_without_ratio_and_outside_the_table(spark):
    counts = [("eldbriova", 18), ("e1dbriova", 2), ("glacier", 300), ("gl@cier", 1), ("moraine", 200), ("mor@ine", 1), ("basalt", 150), ("bas@lt", 2), ("delta", 90), ("delt@s", 1), ("deltas", 9), ("norvoova", 30), ("norvaova", 12), ("b2b", 2)]
    known = spark.createDataFrame(counts, "word string, n long")
    rare = known.where("n < 20").withColumnRenamed("n", "times")
    found = {tuple(r) for r in scans.misreadings(rare, known).collect()}
    assert found == {("e1dbriova", "eldbriova"), ("gl@cier", "glacier"), ("mor@ine", "moraine"), ("bas@lt", "basalt"), ("delt@s", "deltas")}
