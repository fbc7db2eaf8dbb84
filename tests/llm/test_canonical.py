import pytest

from quillstack.llm import canonical

TITLES = ["journal of urban botany", "studies in optics", "annals of numismatics & crystallography", "proceedings of the thornwold society of robotics", "proceedings of the thornwold society of robotics part b", "revue européenne de optics", "journal of regional crystallography", "journal of regional crystallography reviews", "clinical optics - methods and behaviour", "normere journal of optics"]
CASES = [
    ("Journal of Urban Botany", 0), ("  JOURNAL OF URBAN BOTANY ", 0), ("J. of Urban Botany", 0), ("J. Urb. Bot.", 0), ("Jounral of Urban Botanny", 0), ("Urban Botany, Journal of", 0), ("Urban Botany (Journal of)", 0), ("JournalofUrbanBotany", 0), ("Journal_of_Urban_Botany", 0),
    ("Studies in Optics (Online)", 1), ("In: Studies in Optics", 1), ("Studies in Optics, vol. 20", 1), ("Studies in Optics – Lantern House", 1), ("Annals of Numismatics &amp; Crystallography", 2), ("Annals of Numismatics and Crystallography", 2), ("PTSR", 3), ("P.T.S.R.P.B.", 4), ("Proc. Thornw. Soc. Robot. Part B", 4),
    ("Revue Europeenne de Optics", 5), ("Revue EuropÃ©enne de Optics", 5), ("Journal of Regional Crystallography Reviews", 7), ("Clinical Optics - Methods and Behavior", 8),
    ("Marmere Journal of Optics", None), ("Meeting notes: Optics – Normere 1996", None), ("unknown", None), ("", None), (" ", None), (None, None), ("??", None), ("x" * 5000, None),
]


@pytest.fixture(scope="module")
def found(spark):
    # words of other journals that stand in several values are words of their own
    other = [("O1", "Marmere Journal of Botany"), ("O2", "Marmere Studies"), ("O3", "Marmere Letters of Law"), ("O4", "The Marmere Courier")]
    rows = [(f"K{i}", t, "clash") for i, (t, _) in enumerate(CASES)] + [(k, t, "clash") for k, t in other] + [("K0", CASES[0][0], "clash")]
    items = spark.createDataFrame(rows, "item_key string, publication string, title_normalized string")
    quartiles = spark.createDataFrame([(t, "Q1", "x") for t in TITLES + TITLES[:2]] + [(None, None, "x"), ("", "Q2", "x")], "title_normalized string, quartile string, publication string")
    return canonical.map_publications(items, quartiles).collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    got = {r["title_normalized"] for r in found if r["item_key"] == f"K{i}"}
    text, want = CASES[i]
    if text is None or not text.strip():
        assert got == set()
    else:
        assert got == {None if want is None else TITLES[want]}


def test_every_row_is_reported_once(found):
    assert len(found) == len(set(found))


def test_empty(spark):
    items = spark.createDataFrame([("a", "Studies in Optics")], "item_key string, publication string")
    titles = spark.createDataFrame([("studies in optics", "Q1")], "title_normalized string, quartile string")
    assert [tuple(r) for r in canonical.map_publications(items, titles.limit(0)).collect()] == [("a", "Studies in Optics", None)]
    assert canonical.map_publications(items.limit(0), titles).count() == 0
    assert canonical.found_titles(items, titles).count() == 1


def test_pigeonhole_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    ref = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 26))) for _ in range(40)]

    def worn(s):
        s = list(s)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(s) + 1)
            rng.choice([lambda: s.insert(i, rng.choice("abcd")), lambda: s and s.pop(min(i, len(s) - 1)), lambda: s and s.__setitem__(min(i, len(s) - 1), rng.choice("abcd"))])()
        return "".join(s) or "a"

    typed = sorted({worn(r) for r in ref for _ in range(3)})
    left = spark.createDataFrame([(t, 0, t) for t in typed], "id string, kind int, form string")
    right = spark.createDataFrame([(t, 0, t) for t in sorted(set(ref))], "title string, kind int, form string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    allowed = lambda n: 5 if n >= 24 else 4 if n >= 14 else 3 if n >= 10 else 2 if n >= 8 else 1 if n >= 5 else 0
    want = {(a, b, d) for a, b in itertools.product(typed, set(ref)) if (d := lev(a, b)) <= allowed(len(b))}
    assert {tuple(r) for r in canonical.pigeonhole(left, right).collect()} == want
