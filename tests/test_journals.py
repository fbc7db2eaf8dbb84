import random

from quillstack.functions.fuzzy import indel_ratio
from quillstack.operators import journals


def test_names_that_differ_at_both_ends(spark):
    titles = spark.createDataFrame([("journal of political economy", "Q1"), ("annals of applied statistics and data analysis", "Q2")], "title string, quartile string")
    names = spark.createDataFrame([("ournal of political economi",), ("nnals of applied statistics and data analysi",), ("letters in law",)], "publication string")
    got = {r["publication"]: (r["quartile"], r["tier"]) for r in journals.quartiles(names, titles).collect()}
    assert got == {"ournal of political economi": ("Q1", 3), "nnals of applied statistics and data analysi": ("Q2", 3), "letters in law": (None, None)}


def test_candidates_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    titles = ["".join(rng.choice("abcd ") for _ in range(n)).strip() + "x" for n in range(1, 60)]
    names = set()
    for t in titles:
        for _ in range(6):
            s = list(t)
            for _ in range(rng.randint(1, 1 + len(t) // 6)):
                i = rng.randrange(len(s) + 1)
                s[i : i + rng.randint(0, 1)] = rng.choice(["", "y", "a", "z"])
            names.add("".join(s).strip() or "q")
    known = spark.createDataFrame([(t, "Q1") for t in titles], "title string, quartile string")
    asked = spark.createDataFrame([(n,) for n in sorted(names)], "publication string")
    got = {r["publication"] for r in journals.quartiles(asked, known).where("tier is not null").collect()}
    norm = journals.normalized_title
    pairs = asked.select("publication", norm(asked["publication"]).alias("a")).crossJoin(known.select(norm(known["title"]).alias("b")))
    want = {r["publication"] for r in pairs.where(indel_ratio("a", "b") >= 90).collect()}
    assert want and want <= got
