import random

import pytest

from quillstack.llm import subjects

WORDS = {"law": "court statute plaintiff tribunal verdict appeal clause".split(), "sport": "goalkeeper referee stadium sprint league coach match".split(), "physics": "photon lattice entropy quark laser plasma boson".split()}
SHARED = "trial"
FILLER = ["We thank the readers for their remarks in the closing part.", "Percentages are rounded and may not add up to one hundred.", "The remaining results are given in the supplement."]


def sentence(rng, subject):
    a, b = rng.sample(WORDS[subject], 2)
    return rng.choice([f"The {a} was compared with the {b} in many of the cases.", f"It follows that the {a} need not imply the {b} at all.", f"What was said of the {a} holds for the {b} as well."])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    docs, truth = [], set()
    for i in range(400):
        main, second = rng.sample(sorted(WORDS), 2)
        parts = [sentence(rng, main) for _ in range(6)] + [rng.choice(FILLER) for _ in range(2)]
        truth.add((i, main))
        if i % 3 == 0:
            parts += [sentence(rng, second) for _ in range(5)]
            truth.add((i, second))
        elif i % 3 == 1:
            parts.append(sentence(rng, second))  # in passing
        rng.shuffle(parts)
        docs.append((i, " ".join(parts) if i % 2 else "\n".join("- " + p for p in parts)))
    docs += [(1000, None), (1001, ""), (1002, "   "), (1003, " ".join(FILLER)), (1004, "氷壌林 " * 2000), (1005, docs[1][1])]
    truth |= {(1005, s) for i, s in truth if i == 1}
    examples = [(f"{sentence(rng, s)} {sentence(rng, s)}", s) for s in sorted(WORDS) for _ in range(8)] + [(sentence(rng, "law"), "sport"), (None, "law"), ("x", "nothing")]
    d = spark.createDataFrame([(*r, "xx", "clash") for r in docs], "doc_id long, text string, lang string, subject string")
    areas = spark.createDataFrame([(s, "x") for s in WORDS] + [(None, "x")], "subject string, doc_id string")
    ex = spark.createDataFrame(examples, "text string, subject string")
    return d, areas, ex, truth


def test_held_out_accuracy(tables):
    d, areas, ex, truth = tables
    got = {(r["doc_id"], r["subject"]) for r in subjects.document_subjects(d, areas, ex).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert not [x for x in got if x[0] in (1000, 1001, 1002, 1004)]


def test_empty(tables):
    d, areas, ex, _ = tables
    assert subjects.document_subjects(d.limit(0), areas, ex).count() == 0
    assert subjects.document_subjects(d, areas.limit(0), ex).count() == 0
    assert subjects.document_subjects(d, areas, ex.limit(0)).count() == 0


def test_units():
    text = "# Head\n\nOne sentence is\nwrapped here. Another (2004) follows it. Fig. 3 shows more things.\n\n- an entry. with two parts\n- second entry\n\n| a | b |\n|---|---|\n| 1 | 2 |\nFigure 1. An entry of its own. Really so."
    assert subjects.units(text) == ["One sentence is wrapped here.", "Another (2004) follows it.", "Fig. 3 shows more things.", "- an entry. with two parts", "- second entry", "| 1 | 2 |", "Figure 1. An entry of its own. Really so."]
    assert subjects.units("") == [] and subjects.units("\r\n\r\n") == []


def test_word_vectors_take_three_passes(tables, monkeypatch):
    passes = []
    gathered = subjects.gathered
    monkeypatch.setattr(subjects, "gathered", lambda coded, columns, work, widths: passes.append(columns) or gathered(coded, columns, work, widths))
    docs, _, _, _ = tables
    subjects.fit(subjects.written(subjects.coded_documents(docs)), [(" ".join(words), i) for i, words in enumerate(WORDS.values())], len(WORDS))
    assert passes.count(("terms", "times")) == 3  # two of them turn the basis, the last one is for Rayleigh-Ritz
