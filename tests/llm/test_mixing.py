import numpy as np
import pytest

from quillstack.llm import bpe, mixing

DOCS = "doc_id long, source string, text string, block long, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int, doc_id long"


def docs(spark, spec):
    rows, n = [], 0
    for source, count, words in spec:
        for _ in range(count):
            n += 1
            rows.append((n, source, ("word " * words)[:-1] if words is not None else None, 0, "clash"))
    return spark.createDataFrame(rows, DOCS)


def test_permutation():
    for size in (1, 2, 7, 64, 1000):
        got = mixing.permuted(np.arange(size), size, 5)
        assert sorted(got) == list(range(size))
    assert list(mixing.permuted(np.arange(100), 100, 5)) != list(mixing.permuted(np.arange(100), 100, 6))


def test_draws():
    rest = np.array([5, 0, 20])
    got = mixing.drawn(rest, 10, np.random.default_rng(1))
    assert got.sum() == 10 and (got <= rest).all()


def test_packed(spark):
    sized = spark.createDataFrame([(1, "a", 5), (2, "a", 0), (3, "a", 12), (4, "b", 8)], "doc_id long, source string, n_tokens long")
    rows = {(r["source"], r["block"]): r for r in mixing.packed(sized, 8).collect()}
    assert sum(r["n_tokens"] for r in rows.values()) == 25 and rows["b", 0]["n_tokens"] == 8 and rows["a", 0]["n_tokens"] == 8
    used: dict = {}
    for r in rows.values():
        for p in r["parts"]:
            used.setdefault(p["doc_id"], []).append((p["token_from"], p["token_to"]))
    assert {d: sum(b - a for a, b in v) for d, v in used.items()} == {1: 5, 3: 12, 4: 8}


def test_mix(spark):
    d = docs(spark, [("big", 60, 100), ("small", 4, 100), ("untold", 5, 50), (None, 3, 50), ("big", 2, None), ("big", 2, 0)])
    t = spark.createDataFrame([("big", 0.6, 2, 0), ("small", 0.3, 3, 0), ("absent", 0.1, 4, 0)], TARGETS)
    m = mixing.mix(d, t, block_tokens=32, shard_slots=16).cache()
    s = {r["source"]: r for r in mixing.shares(m, t).collect()}
    assert abs(s["big"]["reached_share"] - 0.6 / 0.9) < 0.02 and s["absent"]["tokens"] == 0
    assert s["small"]["most_uses"] <= 3 and s["big"]["most_uses"] <= 2
    assert {r["source"] for r in m.select("source").distinct().collect()} == {"big", "small"}
    n = m.groupBy("source", "block", "repetition").count().where("count > 1").count()
    assert n == 0 and m.select("shard", "slot").distinct().count() == m.count()
    again = mixing.mix(d, t, block_tokens=32, shard_slots=16)
    ids = {(r["shard"], r["slot"]): r["ids"] for r in mixing.tokens_of(m, d).collect()}
    assert len(ids) == m.count() and all(len(ids[r["shard"], r["slot"]]) == r["n_tokens"] for r in m.collect())
    key = lambda df: sorted((r["shard"], r["slot"], r["source"], r["block"]) for r in df.collect())
    assert key(m) == key(again)
    m.unpersist()


@pytest.mark.parametrize("targets", [[], [("absent", 1.0, 2, 0)], [("big", 0.0, 2, 0)], [("big", 1.0, 0, 0)], [(None, 1.0, 1, 0)]])
def test_nothing_to_draw(spark, targets):
    d = docs(spark, [("big", 3, 10)])
    assert mixing.mix(d, spark.createDataFrame(targets, TARGETS)).count() == 0


def test_empty_documents(spark):
    t = spark.createDataFrame([("big", 1.0, None, 0)], TARGETS)
    assert mixing.mix(docs(spark, [("big", 1, 5)]).limit(0), t).count() == 0
    m = mixing.mix(docs(spark, [("big", 3, 40)]), t, block_tokens=16).collect()
    assert sum(r["n_tokens"] for r in m) == 3 * len(bpe.encoder().encode(("word " * 40)[:-1]))


def test_draws_of_any_size():
    rng = np.random.default_rng(1)
    for good, bad, n in ((3, 4, 5), (50, 60, 8), (5000, 7000, 3000), (7000, 5000, 11000), (10**12, 3 * 10**12, 10**9), (10**13, 17, 10**12), (0, 9, 4), (9, 0, 4)):
        xs = np.array([mixing.taken(good, bad, n, rng) for _ in range(400)], dtype=float)
        whole = good + bad
        mean, var = n * good / whole, n * (good / whole) * (bad / whole) * (whole - n) / max(whole - 1, 1)
        assert xs.min() >= max(0, n - bad) and xs.max() <= min(n, good)
        assert abs(xs.mean() - mean) <= 5 * (var / 400) ** 0.5 + 1e-9 * mean and (var == 0 or 0.7 < xs.var() / var < 1.4 or var < 2)


def test_groups_share_out_the_quotas():
    quota = np.array([0, 5, 1000, 70_000, 3], dtype=np.int64)
    size, groups = 4096, -(-int(quota.sum()) // 4096)
    found = [mixing.group_counts(quota, g, groups, size, 7) for g in range(groups)]
    assert (sum(here for here, _ in found) == quota).all()
    for g, (here, before) in enumerate(found):
        assert here.sum() == min(size, quota.sum() - g * size) and (before == sum([h for h, _ in found[:g]], np.zeros(5, np.int64))).all()
