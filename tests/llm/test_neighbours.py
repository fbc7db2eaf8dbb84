import numpy as np

from quillstack.llm import neighbours

SHAPE = "chunk_id string, embeddings array<float>, point string, vector string"


def exact(ids, x, k):
    x = x.astype(np.float64)
    c = np.round(x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None], 12)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-c[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def run(spark, ids, vectors, **kw):
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in zip(ids, vectors)], SHAPE)
    return {tuple(r) for r in neighbours.neighbour_pairs(df, **kw).collect()}


def test_recall_and_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([c + 0.15 * rng.normal(size=(12, 16)) for c in centres]).astype(np.float32)
    x = np.concatenate([x, x[:30], x[:30] * 2, np.repeat(x[5:6], 40, 0)])
    ids = [f"c{i:04d}" for i in rng.permutation(len(x))]
    got = run(spark, ids, x.tolist(), dimension=16, shard_rows=64)
    want = exact(ids, x, 5)
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9


def test_small_is_exact_and_unusable_ones_take_no_part(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    ids = [f"k{i}" for i in range(40)]
    rows = x.tolist()
    got = run(spark, ids + ["z", "s", "n", "e", "k0", "nan", None], rows + [[0.0] * 8, [1.0], None, [], rows[0], [float("nan")] * 8, rows[1]], dimension=8)
    assert got == exact(ids, x, 5)


def test_few_and_none(spark):
    assert run(spark, ["a", "b"], [[1.0, 0.0], [0.0, 1.0]], dimension=2) == {("a", "b")}
    assert run(spark, ["a"], [[1.0, 0.0]], dimension=2) == set()
    assert spark.createDataFrame([], SHAPE).count() == 0 and neighbours.neighbour_pairs(spark.createDataFrame([], SHAPE), dimension=2).count() == 0


def test_graph_round_trip():
    x = neighbours.unit(np.random.default_rng(1).normal(size=(300, 8)))
    g = neighbours.Graph.build(x)
    h = neighbours.Graph.unpack(*g.pack())
    a, b = g.search(x, 6), h.search(x, 6)
    assert (a[0] == b[0]).all()
    true = np.argsort(-(x @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(t) & set(f)) / 6 for t, f in zip(true, a[0])]) > 0.95


def test_recall_on_the_test_table(spark):
    chunks = spark.read.parquet("/root/testdata/sf0.01/chunks.parquet")
    usable = {}
    for r in chunks.select("chunk_id", "embeddings").collect():
        v = r["embeddings"]
        if v is not None and len(v) == 96 and any(v):
            usable[r["chunk_id"]] = v
    ids = sorted(usable)
    want = exact(ids, np.array([usable[i] for i in ids], np.float32), 5)
    for rows in (128, neighbours.SHARD_ROWS):
        got = {tuple(r) for r in neighbours.neighbour_pairs(chunks, shard_rows=rows).collect()}
        assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_rescaled_copies_go_by_id(spark):
    """Copies of one direction, by powers of two and by any factor, are ties that go by chunk_id."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 24)).astype(np.float32)
    powers = x[7] * np.float32(2.0) ** rng.integers(-6, 7, 30)[:, None].astype(np.float32)
    scaled = (x[8].astype(np.float64) * rng.uniform(0.1, 9.0, 30)[:, None]).astype(np.float32)
    every = np.concatenate([x, powers, scaled])
    ids = [f"c{i:04d}" for i in rng.permutation(len(every))]
    got, want = run(spark, ids, every.tolist(), dimension=24), exact(ids, every, 5)
    groups = [{ids[7], *ids[300:330]}, {ids[8], *ids[330:360]}]
    for g in groups:
        mine = lambda pairs: {p for p in pairs if p[0] in g and p[1] in g}  # noqa: B023, E731
        assert len(mine(got) & mine(want)) >= 0.99 * max(len(mine(got)), len(mine(want)))
    assert len(got & want) / len(want) > 0.97


def test_levels_of_pivots(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(20, 16)) for c in centres]).astype(np.float32)
    ids = [f"c{i:05d}" for i in rng.permutation(len(x))]
    want = exact(ids, x, 5)
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in zip(ids, x.tolist())], SHAPE)
    points = neighbours.usable(df, 16).select("point", "chunk_id", "vector").withColumnRenamed("chunk_id", "first")
    leaves = neighbours.dealt(points, 16, 24, 6, fan=6, sample_rows=500)
    assert leaves.count() == len(x) and leaves.selectExpr("leaves[0].leaf as l").distinct().count() > 6
    got = run(spark, ids, x.tolist(), dimension=16, shard_rows=24, fan=6, sample_rows=500)
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9
