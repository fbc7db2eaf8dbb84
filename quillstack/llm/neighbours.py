"""Most similar vectors for every vector: HNSW graphs per shard, stored as flat neighbour arrays, results merged.

Equal vectors are one point. Points are dealt to shards by their nearest pivot: k-means centres fitted on a bounded
sample, and where a pivot gathers too many points, centres of its own fitted on a sample of these, level by level, so
the work per point grows with the logarithm of their number. Every point is indexed. Each shard's graph is built once
and written down as flat arrays; each point asks the shards of its PROBES nearest pivots, and what either end of a pair
finds counts for both. Rescaled copies lie in one direction: of each direction only the first K + 1 ids can matter to
others, so no more of them enter the graphs, and every copy meets these first ids directly. Final cosines are computed
in double precision and ranked with ids as tie-break.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.runtime import bounded_sample, is_small, lookup_join, small_side, written

DIMENSION = 96
NEIGHBOURS = 5
SHARD_ROWS = 2048  # points a shard aims at
PROBES = 6  # pivots a point asks
FAN = 512  # pivots at most into which the points, or those of a crowded pivot, are parted at once
CROWDED = 8  # times SHARD_ROWS points of a pivot from which it is parted again
LEVELS = 6  # of pivots at most: what is crowded still can't be parted by its directions and is dealt by hash
PIVOT_SAMPLE = 20_000  # documented bound: points the pivots of a level, or of one crowded pivot, are fitted on
FINE, COARSE = 1e-6, 1e-4  # numbers of unit vectors that agree so far: one direction; met directly
BREADTH, AT_ONCE = 40, 4  # beam of the graph search; nodes of it looked into at a time
KEPT = 2  # times k + 1 hits of a point that are kept of all shards
LINKS, UPPER_LINKS, BACK_LINKS, CANDIDATES = 16, 10, 16, 40


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in single precision."""
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, as flat neighbour arrays per level."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.levels = vectors, levels  # level: (sorted node numbers, neighbours as node numbers)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Graph:
        n = len(vectors)
        height = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-300) / math.log(LINKS)).astype(int)
        levels = []
        for level in range(int(height.max(initial=0)) + 1):
            nodes = np.flatnonzero(height >= level).astype(np.int32)
            levels.append((nodes, nodes[cls._link(vectors[nodes], LINKS if level == 0 else UPPER_LINKS)]))
        return cls(vectors, levels)

    @staticmethod
    def _link(x: np.ndarray, width: int, block: int = 256) -> np.ndarray:
        """Neighbours of each row: diverse ones first, near ones to fill up, then links back; padded with the row itself."""
        n, k = len(x), min(CANDIDATES, len(x) - 1)
        out = np.repeat(np.arange(n, dtype=np.int32)[:, None], width + BACK_LINKS, axis=1)
        if k < 1:
            return out
        near_sims = np.empty((n, min(width, k)), np.float32)
        for a in range(0, n, block):
            sims = x[a : a + block] @ x.T
            rows = np.arange(len(sims))
            sims[rows, a + rows] = -np.inf
            cand = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            order = np.argsort(-np.take_along_axis(sims, cand, 1), axis=1, kind="stable")
            cand = np.take_along_axis(cand, order, 1)
            own = np.take_along_axis(sims, cand, 1)
            between = np.einsum("bkd,bjd->bkj", x[cand], x[cand], optimize=True)
            kept = np.zeros(cand.shape, bool)
            for j in range(k):  # keep a candidate nearer to the row than to all kept before it
                kept[:, j] = ~(kept & (between[:, j, :] > own[:, j, None])).any(axis=1)
            rank = np.argsort(~kept, axis=1, kind="stable")[:, : min(width, k)]
            out[a : a + block, : rank.shape[1]] = np.take_along_axis(cand, rank, 1)
            near_sims[a : a + block] = np.take_along_axis(own, rank, 1)
        src = np.repeat(np.arange(n), near_sims.shape[1])
        dst = out[:, : near_sims.shape[1]].ravel()
        order = np.lexsort((-near_sims.ravel(), dst))
        src, dst = src[order], dst[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        fits = place < BACK_LINKS
        out[dst[fits], width + place[fits]] = src[fits]
        return out

    def pack(self) -> tuple[bytes, bytes, list[int]]:
        sizes = [len(nodes) for nodes, _ in self.levels]
        flat = b"".join(nodes.tobytes() + links.astype(np.int32).tobytes() for nodes, links in self.levels)
        return self.vectors.tobytes(), flat, sizes

    @classmethod
    def unpack(cls, vectors: bytes, flat: bytes, sizes: list[int]) -> Graph:
        at, levels, all_ = 0, [], np.frombuffer(flat, np.int32)
        for level, n in enumerate(sizes):
            width = (LINKS if level == 0 else UPPER_LINKS) + BACK_LINKS
            levels.append((all_[at : at + n], all_[at + n : at + n + n * width].reshape(n, width)))
            at += n + n * width
        return cls(np.frombuffer(vectors, np.float32).reshape(sizes[0], -1), levels)

    def search(self, queries: np.ndarray, k: int, breadth: int = BREADTH, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of about the k nearest nodes of each query; -1 where the shard has fewer."""
        parts = [self._search(queries[a : a + block], k, breadth) for a in range(0, len(queries), block)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, k: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        b, x = len(q), self.vectors
        top_nodes = self.levels[-1][0]
        first = q @ x[top_nodes[:64]].T
        at = top_nodes[np.argmax(first, axis=1)]
        best = first.max(axis=1)
        for nodes, links in self.levels[:0:-1]:
            moving = np.arange(b)
            while len(moving):
                near = links[np.searchsorted(nodes, at[moving])]
                sims = np.einsum("bmd,bd->bm", x[near], q[moving])
                j = np.argmax(sims, axis=1)
                rows = np.arange(len(moving))
                better = sims[rows, j] > best[moving]
                moving = moving[better]
                at[moving], best[moving] = near[rows, j][better], sims[rows, j][better]
        links = self.levels[0][1]
        beam = np.zeros((b, breadth), np.int32)
        score = np.full((b, breadth), -np.inf, np.float32)
        open_ = np.zeros((b, breadth), bool)
        beam[:, 0], score[:, 0], open_[:, 0] = at, best, True
        met = np.zeros((b, len(x)), np.int16)  # 0 while a query has not met a node
        met[np.arange(b), at] = -1
        at_once = min(AT_ONCE, breadth)
        place = np.arange(1, at_once * links.shape[1] + 1, dtype=np.int16)
        live = np.arange(b)
        while len(live):
            waiting = np.where(open_[live], score[live], -np.inf)
            pick = np.argpartition(-waiting, at_once - 1, axis=1)[:, :at_once]
            waits = np.take_along_axis(waiting, pick, 1) > -np.inf
            going = waits.any(axis=1)
            live, pick, waits = live[going], pick[going], waits[going]
            if not len(live):
                break
            rows = live[:, None]
            open_[rows, pick] = False
            from_ = beam[rows, pick]
            near = np.where(waits[:, :, None], links[from_], from_[:, :, None]).reshape(len(live), -1)
            r, c = np.nonzero(met[rows, near] == 0)
            met[live[r], near[r, c]] = place[c]
            once = met[live[r], near[r, c]] == place[c]  # of a node met twice in one step one place counts
            r, c = r[once], c[once]
            sims = np.full(near.shape, -np.inf, np.float32)
            sims[r, c] = np.einsum("nd,nd->n", x[near[r, c]], q[live[r]])
            all_nodes = np.concatenate([beam[live], near], axis=1)
            all_scores = np.concatenate([score[live], sims], axis=1)
            all_open = np.concatenate([open_[live], sims > -np.inf], axis=1)
            keep = np.argpartition(-all_scores, breadth - 1, axis=1)[:, :breadth]
            beam[live] = np.take_along_axis(all_nodes, keep, 1)
            score[live] = np.take_along_axis(all_scores, keep, 1)
            open_[live] = np.take_along_axis(all_open, keep, 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        nodes, sims = np.take_along_axis(beam, order, 1), np.take_along_axis(score, order, 1)
        return np.where(sims > -np.inf, nodes, -1), sims


def direction_keys(flat: np.ndarray) -> np.ndarray:
    """Three numbers for each vector: of its direction, and of the coarse cells of two shifted grids it lies in."""
    x = flat.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grids = (np.rint(x / FINE), np.floor(x / COARSE), np.floor(x / COARSE + 0.5))
    key = lambda row: int.from_bytes(hashlib.blake2b(row.tobytes(), digest_size=8).digest(), "big", signed=True)
    return np.array([[key(row) for row in g.astype(np.int32)] for g in grids], dtype=np.int64).reshape(3, len(flat))


def usable(chunks: DataFrame, dimension: int) -> DataFrame:
    """chunk_id, point (digest of the vector), vector (raw floats), direction, near_a, near_b of each usable row; null, short, zero and non-finite vectors take no part."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, vectors = part.column(0), part.column(1)
            flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dimension) + np.float32(0)
            good = np.isfinite(flat).all(axis=1) & (np.abs(flat).max(axis=1, initial=0) > 0)
            flat = flat[good]
            raw = [r.tobytes() for r in flat]
            points = pa.array([hashlib.blake2b(r, digest_size=12).digest() for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), points, pa.array(raw, pa.binary()), *map(pa.array, direction_keys(flat))], names=["chunk_id", "point", "vector", "direction", "near_a", "near_b"])

    whole = chunks.select("chunk_id", "embeddings").where(F.col("chunk_id").isNotNull() & (F.size("embeddings") == dimension) & ~F.exists("embeddings", lambda v: v.isNull()))
    return whole.mapInArrow(batches, "chunk_id string, point binary, vector binary, direction bigint, near_a bigint, near_b bigint")


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres).astype(np.float32)
    return centres


def raw(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dimension)


def in_blocks(asking: DataFrame, told: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``block``: of each key's rows of ``asking`` about ``rows`` to a block, the one row of ``told`` in every block."""
    loads = small_side(written(asking.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks")), "loads"), 100_000)
    cut = asking.join(loads, keys).withColumn("block", F.pmod(F.xxhash64("point", F.lit(3)), F.col("blocks")).cast("int")).drop("blocks")
    return cut, told.join(loads, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


LEAVES = "array<struct<away:float,leaf:bigint>>"


def dealt(nodes: DataFrame, dimension: int, shard_rows: int, probes: int, fan: int = FAN, sample_rows: int = PIVOT_SAMPLE) -> DataFrame:
    """``nodes`` (point, first, vector) with ``leaves``: the nearest pivots of each, the home of the point first."""
    total = nodes.count()
    sample = bounded_sample(nodes.select("point", "vector"), sample_rows, "point").select("vector").collect()  # bounded by sample_rows
    pivots = fit_pivots(unit(np.frombuffer(b"".join(bytes(r[0]) for r in sample), np.float32).reshape(-1, dimension)), max(1, min(fan, math.ceil(total / shard_rows))))

    def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = unit(x) @ centres.T
        order = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
        return order, 1 - np.take_along_axis(sims, order, 1)

    def first_level(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            order, away = nearest(raw(part.column(2), dimension), pivots)
            pairs = pa.StructArray.from_arrays([pa.array(away.ravel(), pa.float32()), pa.array(order.ravel() + 1, pa.int64())], names=["away", "leaf"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)), pairs)], names=["point", "first", "vector", "leaves"])

    routed = written(nodes.select("point", "first", "vector").mapInArrow(first_level, f"point binary, first string, vector binary, leaves {LEAVES}"), "routed")
    home = F.col("leaves")[0]["leaf"]
    for _ in range(LEVELS - 1):
        crowded = routed.groupBy(home.alias("leaf")).agg(F.count("*").alias("n")).where(F.col("n") > CROWDED * shard_rows)
        crowded = written(crowded, "crowded")
        if crowded.isEmpty():
            break
        grain = 1 << 30
        share = F.least(F.lit(grain), (F.lit(grain) * (sample_rows / F.col("n"))).cast("bigint"))
        drawn = routed.select("point", "vector", home.alias("leaf")).join(small_side(crowded), "leaf").where(F.pmod(F.xxhash64("point", F.lit(29)), F.lit(grain)) < share)

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("point")
            centres = fit_pivots(unit(np.frombuffer(b"".join(pdf["vector"]), np.float32).reshape(-1, dimension)), max(2, min(fan, math.ceil(int(pdf["n"].iloc[0]) / shard_rows))))
            return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "centres": [centres.astype(np.float32).tobytes()]})

        centres = written(drawn.groupBy("leaf").applyInPandas(part, "leaf bigint, centres binary"), "centres")
        each = routed.select("point", "first", "vector", F.explode("leaves").alias("x")).select("point", "first", "vector", "x.away", "x.leaf")
        again = each.join(small_side(crowded.select("leaf")), "leaf", "left_semi")
        cut, told = in_blocks(again, centres, ["leaf"], 4 * shard_rows)

        def below(key, asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(asking) or not len(own):
                return pd.DataFrame({"point": [], "first": [], "vector": [], "away": [], "leaf": []}).astype({"away": "float32", "leaf": "int64"})
            x = np.frombuffer(b"".join(asking["vector"]), np.float32).reshape(-1, dimension)
            order, away = nearest(x, np.frombuffer(own["centres"].iloc[0], np.float32).reshape(-1, dimension))
            who = np.repeat(np.arange(len(x)), order.shape[1])
            return pd.DataFrame({"point": asking["point"].to_numpy()[who], "first": asking["first"].to_numpy()[who], "vector": asking["vector"].to_numpy()[who], "away": away.ravel(), "leaf": int(key[0]) * (fan + 1) + 1 + order.ravel()})

        deeper = cut.groupBy("leaf", "block").cogroup(told.groupBy("leaf", "block")).applyInPandas(below, "point binary, first string, vector binary, away float, leaf bigint")
        kept = each.join(small_side(crowded.select("leaf")), "leaf", "left_anti").select("point", "first", "vector", "away", "leaf")
        leaves = F.slice(F.array_sort(F.collect_list(F.struct("away", "leaf"))), 1, probes).alias("leaves")
        routed = written(kept.unionByName(deeper).groupBy("point").agg(F.min("first").alias("first"), F.min("vector").alias("vector"), leaves), "routed")
    return routed


HITS = "point binary, first string, other binary, other_first string, cosine double"


def twins(points: DataFrame, k: int, dimension: int) -> DataFrame:
    """Hits of each point among the k + 1 first ids of its direction and of the coarse cells it lies in."""
    cell = F.explode(F.array(*[F.xxhash64(F.lit(n), F.col(c)) for n, c in enumerate(("direction", "near_a", "near_b"))])).alias("cell")
    cells = points.select("point", "first", cell)
    shared = written(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "shared")
    if shared.isEmpty():
        return points.sparkSession.createDataFrame([], HITS)
    mine = written(cells.join(F.broadcast(shared) if is_small(shared) else shared, "cell", "left_semi"), "mine")
    chiefs = mine.withColumn("n", F.row_number().over(W.partitionBy("cell").orderBy("first"))).where(F.col("n") <= k + 1).select("cell", "point")
    chiefs = chiefs.join(points.select("point", "first", "vector"), "point").groupBy("cell").agg(F.collect_list(F.struct("point", "first", "vector")).alias("chiefs"))
    asking = written(mine.select("cell", "point").join(points.select("point", "first", "vector"), "point"), "asking")
    both = lookup_join(asking, chiefs, "cell", "inner").select("point", "first", "vector", F.explode("chiefs").alias("c")).where(F.col("point") != F.col("c.point")).select("point", "first", "vector", F.col("c.point").alias("other"), F.col("c.first").alias("other_first"), F.col("c.vector").alias("other_vector"))

    def rate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = (raw(part.column(i), dimension).astype(np.float64) for i in (2, 5))
            cosine = np.einsum("nd,nd->n", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), part.column(4), pa.array(np.round(cosine, 12))], names=["point", "first", "other", "other_first", "cosine"])

    return both.mapInArrow(rate, HITS)


def top_neighbours(chunks: DataFrame, k: int = NEIGHBOURS, dimension: int = DIMENSION, shard_rows: int = SHARD_ROWS, probes: int = PROBES, fan: int = FAN, sample_rows: int = PIVOT_SAMPLE) -> DataFrame:
    """(chunk_id, rank, neighbour, cosine): the k other chunks most similar to each, up to the recall of the search.

    Equal cosines (to 12 decimals) go by the smaller neighbour id, among rescaled copies too. A repeated chunk_id counts
    once, with its smallest vector if they differ. Fewer than k others give fewer rows; no usable vector gives none.
    Other columns are ignored. Of more than k + 1 vectors that agree to FINE in every number of their direction only
    those with the smallest ids are neighbours of vectors elsewhere.
    """
    spark = chunks.sparkSession
    own = ("point", "vector", "direction", "near_a", "near_b")
    rows = written(usable(chunks, dimension).groupBy("chunk_id").agg(F.min(F.struct(*own)).alias("p")).select("chunk_id", *[f"p.{c}" for c in own]), "vectors")
    # at most k + 1 ids of equal vectors can matter as neighbours; the limit is applied before the shuffle
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("point").orderBy("chunk_id"))).where(F.col("n") <= k + 1)
    points = written(first.groupBy("point").agg(F.array_sort(F.collect_list("chunk_id")).alias("members"), F.min("chunk_id").alias("first"), *[F.min(c).alias(c) for c in own[1:]]), "points")
    if points.isEmpty():
        return spark.createDataFrame([], "chunk_id string, rank int, neighbour string, cosine double")
    of_direction = F.row_number().over(W.partitionBy("direction").orderBy("first"))
    nodes = written(points.select("point", "first", "vector", "direction").withColumn("n", of_direction).where(F.col("n") <= k + 1).select("point", "first", "vector"), "nodes")
    routed = dealt(nodes, dimension, shard_rows, probes, fan, sample_rows)
    # a leaf that is crowded still is dealt to several shards by hash
    homes = routed.select("point", "first", "vector", F.col("leaves")[0]["leaf"].alias("leaf"))
    parts_of = homes.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("parts"))
    parts_of = small_side(written(parts_of, "parts"), 100_000)
    homes = homes.join(parts_of, "leaf").select("point", "first", "vector", "leaf", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int").alias("part"))

    def build(key, pdf):
        pdf = pdf.sort_values(["first", "point"], kind="stable")  # so the smaller node is the smaller id
        graph = Graph.build(unit(np.frombuffer(b"".join(pdf["vector"]), np.float32).reshape(-1, dimension)))
        vectors, links, sizes = graph.pack()
        return pd.DataFrame({"leaf": [key[0]], "part": [key[1]], "points": [pdf["point"].tolist()], "firsts": [pdf["first"].tolist()], "raw": [b"".join(pdf["vector"])], "vectors": [vectors], "links": [links], "sizes": [sizes]})

    shape = "leaf bigint, part int, points array<binary>, firsts array<string>, raw binary, vectors binary, links binary, sizes array<int>"
    shards = written(homes.groupBy("leaf", "part").applyInPandas(build, shape), "shards")
    # every point asks all shards of its leaves; questions to one shard are cut into blocks of bounded size
    wanted = routed.select("point", "first", "vector", F.explode("leaves").alias("x")).select("point", "first", "vector", "x.leaf").join(parts_of, "leaf")
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asking, sent = in_blocks(wanted, shards, ["leaf", "part"], 4 * shard_rows)

    def ask(key, asking, shard):
        if not len(asking) or not len(shard):
            return pd.DataFrame({"point": [], "first": [], "other": [], "other_first": [], "cosine": []}).astype({c: object for c in ("point", "first", "other", "other_first")} | {"cosine": float})
        s = shard.iloc[0]
        graph = Graph.unpack(s["vectors"], s["links"], list(s["sizes"]))
        names, firsts = (np.fromiter(s[c], dtype=object, count=len(s[c])) for c in ("points", "firsts"))
        doubles = np.frombuffer(s["raw"], np.float32).reshape(-1, dimension).astype(np.float64)
        doubles /= np.linalg.norm(doubles, axis=1, keepdims=True)
        mine = np.frombuffer(b"".join(asking["vector"]), np.float32).reshape(-1, dimension)
        nodes, _ = graph.search(unit(mine), 2 * (k + 2), max(BREADTH, 2 * (k + 2)))
        who, slot = np.nonzero(nodes >= 0)
        found = nodes[who, slot]
        a = mine.astype(np.float64)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        cosine = np.round(np.einsum("nd,nd->n", a[who], doubles[found]), 12)
        other = asking["point"].to_numpy()[who] != names[found]
        who, found, cosine = who[other], found[other], cosine[other]
        order = np.lexsort((found, -cosine, who))
        who, found, cosine = who[order], found[order], cosine[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) <= k  # the k + 1 best by cosine and id
        who, found, cosine = who[best], found[best], cosine[best]
        return pd.DataFrame({"point": asking["point"].to_numpy()[who], "first": asking["first"].to_numpy()[who], "other": names[found], "other_first": firsts[found], "cosine": cosine})

    hits = asking.groupBy("leaf", "part", "block").cogroup(sent.groupBy("leaf", "part", "block")).applyInPandas(ask, HITS)
    # a point's best hits serve it and, turned round, the points they hit; of a point met by very many only the best go on
    order = W.partitionBy("point").orderBy(F.desc("cosine"), "other_first")
    own_best = written(hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= KEPT * (k + 1)).drop("n"), "best")
    turned = own_best.select(F.col("other").alias("point"), F.col("other_first").alias("first"), F.col("point").alias("other"), F.col("first").alias("other_first"), "cosine")
    both = own_best.unionByName(turned).unionByName(twins(points, k, dimension)).groupBy("point", "other", "other_first").agg(F.max("cosine").alias("cosine"))
    near = written(both.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"), "near")
    # own copies count with cosine 1; a point's k + 1 best serve all its copies
    theirs = lookup_join(near.select("point", "other", "cosine"), points.select(F.col("point").alias("other"), "members"), "other", "inner").select("point", "cosine", F.explode("members").alias("neighbour"))
    own = points.select("point", F.lit(1.0).alias("cosine"), F.explode("members").alias("neighbour"))
    best = theirs.unionByName(own).withColumn("n", F.row_number().over(W.partitionBy("point").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("n") <= k + 1)
    best = best.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("n", "neighbour", "cosine"))).alias("best"))
    answer = lookup_join(rows.select("chunk_id", "point"), best, "point", "inner")
    others = F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("chunk_id")), 1, k)
    return answer.select("chunk_id", F.posexplode(others).alias("rank", "x")).select("chunk_id", (F.col("rank") + 1).alias("rank"), "x.neighbour", "x.cosine")


def neighbour_pairs(chunks: DataFrame, **options) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b, of which at least one is among the other's k most similar."""
    top = top_neighbours(chunks, **options)
    return top.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()
