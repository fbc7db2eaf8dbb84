"""Mixing sources to target weights.

Tokens of each source are packed into fixed-length blocks. The slots of every output shard get their numbers of
blocks per source from multinomial draws conditioned on each source's quota, made down a tree of ranges of shards; a slot's place in its source goes
through a pseudorandom permutation of the block numbers, one per repetition, and slots and blocks are joined by number.
Nothing but counts per source is known to the driver, so a source may be of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm import bpe
from quillstack.runtime import small_side, written

BLOCK_TOKENS = 256
SHARD_SLOTS = 1024
GROUP_SHARDS = 256
SEED = 20_260_101
BUCKET_DOCS = 20_000


def scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1 applied to ``index``: a four-round Feistel network, walked until inside."""
    half = max(1, math.ceil(math.log2(max(size, 2)) / 2))
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for r in range(4):
                left, right = right, left ^ (scramble(right, key * 4 + r) & mask)
            x[todo] = (left << np.uint64(half)) | right
            todo = todo[x[todo] >= size]
    return x.astype(np.int64)


def taken(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` drawn without replacement from ``good`` and ``bad`` are good (hypergeometric), for numbers of any size.

    Few draws are made one by one; many by the ratio-of-uniforms method of Stadlober (1989), in constant time.
    """
    whole = good + bad
    few = min(n, whole - n)  # drawing the others is the same
    if few <= 10:
        left, got = good, 0
        for i in range(few):
            hit = rng.random() * (whole - i) < left
            got, left = got + hit, left - hit
        return int(got if few == n else good - got)
    small, large = min(good, bad), max(good, bad)
    log = math.lgamma
    share = small / whole
    centre, width = few * share + 0.5, math.sqrt((whole - few) * few * share * (1 - share) / (whole - 1) + 0.5)
    spread = 2 * math.sqrt(2 / math.e) * width + 3 - 2 * math.sqrt(3 / math.e)
    mode = math.floor((few + 1) * (small + 1) / (whole + 2))
    weight = lambda k: log(k + 1) + log(small - k + 1) + log(few - k + 1) + log(large - few + k + 1)
    top, most = weight(mode), min(min(few, small) + 1, math.floor(centre + 16 * width))
    while True:
        u, v = rng.random(), rng.random()
        x = centre + spread * (v - 0.5) / u if u else -1.0
        if 0 <= x < most and 2 * math.log(u) <= top - weight(math.floor(x)):
            k = math.floor(x)
            break
    if good > bad:
        k = few - k
    return int(k if few == n else good - k)


def drawn(rest: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` slots go to each source: a multinomial draw conditioned on the ``rest`` each still has to give."""
    out = np.zeros_like(rest)
    whole = int(rest.sum())
    for s in range(len(rest)):
        good = int(rest[s])
        k = taken(good, whole - good, n, rng) if n and good else 0
        out[s], n, whole = k, n - k, whole - good
    return out


def group_counts(quota: np.ndarray, group: int, groups: int, group_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in a group, slots of each source in the groups before it).

    The slots of a range of groups are divided between its halves by one draw, seeded by the range, down to the single
    group: every task finds its own counts from the quotas alone, and all agree.
    """
    here, before, low, high = quota.copy(), np.zeros_like(quota), 0, groups
    while high - low > 1:
        middle = (low + high) // 2
        left = drawn(here, (middle - low) * group_slots, np.random.default_rng((seed, 1, low, high)))
        if group < middle:
            here, high = left, middle
        else:
            here, before, low = here - left, before + left, middle
    return here, before


def packed(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, block, n_tokens, parts) from (doc_id, source, n_tokens): each source's documents end to end, cut every ``block_tokens``.

    ``parts`` lists (doc_id, token_from, token_to), to exclusive. Running sums are taken within hash buckets of a
    source and shifted by the buckets before, so no source is ever sorted in one task.
    """
    n = docs.count()
    buckets = max(1, math.ceil(n / BUCKET_DOCS))
    docs = docs.where(F.col("n_tokens") > 0).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size"))
    before = sums.withColumn("shift", F.sum("size").over(W.partitionBy("source").orderBy("bucket")) - F.col("size")).drop("size")
    inside = F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = docs.withColumn("inside", inside).join(before, ["source", "bucket"]).withColumn("start", F.col("inside") + F.col("shift"))
    size = F.lit(block_tokens)
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n_tokens") - 1) / size))))
    first = F.greatest(F.lit(0), F.col("block") * size - F.col("start"))
    last = F.least(F.col("n_tokens"), (F.col("block") + 1) * size - F.col("start"))
    parts = cut.select("source", "block", F.struct(F.col("start"), F.col("doc_id"), first.alias("token_from"), last.alias("token_to")).alias("part"))
    grouped = parts.groupBy("source", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum(F.col("part.token_to") - F.col("part.token_from")).alias("n_tokens"))
    return grouped.select("source", "block", "n_tokens", F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["token_from"].alias("token_from"), p["token_to"].alias("token_to"))).alias("parts"))


def quotas(targets: list, tokens: dict[str, int], total_tokens: int | None, block_tokens: int) -> list[tuple[str, int, int]]:
    """(source, blocks it has, slots it fills). Without a total, the largest one that every source with documents can serve its share of."""
    live = [(t["source"], float(t["target_share"]), 1 if t["max_repeats"] is None else int(t["max_repeats"])) for t in targets if t["source"] is not None and (t["target_share"] or 0) > 0]
    live = [(s, share, repeats) for s, share, repeats in live if tokens.get(s, 0) > 0 and repeats > 0]
    if not live:
        return []
    scale = sum(share for _, share, _ in live)
    total = total_tokens if total_tokens is not None else min(repeats * tokens[s] / (share / scale) for s, share, repeats in live)
    out = []
    for s, share, repeats in live:
        blocks = math.ceil(tokens[s] / block_tokens)
        mean = tokens[s] / blocks
        out.append((s, blocks, min(repeats * blocks, round(total * share / scale / mean))))
    return out


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, folder: str = bpe.TOKENIZERS, name: str = bpe.VOCABULARY) -> DataFrame:
    """The mixed corpus as slots: shard, slot, source, repetition (from 1), block, n_tokens, parts.

    Each source fills its target share of the tokens; no block, and so no token of a document, is used more than
    ``max_repeats`` times (null: once). Sources without documents can give nothing: the others keep their
    proportions. Documents without a target or source, and null and empty texts, take no part. Without any source
    to draw from the result is empty.
    """
    spark = documents.sparkSession
    wanted = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]).collect()  # one row per source
    named = small_side(targets.where(F.col("source").isNotNull()).select("source").distinct())
    chosen = documents.select("doc_id", "source", "text").join(named, "source", "left_semi")
    sized = written(bpe.count_tokens(chosen, "text", ("doc_id", "source"), folder, name), "sizes")
    tokens = {r["source"]: int(r["n"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per source
    plan = quotas(wanted, tokens, total_tokens, block_tokens)
    slots = sum(n for _, _, n in plan)
    shape = "shard bigint, slot int, source string, repetition int, block bigint"
    if not slots:
        return spark.createDataFrame([], shape + ", n_tokens bigint, parts array<struct<doc_id:bigint,token_from:bigint,token_to:bigint>>")
    names, blocks, quota = [p[0] for p in plan], [p[1] for p in plan], np.array([p[2] for p in plan], dtype=np.int64)
    group_slots = shard_slots * GROUP_SHARDS
    groups = math.ceil(slots / group_slots)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch["id"]:
                left, at = group_counts(quota, int(g), groups, group_slots, seed)
                shard = int(g) * GROUP_SHARDS
                while left.sum():
                    rng = np.random.default_rng((seed, 2, shard))
                    n = drawn(left, int(min(shard_slots, left.sum())), rng)
                    who = rng.permutation(np.repeat(np.arange(len(n)), n))
                    repetition, block = np.empty(len(who), np.int64), np.empty(len(who), np.int64)
                    for s in np.flatnonzero(n):
                        place = at[s] + np.arange(n[s])
                        turn = place // blocks[s]
                        found = np.empty(len(place), np.int64)
                        for t in np.unique(turn):
                            found[turn == t] = permuted(place[turn == t] % blocks[s], blocks[s], seed + 7919 * int(s) + 104_729 * int(t))
                        repetition[who == s], block[who == s] = turn + 1, found
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(len(who)), "source": [names[s] for s in who], "repetition": repetition, "block": block})
                    left, at, shard = left - n, at + n, shard + 1

    placed = spark.range(0, groups, 1, min(groups, 10_000)).mapInPandas(fill, shape)
    # both sides grow with the corpus, so neither is broadcast
    return placed.join(packed(sized, block_tokens).hint("merge"), ["source", "block"]).select("shard", "slot", "source", "repetition", "block", "n_tokens", "parts")


def tokens_of(mixed: DataFrame, documents: DataFrame, folder: str = bpe.TOKENIZERS, name: str = bpe.VOCABULARY) -> DataFrame:
    """(shard, slot, ids): the token ids of every slot. Each document is encoded once and cut to the parts that blocks need.

    A block is assembled once, however often it is used; slots then join it by number. Documents of no block are not encoded.
    """
    used = mixed.select("source", "block", "parts").dropDuplicates(["source", "block"])
    parts = used.select("source", "block", F.posexplode("parts").alias("n", "p")).select("source", "block", "n", "p.*")
    needed = documents.join(parts.select("doc_id").distinct(), "doc_id", "left_semi")
    encoded = bpe.encode_texts(needed, "text", ("doc_id",), folder, name)
    cut = parts.join(encoded.hint("merge"), "doc_id").select("source", "block", "n", F.slice("ids", F.col("token_from").cast("int") + 1, (F.col("token_to") - F.col("token_from")).cast("int")).alias("ids"))
    whole = cut.groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("ids"))
    return mixed.select("shard", "slot", "source", "block").join(whole.hint("merge"), ["source", "block"]).select("shard", "slot", "ids")


def mixed_corpus(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: the slots of ``mix`` with the token ids of each."""
    mixed = written(mix(documents, targets, **options), "mix")
    return mixed.join(tokens_of(mixed, documents).hint("merge"), ["shard", "slot"]).select("shard", "slot", "source", "repetition", "block", "n_tokens", "ids")


def used_shares(mixed: DataFrame, documents: DataFrame, targets: DataFrame, folder: str = bpe.TOKENIZERS, name: str = bpe.VOCABULARY) -> DataFrame:
    """``shares`` with corpus_tokens (all tokens of the source) and used_share (how much of them is in the mix at least once).

    The source whose used_share is 1 and that is repeated as often as it may be sets the size of the mix.
    """
    mixed = written(mixed, "mix")
    named = targets.where(F.col("source").isNotNull()).select("source").distinct()
    sized = bpe.count_tokens(documents.select("doc_id", "source", "text").join(small_side(named), "source", "left_semi"), "text", ("doc_id", "source"), folder, name)
    has = sized.groupBy("source").agg(F.sum("n_tokens").alias("corpus_tokens"))
    used = mixed.dropDuplicates(["source", "block"]).groupBy("source").agg(F.sum("n_tokens").alias("used"))
    rows = shares(mixed, targets).join(has, "source", "left").join(used, "source", "left")
    corpus = F.coalesce("corpus_tokens", F.lit(0))
    return rows.withColumn("corpus_tokens", corpus).withColumn("used_share", F.when(F.col("corpus_tokens") > 0, F.coalesce("used", F.lit(0)) / F.col("corpus_tokens")).otherwise(0.0)).drop("used")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, reached_share, most_uses (of one block); a source that gives nothing has 0."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("repetition").alias("most_uses"))
    all_ = targets.where(F.col("source").isNotNull()).select("source", "target_share").dropDuplicates(["source"]).join(got, "source", "left")
    total = got.agg(F.sum("tokens").alias("total"))
    share = F.when(F.col("total") > 0, F.coalesce("tokens", F.lit(0)) / F.col("total")).otherwise(0.0)
    return all_.join(F.broadcast(total), F.lit(True), "left").select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), share.alias("reached_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
