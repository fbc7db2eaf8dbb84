"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Each pre-token goes through a backtracking encoder: an Aho-Corasick pass gives the longest token at every offset, and
a token is accepted if it may stand beside the one before it, i.e. if no merge across their border would have come
earlier than the merges inside them. The first full chain of accepted tokens is the chain plain BPE gives, so the
result is exact, in time linear in the text. Decoding gathers bytes from one blob through an offset table.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: the pre-tokenisation pattern the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered per worker; the memory is emptied when full, which changes no result.
REMEMBERED = 400_000
LONG_PRETOKEN = 256


class Encoder(dict):
    """Pre-token -> ids, computed on first use. ``ranks``: token bytes -> id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self._split = regex.compile(PATTERN).findall
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._ranks = ranks
        self._length = [len(t) for t in self.tokens]
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._automaton.add_word(token.decode("latin-1"), rank)
        self._automaton.make_automaton()
        self._shorter = [-1] * size  # the longest token that is a proper prefix
        for token, rank in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (found := ranks.get(token[:n])) is not None:
                    self._shorter[rank] = found
                    break
        self._pairs: dict[tuple[int, int], int] = {}
        self._halves: list[tuple[int, int]] = [(r, r) for r in range(size)]
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (halves := self._last_merge(token, rank)):
                self._halves[rank] = halves
                self._pairs[halves] = rank

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: plain BPE with the merges of lower rank only."""
        parts = [self._ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((m, i) for i in range(len(parts) - 1) if (m := self._pairs.get((parts[i], parts[i + 1]))) is not None and m < rank), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [best[0]]
        return (parts[0], parts[1])

    def compatible(self, left: int, right: int) -> bool:
        """Whether plain BPE can leave these two tokens side by side."""
        pairs, halves, bound = self._pairs, self._halves, len(self.tokens)
        while True:
            merged = pairs.get((left, right))
            if merged is not None and merged < bound:
                return False
            if left > right:  # the token made later is opened at the border
                bound, left = left, halves[left][1]
                if left == bound:
                    bound, right = right + 1, halves[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound, right = right + 1, halves[right][0]
                if right + 1 == bound:
                    bound, left = left, halves[left][1]
                    if left == bound:
                        return True

    def encode_bytes(self, data: bytes) -> array:
        whole = self._ranks.get(data)
        if whole is not None and len(data) < 2:
            return array("i", (whole,))
        n, length = len(data), self._length
        longest = array("i", bytes(4 * n))
        reach = array("i", bytes(4 * n))
        for end, rank in self._automaton.iter(data.decode("latin-1")):
            start = end + 1 - length[rank]
            if length[rank] > reach[start]:
                reach[start], longest[start] = length[rank], rank
        dead = bytearray(n + 1)
        chain: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if not dead[end] and (not chain or self.compatible(chain[-1], token)):
                chain.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            token = self._shorter[token]
            if token < 0:  # nothing fits here: step back and shorten the token before
                dead[at] = 1
                token = chain.pop()
                at -= length[token]
        return array("i", chain)

    def __missing__(self, pretoken: str) -> array:
        ids = self.encode_bytes(pretoken.encode("utf-8", "replace"))
        if len(pretoken) <= LONG_PRETOKEN:
            if len(self) >= REMEMBERED:
                self.clear()
            self[pretoken] = ids
        return ids

    def encode(self, text: str) -> array:
        out = array("i")
        extend = out.extend
        for pretoken in self._split(text):
            extend(self[pretoken])
        return out


class Decoder:
    """Ids -> bytes through one blob of all tokens and the offsets of each."""

    def __init__(self, tokens: list[bytes]):
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        total = int(size.sum())
        if not total:
            return ""
        first = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.blob[first + np.arange(total)].tobytes().decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Encoder:
    """One encoder per worker process, from the folder or, where an executor doesn't have it, from the file the driver sent."""
    path = f"{folder}/{name}.tiktoken"
    return Encoder(read_ranks(path if os.path.exists(path) else SparkFiles.get(f"{name}.tiktoken")))


def sent(docs: DataFrame, folder: str, name: str) -> DataFrame:
    """``docs``, with the vocabulary on its way to executors on other machines."""
    sc = docs.sparkSession.sparkContext
    if not sc.master.startswith("local") and os.path.exists(f"{folder}/{name}.tiktoken"):
        sc.addFile(f"{folder}/{name}.tiktoken")
    return docs


def encode_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``keep`` and ids (array<int>) of each row, without special tokens, in one map over the rows (no shuffle).

    A null text and an empty text give an empty list; a blank one is encoded as it is. The strings of special tokens
    are ordinary text. One output row per input row, repeated rows included; other columns are ignored.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode
        for part in parts:
            flat, ends = array("i"), [0]
            for value in part.column(part.schema.get_field_index("_text")):
                value = value.as_py()
                if value:
                    flat.extend(encode(value))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], ids], names=[*keep, "ids"])

    chosen = sent(docs, folder, name).select(*keep, F.col(text).alias("_text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return chosen.mapInArrow(batches, f"{shape}, ids array<int>")


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``keep`` and n_tokens (long) of each row; the ids never leave the worker."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode
        for part in parts:
            sizes = [len(encode(v)) if (v := value.as_py()) else 0 for value in part.column(part.schema.get_field_index("_text"))]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    chosen = sent(docs, folder, name).select(*keep, F.col(text).alias("_text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return chosen.mapInArrow(batches, f"{shape}, n_tokens bigint")


def decode_texts(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``keep`` and the text of each id list; bytes that are no UTF-8 become replacement characters."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(encoder(folder, name).tokens)
        for part in parts:
            texts = [decoder.decode(v.as_py() or []) for v in part.column(part.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, "text"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return sent(encoded, folder, name).select(*keep, "ids").mapInArrow(batches, f"{shape}, text string")
