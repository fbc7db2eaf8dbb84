"""Subject areas of documents.

A document is read as units (sentences, list entries, table rows). Its words are weighted by inverse document
frequency, words are embedded by a truncated singular value decomposition of the weighted document-word matrix of
their language (block power iteration over the whole corpus), and units are assigned to the subject with the most
similar centroid. Centroids start from the labelled examples and are refined on the corpus, together with the weight
of each word: how much the documents it stands in lean to few subjects. A document gets every subject that at least a
quarter of its units deal with; a word shared by subjects is decided by the rest of the document.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.runtime import written

# Function words by which the language of a text is told.
FUNCTION_WORDS = {
    "en": "the of and is was that with for by this from which are were",
    "de": "der die das und ist wird nicht dass von im noch als den zu",
    "fr": "le la les des est une dans et que du pour l d par sur",
    "es": "el la los las en que del se una por y de para",
}
LANGUAGES = tuple(FUNCTION_WORDS)
SHARE = 0.25  # of the units a subject must have
RANK, EXTRA, POWER_ROUNDS = 16, 16, 3
REFINE_ROUNDS = 3
LEAST_DOCS, LEAST_SHARE = 5, 0.0005  # a word counts from so many documents, and so large a share, of its language
MOST_SHARE, MOST_ADDED = 0.8, 10  # words in a larger share of the documents, and as many more, tell nothing about subjects
DENSE_CELLS = 2_000_000  # cells of the dense blocks in which documents meet words
EXAMPLE_ROWS = 20_000  # documented bound of labelled rows that seed the centroids
LEAN = 0.15  # least leaning of a word that says anything
SURE = 0.5  # least length of a unit's weighted vector to deal with something
LEAST_IDF = 1.5  # a word that leans to a subject counts at least so much, however common it is
MARGIN = 0.02  # by which a unit's subject must lead
CONTEXT = 0.5  # say of the document in a unit's subject
BLOCK_WORDS = 2048

WORD = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]+)*|[^\W\d_]")
ENTRY = re.compile(r"(?:[-*•–]|\d{1,4}[.)]|\[\d+\]|\([a-z0-9]{1,3}\)|[A-Z][a-zé]+\.? \d+[.:])\s+\S")
SENTENCE = re.compile(r"(?<=[.!?。])[\"”’»)\]]*\s+(?=[\"“«(\[¿¡<]*[^\W\d_a-zà-ÿ])")
RULE = re.compile(r"\|[|\s:\-]+")


def units(text: str) -> list[str]:
    """Sentences, list entries and table rows of a text; headings and the head of a table are none of them."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[str] = []
    paragraph: list[str] = []
    entry = False

    def flush() -> None:
        nonlocal entry
        if not paragraph:
            return
        whole = " ".join(paragraph) if len(paragraph) > 1 else paragraph[0]
        paragraph.clear()
        if entry:
            out.append(whole)
            entry = False
            return
        carry = ""
        for part in SENTENCE.split(whole):
            if carry:
                part, carry = f"{carry} {part}", ""
            if part.count(" ") < 2:  # a number or abbreviation, no sentence
                carry = part
                continue
            out.append(part)
        if carry:
            if out:
                out[-1] += " " + carry
            else:
                out.append(carry)

    lines = text.split("\n")
    for i, line in enumerate(lines):
        line = line.strip()
        if not line or line[0] == "#":
            flush()
        elif line[0] == "|":
            flush()
            below = lines[i + 1].strip() if i + 1 < len(lines) else ""
            if not RULE.fullmatch(line) and not RULE.fullmatch(below):
                out.append(line)
        else:
            if ENTRY.match(line):
                flush()
                entry = True
            paragraph.append(line)
    flush()
    return out


class Coder(dict):
    """Word -> 31-bit number, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = zlib.crc32(word.encode("utf-8", "replace")) & 0x7FFFFFFF
        return n


CODE = Coder()
_FUNCTION = [frozenset(CODE[w] for w in words.split()) for words in FUNCTION_WORDS.values()]
_ALL_FUNCTION = frozenset().union(*_FUNCTION)


def read_text(text: str | None) -> tuple[int, list[list[int]]]:
    """(number of the language, distinct word numbers of each unit, without function words)."""
    score = [0] * len(LANGUAGES)
    coded = []
    if text:
        code, find = CODE.__getitem__, WORD.findall
        for unit in units(text):
            numbers = {*map(code, find(unit.lower()))}
            told = numbers & _ALL_FUNCTION
            if told:
                for i, own in enumerate(_FUNCTION):
                    score[i] += len(told & own)
                numbers -= told
            coded.append(list(numbers))
    return max(range(len(score)), key=score.__getitem__), coded


def flat_list(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def coded_documents(docs: DataFrame) -> DataFrame:
    """doc_id, language, words (numbers, unit after unit), sizes (words per unit), terms (distinct numbers of the document), times (units with each)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            languages, words, ends, sizes, unit_ends = [], array("i"), [0], array("i"), [0]
            for text in part.column(1):
                language, coded = read_text(text.as_py())
                languages.append(language)
                for numbers in coded:
                    words.extend(numbers)
                    sizes.append(len(numbers))
                ends.append(len(words))
                unit_ends.append(len(sizes))
            flat, ends = np.frombuffer(words, np.int32) if words else np.empty(0, np.int32), np.array(ends)
            doc = np.repeat(np.arange(len(languages), dtype=np.int64), np.diff(ends))
            pairs, times = np.unique(doc << 31 | flat, return_counts=True)
            term_ends = np.searchsorted(pairs >> 31, np.arange(len(languages) + 1))
            sizes = np.frombuffer(sizes, np.int32) if sizes else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(languages, pa.int8()), flat_list(flat, ends), flat_list(sizes, np.array(unit_ends)), flat_list(pairs & 0x7FFFFFFF, term_ends), flat_list(times, term_ends)],
                names=["doc_id", "language", "words", "sizes", "terms", "times"],
            )

    return docs.select("doc_id", "text").where(F.length("text") > 0).mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, language tinyint, words array<int>, sizes array<int>, terms array<int>, times array<int>")


def lists_of(part: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """(language, documents, (values, sizes) of each list column, row numbers) of the documents of each language in a batch."""
    language = part.column(part.schema.get_field_index("language")).to_numpy(zero_copy_only=False)
    for lang in np.unique(language):
        rows = np.flatnonzero(language == lang)
        lists = []
        for name in names:
            column = part.column(part.schema.get_field_index(name))
            if len(rows) < len(language):
                column = column.take(pa.array(rows))
            lists.append((column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())))
        yield int(lang), len(rows), lists, rows


class Places:
    """Places of words in a sorted vocabulary, -1 for others. The low bits of a number lead to its place; shared ones are searched."""

    BITS = 20

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        low = vocabulary & ((1 << self.BITS) - 1)
        self.table = np.zeros(1 << self.BITS, np.int32)
        self.table[low] = np.arange(len(vocabulary), dtype=np.int32)
        self.shared = np.zeros(1 << self.BITS, bool)
        self.shared[low[self.table[low] != np.arange(len(vocabulary))]] = True
        self.any_shared = bool(self.shared.any())

    def __call__(self, words: np.ndarray) -> np.ndarray:
        low = words & ((1 << self.BITS) - 1)
        at = self.table[low]
        if self.any_shared:
            again = np.flatnonzero(self.shared[low])
            at[again] = np.minimum(np.searchsorted(self.vocabulary, words[again]), len(self.vocabulary) - 1)
        at[self.vocabulary[at] != words] = -1
        return at


def blocks(doc: np.ndarray, at: np.ndarray, values: np.ndarray, docs: int, n_words: int) -> Iterator[tuple[slice, np.ndarray | slice, np.ndarray]]:
    """(documents, words, dense matrix of the values) in blocks of a bounded number of cells. ``doc`` is sorted, its pairs with ``at`` are unique.

    A small vocabulary is taken whole; of a large one only the words that occur in the block.
    """
    values = values.astype(np.float32)
    step, whole, first = 256, n_words * 256 <= DENSE_CELLS, 0
    while first < docs:
        last = min(docs, first + step)
        lo, hi = np.searchsorted(doc, (first, last))
        local, where = (slice(0, n_words), at[lo:hi]) if whole else np.unique(at[lo:hi], return_inverse=True)
        width = n_words if whole else len(local)
        if not whole and width * (last - first) > DENSE_CELLS and last - first > 1:
            step = max(1, (last - first) // 2)
            continue
        if hi > lo:
            dense = np.zeros((last - first, width), np.float32)
            dense[doc[lo:hi] - first, where] = values[lo:hi]
            yield slice(first, last), local, dense
        first = last


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def gathered(coded: DataFrame, columns: tuple[str, ...], work, widths: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """Sum over the corpus of one matrix per language. ``work(language, documents, lists, sum)`` adds a batch's part to it.

    Each task adds up its own parts and passes on the rows it touched, one table row each; these are summed row by row in
    the JVM as they arrive, so no place ever holds the parts of several tasks.
    """
    width = max(w for _, w in widths.values())
    names = [f"c{i}" for i in range(width)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for lang, docs, lists, _ in lists_of(part, columns):
                if lang in widths:
                    work(lang, docs, lists, total.setdefault(lang, np.zeros(widths[lang])))
        for lang, m in total.items():
            touched = np.flatnonzero((m != 0).any(axis=1))
            for at in range(0, len(touched), BLOCK_WORDS):
                rows = touched[at : at + BLOCK_WORDS]
                values = np.zeros((len(rows), width))
                values[:, : m.shape[1]] = m[rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), lang, np.int32)), pa.array(rows.astype(np.int32)), *[pa.array(c) for c in np.ascontiguousarray(values.T)]], names=["lang", "row", *names])

    parts_ = coded.select("language", *columns).mapInArrow(batches, ", ".join(["lang int", "row int", *[f"{c} double" for c in names]]))
    found = parts_.groupBy("lang", "row").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # vocabulary x rank at most
    lang, row = found["lang"].to_numpy(), found["row"].to_numpy()
    values = np.stack([found[c].to_numpy() for c in names], axis=1) if len(row) else np.zeros((0, width))
    out = {}
    for language, shape in widths.items():
        out[language] = np.zeros(shape)
        out[language][row[lang == language]] = values[lang == language][:, : shape[1]]
    return out


class Model:
    """Per language: vocabulary, word vectors, word weights and subject centroids."""

    def __init__(self) -> None:
        self.vocabulary: dict[int, np.ndarray] = {}
        self.idf: dict[int, np.ndarray] = {}
        self.vectors: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}
        self.centroids: dict[int, np.ndarray] = {}
        self._places: dict[int, Places] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": {}}  # built anew in each worker

    def places(self, lang: int, words: np.ndarray) -> np.ndarray:
        if lang not in self._places:
            self._places[lang] = Places(self.vocabulary[lang])
        return self._places[lang](words)

    def embed(self, lang: int, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Weighted sums of the word vectors of each unit."""
        weighted = (self.vectors[lang] * self.weights[lang][:, None]).astype(np.float32)
        at = self.places(lang, words)
        says = (at >= 0) & (self.weights[lang][at] > 0)
        unit = np.repeat(np.arange(len(sizes)), sizes)[says]
        out = np.zeros((len(sizes), weighted.shape[1]), np.float32)
        if len(unit):
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            out[unit[starts]] = np.add.reduceat(weighted[at[says]], starts, axis=0)
        return out


def fit(coded: DataFrame, examples: list[tuple[str, int]], n_subjects: int) -> Model:
    """Vocabulary, word vectors and refined centroids; every statistic is taken over all documents."""
    model = Model()
    totals = {int(r["language"]): int(r["n"]) for r in coded.groupBy("language").agg(F.count("*").alias("n")).collect()}  # one row per language

    def presence(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lang, _, lists, _ in lists_of(part, ("terms",)):
                words, n = np.unique(lists[0][0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), lang, np.int32)), pa.array(words.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])

    spread = coded.select("language", "terms").mapInArrow(presence, "lang int, word int, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    least = F.greatest(F.lit(float(LEAST_DOCS)), F.element_at(F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, n * LEAST_SHARE)]), F.col("lang"))) if totals else F.lit(0.0)
    kept = spread.where(F.col("n") >= least).collect() if totals else []  # at most (words per document) / LEAST_SHARE rows
    for lang in totals:
        own = sorted((r["word"], r["n"]) for r in kept if r["lang"] == lang and r["n"] <= MOST_SHARE * (totals[lang] + MOST_ADDED))
        if own:
            model.vocabulary[lang] = np.array([w for w, _ in own], dtype=np.int32)
            model.idf[lang] = np.log((totals[lang] + 1) / np.array([n for _, n in own], dtype=float))
    live = list(model.vocabulary)
    if not live:
        return model
    columns = RANK + EXTRA
    basis = {lang: np.linalg.qr(np.random.default_rng(5 + lang).standard_normal((len(model.vocabulary[lang]), columns)))[0] if len(model.vocabulary[lang]) >= columns else np.eye(len(model.vocabulary[lang])) for lang in live}

    def known(lang: int, docs: int, lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, places, times) of the terms in the vocabulary."""
        (terms, sizes), (times, _) = lists
        at = model.places(lang, terms)
        hit = at >= 0
        return np.repeat(np.arange(docs), sizes)[hit], at[hit], times[hit]

    def product(lang: int, docs: int, lists: list, total: np.ndarray) -> None:
        """Part of A'A Q, and in the last column of A'1, for the weighted rows A."""
        doc, at, times = known(lang, docs, lists)
        weight = np.log1p(times) * model.idf[lang][at]
        weight = weight / np.maximum(np.sqrt(np.bincount(doc, weight**2, docs))[doc], 1e-12)
        q = basis[lang].astype(np.float32)
        for _, local, a in blocks(doc, at, weight, docs, len(q)):
            total[local, :-1] += a.T @ (a @ q[local])
            total[local, -1] += a.sum(axis=0)

    for turn in range(POWER_ROUNDS):
        got = gathered(coded, ("terms", "times"), product, {lang: (len(basis[lang]), basis[lang].shape[1] + 1) for lang in live})
        for lang in live:
            y, mean = got[lang][:, :-1], got[lang][:, -1]
            y = y - np.outer(mean, mean @ basis[lang]) / max(1, totals[lang])
            if turn < POWER_ROUNDS - 1:
                basis[lang] = np.linalg.qr(y)[0]
            else:  # Rayleigh-Ritz
                small = basis[lang].T @ y
                values, turned = np.linalg.eigh((small + small.T) / 2)
                t = basis[lang] @ turned[:, np.argsort(-values)[:RANK]]
                model.vectors[lang] = t / (np.linalg.norm(t, axis=1, keepdims=True) + 0.02)
    model.weights = dict(model.idf)
    seeds: dict[int, np.ndarray] = {}
    read = [(read_text(text), subject) for text, subject in examples]
    for lang in live:
        sums = np.zeros((n_subjects, model.vectors[lang].shape[1]))
        for (language, coded_units), subject in read:
            if language == lang:
                words = np.array(sorted({w for u in coded_units for w in u}), dtype=np.int32)
                sums[subject] += unit_rows(model.embed(lang, words, np.array([len(words)])))[0]
        seeds[lang] = centred(unit_rows(sums))
    model.centroids = dict(seeds)
    for turn in range(REFINE_ROUNDS):

        def leaning(lang: int, docs: int, lists: list, total: np.ndarray) -> None:
            """Subjects of the documents each word stands in; below them the sums of each subject's units."""
            (words, n_words), (sizes, n_units) = lists[:2]
            e = model.embed(lang, words, sizes)
            length = np.linalg.norm(e, axis=1)
            e = unit_rows(e)
            near = e @ model.centroids[lang].T.astype(np.float32)
            best = near.argmax(axis=1)
            rows = np.arange(len(near))
            top = near[rows, best]
            near[rows, best] = -2
            clear = np.flatnonzero((top > 0.5) & (top - near.max(axis=1, initial=-2) > 0.15) & (length > (SURE if turn else 0)))
            unit_doc = np.repeat(np.arange(docs), n_units)
            n = len(model.vocabulary[lang])
            whole = np.bincount(unit_doc[clear] * n_subjects + best[clear], length[clear], docs * n_subjects).reshape(docs, n_subjects)
            whole = (whole / np.maximum(whole.sum(axis=1, keepdims=True), 1e-12)).astype(np.float32)
            doc, at, times = known(lang, docs, lists[2:])
            for rows_, local, a in blocks(doc, at, times, docs, n):
                total[local, :n_subjects] += a.T @ whole[rows_]
            for subject in range(n_subjects):
                mine = clear[best[clear] == subject]
                total[n + subject, : e.shape[1]] += e[mine].sum(axis=0)
                total[n + subject, -1] += len(mine)

        got = gathered(coded, ("words", "sizes", "terms", "times"), leaning, {lang: (len(model.vocabulary[lang]) + n_subjects, max(n_subjects, model.vectors[lang].shape[1]) + 1) for lang in live})
        for lang in live:
            n, rank = len(model.vocabulary[lang]), model.vectors[lang].shape[1]
            lean, sums, counts = got[lang][:n, :n_subjects], got[lang][n:, :rank], got[lang][n:, -1]
            prior = lean.sum(axis=0) / max(lean.sum(), 1e-12)
            p = lean / np.maximum(prior, 1e-12) / n_subjects
            p = (p + 1.0) / (p.sum(axis=1, keepdims=True) + n_subjects)
            lean = np.clip(1 + (p * np.log(p)).sum(axis=1) / math.log(max(n_subjects, 2)), 0, 1)
            model.weights[lang] = np.maximum(model.idf[lang], LEAST_IDF) * np.where(lean >= (LEAN if turn == REFINE_ROUNDS - 1 else 0), lean, 0)
            moved = np.where((counts > 5)[:, None], sums / np.maximum(counts, 1)[:, None] + 0.3 * seeds[lang], seeds[lang])
            model.centroids[lang] = centred(moved)
    return model


def centred(c: np.ndarray) -> np.ndarray:
    """Centroids without what all have in common, of length one; a subject without any keeps none."""
    has = np.linalg.norm(c, axis=1) > 0
    out = np.zeros_like(c)
    if has.any():
        out[has] = unit_rows(unit_rows(c[has]) - unit_rows(c[has]).mean(axis=0))
    return out


def assign(coded: DataFrame, model: Model, subjects: list[str], share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share) of each subject that at least ``share`` of a document's units deal with."""
    kind = coded.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lang, docs, ((words, _), (sizes, n_units)), rows in lists_of(part, ("words", "sizes")):
                if lang not in model.centroids:
                    continue
                e = model.embed(lang, words, sizes)
                unit_doc = np.repeat(np.arange(docs), n_units)
                sure = np.linalg.norm(e, axis=1) > SURE
                near = (unit_rows(e) @ model.centroids[lang].T.astype(np.float32))[sure]
                of = unit_doc[sure]
                whole = np.zeros((docs, len(subjects)), np.float32)
                if len(of):
                    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    whole[of[starts]] = np.add.reduceat(np.clip(near, 0, 1) ** 4, starts, axis=0)
                whole /= np.maximum(whole.sum(axis=1, keepdims=True), 1e-12)
                rated = near + CONTEXT * whole[of]
                best = rated.argmax(axis=1) if len(of) else np.empty(0, int)
                if len(of) and len(subjects) > 1:  # a word that subjects share, and nothing in the document to tell them apart, is no case
                    two = np.partition(rated, -2, axis=1)[:, -2:]
                    told = two[:, 1] - two[:, 0] > MARGIN
                    best, of = best[told], of[told]
                hits = np.bincount(of * len(subjects) + best, minlength=docs * len(subjects)).reshape(docs, len(subjects))
                part_of = hits / np.maximum(n_units, 1)[:, None]
                doc, subject = np.nonzero((part_of >= share) & (hits > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[doc])), pa.array([subjects[s] for s in subject], pa.string()), pa.array(part_of[doc, subject])], names=["doc_id", "subject", "share"])

    return coded.select("doc_id", "language", "words", "sizes").mapInArrow(batches, f"doc_id {kind}, subject string, share double")


def document_subjects(documents: DataFrame, subject_areas: DataFrame, subject_examples: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share): none, one or more subjects of each document.

    Null, empty and blank texts have no units and no row; equal texts under several ids each get their rows. The
    language is told from the text, never from a column. Without subjects, examples or documents the result is empty.
    """
    names = [r[0] for r in subject_areas.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]  # the list of subjects
    place = {s: i for i, s in enumerate(names)}
    rows = subject_examples.select("text", "subject").where("text is not null").limit(EXAMPLE_ROWS).collect()
    examples = [(r["text"], place[r["subject"]]) for r in rows if r["subject"] in place]
    coded = written(coded_documents(documents), "coded")
    if not names or not examples:
        return assign(coded, Model(), names, share)
    return assign(coded, fit(coded, examples, len(names)), names, share)
