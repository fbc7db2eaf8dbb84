"""Repair of text from scanned pages.

Lines at the head and foot of a page are candidates for furniture; a boosted classifier over pairs of neighbouring
lines tells running heads and page numbers from text. Divided words are found by a classifier over the line and the
next line of text, which may stand on the next page. Misread words are rare words with a more frequent word within few
edits: candidates come from an inverted join on the rarest character bigrams, are verified with levenshtein, and a
boosted ranking over frequencies and known and learned confusions chooses the replacement.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.llm.boosting import BoostedTrees
from quillstack.runtime import is_small, lookup_join, written

ZONE = 3  # non-blank lines at either end of a page that may be furniture
LONGEST_LINE = 300  # no line of a printed page is longer; longer ones don't count as head or foot
EDITS, GRAM = 2, 2
OFTEN, EVEN = 20, 3  # a rare word is a likely misreading of a word so many times as frequent; of one hardly more frequent it is none
LEAST_ODD, LEAST_MET, ONE_WAY = 3, 10, 8  # words that teach a confusion, with an impossible character or of letters; times its reverse
ODD = r"(?:^\(|\p{L}[^\p{L}\-'’./&]+|^[^\p{L}\-'’./&])\p{L}|\p{L}[!|$(]"
OWN, LEAST_LONG, LEAST_RATIO, VERY_SURE = 8, 6, 30, 0.97  # of confusions never heard of: times of a word of its own, letters of the right word, times its frequency, probability
COMMON_SHARE = 0.0002  # words above this share of all words are never misreadings (at most 1 / share of them)
TRAINING_ROWS = 20_000  # documented bound of the labelled rows a classifier is fitted on
PAGES_PER_BUCKET = 512

# Characters read for each other, and pairs read for one character (in terms of the former). The pairs are
# applied in two orders, as "ii" and "ei" can overlap.
CONFUSED = (("0", "o"), ("1", "i"), ("!", "i"), ("|", "i"), ("l", "i"), ("5", "s"), ("$", "s"), ("9", "g"), ("q", "g"), ("(", "e"), ("c", "e"), ("ä", "a"), ("f", "t"), ("b", "h"), ("6", "h"), ("8", "h"), ("v", "y"), ("2", "z"))
PAIRS = (("ii", "u"), ("ei", "d"), ("rn", "m"), ("yy", "w"), ("ri", "n"))
PAIRS_TURNED = (("ei", "d"), ("ri", "n"), ("ii", "u"), ("rn", "m"), ("yy", "w"))
HYPHENS = "-­‐¬‑"
ROMAN = re.compile(r"(?=[mdclxvi])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
NUMBER = re.compile(r"^[^\w(\[]*[(\[]?[^\w]*(?:(p[a4ä]?[g9q]?[ec]?s?|pp|s|seite|página|pág)\s*\.?\s*)?([0-9lIiOo!Ss]{1,4}|[ivxlcdm]{1,8})(?:\s*(?:/|of|von|de)\s*([0-9lIiOo!Ss]{1,4}))?[^\w]*$", re.IGNORECASE)
DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "!": "1", "O": "0", "o": "0", "S": "5", "s": "5"})
JOINING = {"and", "or", "und", "oder", "et", "ou", "y", "o", "to", "bis"}
OUTER = " \t.,;:?)]}\"'’”»…"
WORD_CHARS = re.compile(r"[^\W\d_]")
ROOM_LEFT = 3  # characters by which a line may fall short of the width: misreadings change its length
WIDEST_PRINT = 120  # characters in the lines of a printed page
STANDING = re.compile(r"\d{1,2}(?:\.\d{1,2})*\.? [^\W\d_][^.!?;]{0,60}$")  # a numbered heading
CJK = re.compile(r"[⺀-鿿가-힯]")


def skeleton(text: str) -> str:
    """Text with all that may be read for each other made equal."""
    for wrong, right in CONFUSED + PAIRS:
        text = text.replace(wrong, right)
    return text


def skeleton_column(c: Column, pairs: tuple = PAIRS) -> Column:
    for wrong, right in CONFUSED + pairs:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def page_value(line: str) -> int | None:
    """The number of a line that holds nothing but a page number, in any style; also with misread digits."""
    m = NUMBER.match(line.strip())
    if not m:
        return None
    number = m.group(2)
    if ROMAN.fullmatch(number.lower()) and not re.fullmatch(r"[lI!1]{2,}|[0-9lIi!]*[0-9][0-9lIi!]*", number):
        values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
        total = 0
        digits = [values[ch] for ch in number.lower()]
        for a, b in zip(digits, [*digits[1:], 0]):
            total += -a if a < b else a
        return total
    plain = number.translate(DIGITS)
    return int(plain) if plain.isdigit() else None


def furniture_key(line: str) -> str:
    """A head or foot without the page number at its side, misreadings made equal; empty for lines without words."""
    s = re.sub(r"^\s*[\dlIiOo!Ss]{1,4}\s{2,}|\s{2,}[\dlIiOo!Ss]{1,4}\s*$|^\s*[ivxlc]{1,7}\s{2,}|\s{2,}[ivxlc]{1,7}\s*$", "", line.strip())
    s = skeleton(re.sub(r"\s+", " ", s.lower()).strip())
    return s if len(WORD_CHARS.findall(s)) >= 3 else ""


def bare(token: str) -> str:
    return token.lstrip("([{\"'“„«‘*_").rstrip(OUTER + "*_").removesuffix("'s").removesuffix("’s").lower()


def is_word(word: str) -> bool:
    return bool(WORD_CHARS.search(word)) and len(word) <= 40 and not CJK.search(word)


def line_words(lines: list[str]) -> Iterator[tuple[int, str, str]]:
    """(index of the line, token, word) without the two halves of words divided between lines."""
    after_hyphen = False
    for n, line in enumerate(lines):
        tokens = line.split()
        if not tokens:
            continue
        for i, token in enumerate(tokens):
            if after_hyphen and i == 0:
                continue
            if i == len(tokens) - 1 and len(token) > 1 and token[-1] in HYPHENS:
                continue
            word = bare(token)
            if word and is_word(word):
                yield n, token, word
        after_hyphen = len(tokens[-1]) > 1 and tokens[-1][-1] in HYPHENS and tokens[-1][-2].isalpha()


def training_rows(labelled: DataFrame, *keys: str) -> pd.DataFrame:
    """Up to about TRAINING_ROWS labelled rows, half of either label, chosen by hash, in an order that is always the same."""
    labelled = written(labelled, "labelled")
    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    grain, half = 1 << 30, TRAINING_ROWS // 2
    share = [int(grain * min(1.0, half / n[v])) if n.get(v) else 0 for v in (1.0, 0.0)]
    chosen = labelled.where(F.pmod(F.xxhash64(*keys), F.lit(grain)) < F.when(F.col("label") == 1, share[0]).otherwise(share[1]))
    return chosen.toPandas().sort_values([*keys, "label"], kind="stable").reset_index(drop=True)


ZONE_SHAPE = "page_id {0}, item_key string, page_num int, line_no int, place int, foot boolean, key string, value int, beside boolean, blank boolean, ends boolean, upper double, length double, word string, n long"


def read_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first and last ZONE non-blank lines of each page with what tells furniture from text; word -> n over all pages), in one pass.

    Each task counts its words before they are shuffled.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows, counts = [], Counter()
            for pid, key, num, text in zip(pdf["page_id"], pdf["item_key"], pdf["page_num"], pdf["markdown"]):
                lines = text.split("\n")
                counts.update(word for _, _, word in line_words(lines))
                full = [i for i, line in enumerate(lines) if line.strip() and len(line) <= LONGEST_LINE]
                if not full:
                    continue
                width = max(len(lines[i].strip()) for i in full)
                values = {i: page_value(lines[i]) if len(lines[i]) <= 40 else None for i in full[:ZONE] + full[-ZONE:]}
                numeric = re.compile(r"^[\d\s]+$")
                for rank, i in enumerate(full):
                    back = len(full) - 1 - rank
                    if rank >= ZONE and back >= ZONE:
                        continue
                    line = lines[i].strip()
                    near = [full[j] for j in (rank - 1, rank + 1) if 0 <= j < len(full) and abs(full[j] - i) == 1]
                    letters = [ch for ch in line if ch.isalpha()]
                    rows.append((
                        pid, key, num, i + 1, min(rank, back), back < rank, "" if line[0] in "#|" else furniture_key(line), values[i],
                        any(numeric.match(lines[j].strip()) is not None for j in near), all(abs(full[j] - i) > 1 for j in (rank - 1, rank + 1) if 0 <= j < len(full)),
                        line[-1] in ".;,:!?" and not line.endswith("al."), sum(ch.isupper() for ch in letters) / max(1, len(letters)), len(line) / max(1, width),
                    ))
            zone = pd.DataFrame(rows, columns=["page_id", "item_key", "page_num", "line_no", "place", "foot", "key", "value", "beside", "blank", "ends", "upper", "length"])
            yield pd.concat([zone.astype(object), pd.DataFrame({"word": list(counts), "n": list(counts.values())}, dtype=object)], ignore_index=True).astype({c: "Int64" for c in ("page_num", "line_no", "place", "value", "n")} | {c: "boolean" for c in ("foot", "beside", "blank", "ends")} | {c: "Float64" for c in ("upper", "length")})[names]

    shape = ZONE_SHAPE.format(pages.schema["page_id"].dataType.simpleString())
    names = [c.split()[0] for c in shape.split(", ")]
    both = written(pages.select("page_id", "item_key", "page_num", "markdown").mapInPandas(batches, shape), "read")
    return both.where("word is null").drop("word", "n"), both.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))


SHAPE = ("place", "foot", "blank", "ends", "upper", "length", "repeats", "share")


def furniture(pages: DataFrame, zone: DataFrame) -> DataFrame:
    """(page_id, item_key, page_num, line_no, kind): running_header and page_number lines.

    A head or foot recurs on at least two pages of the paper. The classifier over the line and its surroundings is
    fitted on the clearest cases of the corpus (recurring on most pages against text that never recurs).
    """
    sizes = pages.groupBy("item_key").agg(F.count("*").alias("pages"))
    again = zone.where("key <> ''").groupBy("item_key", "key", "foot").agg(F.count_distinct("page_id").alias("repeats"))
    heads = zone.where("key <> ''").join(again, ["item_key", "key", "foot"]).join(sizes, "item_key").withColumn("share", F.col("repeats") / F.col("pages"))
    heads = written(heads, "heads")
    sure = (F.col("repeats") >= 3) & (F.col("share") >= 0.5)
    label = F.when(sure, 1.0).when((F.col("repeats") == 1) & (F.col("pages") >= 4), 0.0)
    pool = heads.withColumn("label", label).where(F.col("label").isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in SHAPE], "label", "page_id", "line_no")
    train = training_rows(pool, "page_id", "line_no")
    model = BoostedTrees(rounds=25).fit(train[list(SHAPE[:6])].to_numpy(), train["label"].to_numpy())
    trained = bool(len(train)) and train["label"].nunique() == 2

    @F.pandas_udf("double")
    def looks(place: pd.Series, foot: pd.Series, blank: pd.Series, ends: pd.Series, upper: pd.Series, length: pd.Series) -> pd.Series:
        x = np.stack([c.astype(float).to_numpy() for c in (place, foot, blank, ends, upper, length)], axis=1)
        return pd.Series(model.probability(x) if trained else np.where(ends.astype(bool), 0.0, 1.0))

    recurring = heads.where("repeats >= 2").withColumn("p", looks("place", "foot", "blank", "ends", "upper", "length"))
    # all lines of a recurring key are decided together
    judged = recurring.groupBy("item_key", "key", "foot").agg(F.avg("p").alias("p_all"), F.avg(F.col("ends").cast("int")).alias("ending"), F.avg("length").alias("long"))
    recurring = recurring.join(judged, ["item_key", "key", "foot"])
    recurring = recurring.where(sure | (F.col("p_all") >= 0.5) | ((F.col("ending") < 0.5) & (F.col("long") < 0.8))).select("page_id", "item_key", "page_num", "line_no", F.lit("running_header").alias("kind"))
    numbers = zone.where(F.col("value").isNotNull()).withColumn("offset", F.col("value") - F.col("page_num"))
    support = numbers.groupBy("item_key", "offset").agg(F.count_distinct("page_id").alias("support"))
    most = support.groupBy("item_key").agg(F.max("support").alias("most"))
    numbers = numbers.join(support, ["item_key", "offset"]).join(most, "item_key")
    taken = recurring.groupBy("page_id").agg(F.collect_set("line_no").alias("heads"))
    numbers = numbers.join(taken, "page_id", "left")
    edge = F.col("place") - F.coalesce(F.size("heads"), F.lit(0)) <= 0
    numbers = numbers.where(edge & ((F.col("support") >= 2) | ((F.col("most") == 1) & ~F.col("beside"))))
    best = numbers.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("support"), "place", "line_no"))).where("n = 1")
    return recurring.unionByName(best.select("page_id", "item_key", "page_num", "line_no", F.lit("page_number").alias("kind")))


BODY_SHAPE = "page_id {0}, item_key string, page_num int, line_no int, what string, word string, hyphen string, rest string, rest_line int"


def body_words(pages: DataFrame, furniture_lines: DataFrame, common: set[str]) -> DataFrame:
    """From the body lines: rare words (what 'word'), divided words ('divided'; ``rest`` null if the page ends there), and the page's first word ('first')."""
    lines_of = furniture_lines.groupBy("page_id").agg(F.collect_set("line_no").alias("skip"))
    joined = pages.select("page_id", "item_key", "page_num", "markdown").join(lines_of, "page_id", "left")

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for pid, key, num, text, skip in zip(pdf["page_id"], pdf["item_key"], pdf["page_num"], pdf["markdown"], pdf["skip"]):
                skipped = set() if skip is None else set(skip)
                lines = ["" if i + 1 in skipped else line for i, line in enumerate(text.split("\n"))]
                full = [(i, tokens) for i, line in enumerate(lines) if (tokens := line.split())]
                if not full:
                    continue
                rows.append((pid, key, num, full[0][0] + 1, "first", full[0][1][0], None, None, None))
                for at, (i, tokens) in enumerate(full):
                    last = tokens[-1]
                    if len(last) > 1 and last[-1] in HYPHENS and last[-2].isalpha() and not lines[i].lstrip().startswith("|"):
                        after = full[at + 1] if at + 1 < len(full) else None
                        rows.append((pid, key, num, i + 1, "divided", last[:-1].lstrip("([{\"'“„«‘").lower(), last[-1], *((after[1][0], after[0] + 1) if after else (None, None))))
                for i, token, word in line_words(lines):
                    if word not in common:
                        rows.append((pid, key, num, i + 1, "word", word, None, None, None))
                        if token[0] == "(" and ")" not in token:
                            rows.append((pid, key, num, i + 1, "word", "(" + word, None, None, None))
            yield pd.DataFrame(rows, columns=["page_id", "item_key", "page_num", "line_no", "what", "word", "hyphen", "rest", "rest_line"]).astype({"rest_line": "Int32"})

    return joined.mapInPandas(batches, BODY_SHAPE.format(pages.schema["page_id"].dataType.simpleString()))


def next_first_words(firsts: DataFrame) -> DataFrame:
    """(item_key, page_num, following): first body word, page and line of the next page of the paper that has text.

    Pages are ordered within buckets of page numbers and the buckets among themselves, so a paper of any length is
    never sorted in one task.
    """
    at = F.min(F.struct("word", "page_id", "line_no")).alias("at")
    rows = firsts.groupBy("item_key", "page_num").agg(at).withColumn("bucket", F.floor(F.col("page_num") / PAGES_PER_BUCKET))
    rows = rows.withColumn("near", F.lead("at").over(W.partitionBy("item_key", "bucket").orderBy("page_num")))
    heads = rows.groupBy("item_key", "bucket").agg(F.min_by("at", "page_num").alias("head"))
    after = heads.withColumn("far", F.lead("head").over(W.partitionBy("item_key").orderBy("bucket"))).select("item_key", "bucket", "far")
    return rows.join(after, ["item_key", "bucket"]).select("item_key", "page_num", F.coalesce("near", "far").alias("following"))


def misreadings(rare: DataFrame, counts: DataFrame) -> DataFrame:
    """word -> right: rare words that are misreadings of a much more frequent one. ``rare``: word, times; ``counts``: word, n.

    Of a word's bigrams, EDITS x GRAM + 1 of the rarest are looked up: as so many edits destroy one fewer, a word
    within EDITS edits shares at least one of them.
    """
    padded = lambda c: F.concat(F.lit("^"), c, F.lit("$"))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.struct(i.alias("place"), F.substring(padded(c), i, F.lit(GRAM)).alias("gram")))
    known = written(counts.where((F.col("n") >= 2) & ~F.col("word").rlike(r"[^\p{L}\-'’]")), "known")
    postings = known.select(F.col("word").alias("right"), "n", F.length("word").alias("size"), F.explode(grams(F.col("word"))).alias("g")).select("right", "n", "size", "g.gram", F.col("g.place").alias("at"))
    postings = written(postings, "postings")
    spread = postings.groupBy("gram").agg(F.count("*").alias("df"))
    asked = rare.select("word", "times", F.explode(grams(F.col("word"))).alias("g")).select("word", "times", "g.gram", "g.place").join(spread, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    asked = asked.groupBy("word", "times", "gram").agg(F.min("df").alias("df"), F.collect_list("place").alias("places"))
    rank = F.row_number().over(W.partitionBy("word").orderBy("df", "gram"))
    asked = asked.withColumn("rank", rank).where((F.col("rank") <= EDITS * GRAM + 1) & (F.col("df") > 0)).select("word", "times", "gram", "places")
    # the length is part of the key, so a common bigram is many keys; a bigram that is left stands near its place
    asked = asked.withColumn("size", F.explode(F.sequence(F.length("word") - EDITS, F.length("word") + EDITS)))
    met = asked.join(postings, ["gram", "size"]).where((F.col("word") != F.col("right")) & F.exists("places", lambda x: F.abs(x - F.col("at")) <= EDITS))
    pairs = met.select("word", "times", "right", "n").distinct().withColumn("edits", F.levenshtein("word", "right", EDITS)).where("edits > 0")
    alike = F.greatest(*[(skeleton_column(F.col("word"), p) == skeleton_column(F.col("right"), p)).cast("int") for p in (PAIRS, PAIRS_TURNED)])
    # a sign or digit between letters or before them can't be part of a word
    odd = F.when(F.col("word").rlike(ODD), 1).otherwise(0)
    pairs = written(differing(pairs.withColumn("alike", alike).withColumn("odd", odd).where((F.col("odd") > 0) | (F.col("n") > F.col("times")))), "pairs")
    learned = confusions(pairs)
    pairs = pairs.join(F.broadcast(learned) if is_small(learned) else learned, ["got", "meant"], "left").withColumn("met", F.coalesce("met", F.lit(0.0)))
    features = ("times", "ratio", "edits", "alike", "met", "odd", "length")
    table_ = written(pairs.select("word", "right", "n", F.log1p("times").alias("times"), F.log(F.col("n") / F.col("times")).alias("ratio"), "edits", "alike", "met", "odd", F.length("word").alias("length")), "features")
    often, even = F.col("ratio") >= math.log(OFTEN), F.col("ratio") < math.log(EVEN)
    heard = (F.col("alike") == 1) | (F.col("met") > 0)  # by the table or from the corpus
    label = F.when(heard & (F.col("odd") > 0), 1.0).when(~heard & (F.col("odd") == 0), 0.0).when(heard & even, 0.0).when(heard & often & (F.col("times") < math.log(4)), 1.0)
    train = training_rows(table_.withColumn("label", label).where("label is not null"), "word", "right")
    trained = train["label"].nunique() == 2
    model = BoostedTrees(rounds=30).fit(train[list(features)].to_numpy(), train["label"].to_numpy())

    @F.pandas_udf("double")
    def rate(times: pd.Series, ratio: pd.Series, edits: pd.Series, alike: pd.Series, met: pd.Series, odd: pd.Series, length: pd.Series) -> pd.Series:
        x = np.stack([c.astype(float).to_numpy() for c in (times, ratio, edits, alike, met, odd, length)], axis=1)
        return pd.Series(model.probability(x) if trained else x[:, 3])

    # an impossible character needs no model to tell that the word is misread, only a right word to be read for it
    sure = (F.col("odd") > 0) & ((F.col("alike") == 1) | (F.col("met") > 0))
    rated = table_.withColumn("p", rate(*features)).where(sure | ((F.col("p") >= 0.5) & ((F.col("alike") == 1) | (F.col("met") > 0))))
    rated = rated.select("word", "right", "n", "alike", "p")
    odd_ones = pairs.where((F.col("alike") == 0) & (F.col("met") == 0)).join(rated.select("word").distinct(), "word", "left_anti")
    rated = rated.unionByName(unheard(odd_ones, pairs, known))
    return rated.groupBy("word").agg(F.max_by("right", F.struct("alike", "p", "n", "right")).alias("right"))


def unheard(asked: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(word, right, n, alike, p): misreadings by a confusion that neither the table nor the corpus knows.

    One edit from one known word only, and met hardly ever. What tells them from words of their own is learned without
    the table: known words with one letter changed at random, against words of their own (met OWN times or more) beside
    a more frequent word, as if they had been met once. A name or form differs from its neighbour in ways other words
    differ too, a misreading in no usual way. Only what the classifier is very sure of counts; a word with an impossible
    character and LEAST_LONG letters or more needs no classifier.
    """
    own = pairs.where((F.col("times") >= OWN) & (F.col("odd") == 0) & (F.col("alike") == 0) & (F.col("met") == 0) & (F.col("edits") == 1))
    usual = written(own.groupBy("got", "meant").agg(F.count("*").alias("usual")), "usual")
    shape = lambda df: df.select("*", F.log("n").alias("often"), F.length("right").alias("size"), F.when(F.substring("word", 1, 1) != F.substring("right", 1, 1), 0).when(F.substring("word", -1, 1) != F.substring("right", -1, 1), 2).otherwise(1).alias("where"))
    place = F.pmod(F.xxhash64("word", F.lit(1)), F.length("word")).cast("int") + 1
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(F.xxhash64("word", F.lit(2)), F.lit(26)).cast("int") + 1, F.lit(1))
    changed = known.where((F.col("n") >= OWN) & (F.length("word") >= 4)).select(F.col("word").alias("right"), "n", F.concat(F.substring(F.col("word"), F.lit(1), place - 1), letter, F.substring(F.col("word"), place + 1, F.length("word"))).alias("word"), letter.alias("got"), F.substring(F.col("word"), place, F.lit(1)).alias("meant")).where("got <> meant")
    features = ("often", "size", "where", "usual")
    with_usual = lambda df, less: df.join(F.broadcast(usual) if is_small(usual) else usual, ["got", "meant"], "left").withColumn("usual", F.log1p(F.greatest(F.coalesce("usual", F.lit(0)) - less, F.lit(0)).cast("double")))
    rows = lambda df, label: df.select(*[F.col(f).cast("double").alias(f) for f in features], F.lit(label).alias("label"), "word", "right")
    labelled = rows(with_usual(shape(changed), 0), 1.0).unionByName(rows(with_usual(shape(own), 1), 0.0))
    train = training_rows(labelled, "word", "right")
    trained = train["label"].nunique() == 2
    model = BoostedTrees(rounds=40).fit(train[list(features)].to_numpy(), train["label"].to_numpy())

    @F.pandas_udf("double")
    def sure(often: pd.Series, size: pd.Series, where: pd.Series, usual: pd.Series) -> pd.Series:
        x = np.stack([c.astype(float).to_numpy() for c in (often, size, where, usual)], axis=1)
        return pd.Series(model.probability(x) if trained else np.zeros(len(x)))

    only = W.partitionBy("word")
    near = asked.withColumn("least", F.min("edits").over(only)).where(F.col("edits") == F.col("least")).withColumn("near", F.count("*").over(only)).where((F.col("near") == 1) & (F.col("edits") == 1) & (F.col("times") < OWN) & (F.col("n") >= OWN))
    told = with_usual(shape(near), 0).withColumn("p", sure(*features))
    plain = (F.col("odd") == 0) & (F.col("times") <= 2) & (F.length("got") == 1) & (F.length("meant") == 1) & (F.length("right") >= LEAST_LONG) & (F.col("n") >= LEAST_RATIO * F.col("times")) & (F.col("p") >= VERY_SURE)
    return told.where(plain | ((F.col("odd") > 0) & (F.length("right") >= LEAST_LONG))).select("word", "right", "n", "alike", "p")


def differing(pairs: DataFrame) -> DataFrame:
    """``pairs`` with what was read (``got``) and what was meant (``meant``): the words without their common beginning and end."""

    @F.pandas_udf("got string, meant string")
    def cut(word: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(word, right):
            head = len(commonprefix((a, b)))
            tail = len(commonprefix((a[head:][::-1], b[head:][::-1])))
            rows.append((a[head : len(a) - tail], b[head : len(b) - tail]))
        return pd.DataFrame(rows, columns=["got", "meant"])

    return pairs.withColumn("cut", cut("word", "right")).select("*", "cut.got", "cut.meant").drop("cut")


def confusions(pairs: DataFrame) -> DataFrame:
    """(got, meant, met): characters the corpus shows to be read for others, met in ``exp(met)`` words or so.

    They are learned from words with an impossible character that are near to one known word only, and from rare words
    near to one much more frequent word only. Names and forms of a word differ either way, misreadings one way: a
    confusion of letters counts only if it is met many times as often as its reverse.
    """
    alone = W.partitionBy("word")
    near = pairs.withColumn("least", F.min("edits").over(alone)).where(F.col("edits") == F.col("least")).withColumn("near", F.count("*").over(alone))
    near = near.where((F.col("near") == 1) & (F.length("meant") <= 2) & (F.length("got") <= 2) & (F.length("got") > 0) & (F.length("meant") > 0) & ((F.col("odd") > 0) | (F.col("n") >= OFTEN * F.col("times"))))
    seen = written(near.groupBy("got", "meant").agg(F.count_distinct("word").alias("words"), F.count_distinct("right").alias("rights"), F.max("odd").alias("odd")), "seen")
    back = seen.select(F.col("got").alias("meant"), F.col("meant").alias("got"), F.col("words").alias("reverse"))
    least = F.when(F.col("got").rlike(r"[^\p{L}\-'’]"), F.lit(LEAST_ODD)).otherwise(F.lit(LEAST_MET))
    rows = seen.join(back, ["got", "meant"], "left").where((F.col("rights") >= least) & (F.col("words") >= ONE_WAY * F.coalesce("reverse", F.lit(0))))
    return rows.select("got", "meant", F.log1p("words").alias("met"))


def divided_words(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (with word, hyphen, rest) that are one word divided, not a compound broken at the hyphen it always has."""
    c = candidates.where(F.col("rest").isNotNull()).withColumn("tail", F.lower(F.regexp_replace("rest", r"^[\"'“„«(\[]+|[.,;:!?)\]}\"'’”»…]+$", "")))
    c = c.where(F.col("tail").rlike(r"^\p{L}") & ~F.col("rest").rlike(r"^[#|]"))
    c = c.withColumn("tail", F.regexp_replace("tail", "['’]s$", ""))
    c = c.withColumn("joined", F.concat("word", "tail")).withColumn("compound", F.concat("word", F.lit("-"), "tail")).withColumn("at", F.monotonically_increasing_id())
    c = written(c, "divided")
    asked = c.select("at", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("word")) for r in ("joined", "compound", "word", "tail")])).alias("x")).select("at", "x.role", "x.word")
    found = lookup_join(written(asked, "asked"), counts, "word", "inner")
    seen = found.groupBy("at").agg(*[F.max(F.when(F.col("role") == r, F.col("n"))).alias(f"n_{r}") for r in ("joined", "compound", "word", "tail")])
    c = c.join(seen, "at", "left").fillna(0, [f"n_{r}" for r in ("joined", "compound", "word", "tail")])
    lower = F.substring("rest", 1, 1) == F.lower(F.substring("rest", 1, 1))
    c = c.withColumn("lower", lower).withColumn("special", (F.col("hyphen") != "-").cast("int"))
    # what the corpus settles teaches the classifier, which decides the rest: words met neither whole nor as a compound
    only_whole = (F.col("n_joined") > 0) & (F.col("n_compound") == 0)
    only_compound = (F.col("n_joined") == 0) & (F.col("n_compound") > 0)
    features = ("left", "right", "left_length", "right_length", "special")
    shaped = c.select("*", F.log1p("n_word").alias("left"), F.log1p("n_tail").alias("right"), F.length("word").alias("left_length"), F.length("tail").alias("right_length"))
    labelled = shaped.withColumn("label", F.when(only_whole, 1.0).when(only_compound, 0.0)).where("label is not null").select(*[F.col(f).cast("double").alias(f) for f in features], "label", "page_id", "line_no", "joined")
    train = training_rows(labelled, "page_id", "line_no", "joined")
    trained = train["label"].nunique() == 2
    model = BoostedTrees(rounds=25).fit(train[list(features)].to_numpy(), train["label"].to_numpy())

    @F.pandas_udf("double")
    def whole_word(left: pd.Series, right: pd.Series, left_length: pd.Series, right_length: pd.Series, special: pd.Series) -> pd.Series:
        x = np.stack([v.astype(float).to_numpy() for v in (left, right, left_length, right_length, special)], axis=1)
        return pd.Series(model.probability(x) if trained else np.where((x[:, 4] > 0) | (x[:, 0] == 0) | (x[:, 1] == 0), 1.0, 0.0))

    rated = shaped.withColumn("p", whole_word(*features))
    unmet = (F.col("n_joined") == 0) & (F.col("n_compound") == 0)
    hanging = F.col("tail").isin(*JOINING) & (F.col("n_joined") == 0)
    whole = (F.col("n_joined") > F.col("n_compound")) | (unmet & F.col("lower") & ((F.col("p") >= 0.5) | (F.col("special") == 1)))
    return rated.where(whole & ~hanging & (F.col("lower") | (F.col("n_joined") > F.col("n_compound")))).drop(*features[:4], "p", "lower")


def distinct_pages(page_extractions: DataFrame) -> DataFrame:
    """Pages with text, each page_id once."""
    return page_extractions.select("page_id", "item_key", "page_num", "markdown").where(F.col("page_id").isNotNull() & (F.length("markdown") > 0)).dropDuplicates(["page_id"])


def noise(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(furniture lines, divided words, misread words) of distinct pages.

    Of a misread word there is every (page_id, line_no, word, right); of a divided one also the half, and the line and
    page it goes on in.
    """
    zone, counts = read_pages(pages)
    marks = written(furniture(pages, zone), "furniture")
    counts = written(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = {r["word"] for r in counts.where(F.col("n") > COMMON_SHARE * total + 5).select("word").collect()}  # at most 1 / COMMON_SHARE words
    body = written(body_words(pages, marks, common), "body")
    after = next_first_words(body.where("what = 'first'"))
    cut = body.where("what = 'divided'").join(after, ["item_key", "page_num"], "left")
    here = F.col("rest_line").isNotNull()
    cut = cut.select("page_id", "line_no", "word", "hyphen", F.coalesce("rest", "following.word").alias("rest"), F.when(here, F.col("page_id")).otherwise(F.col("following.page_id")).alias("rest_page"), F.coalesce("rest_line", "following.line_no").alias("rest_line"))
    divided = written(divided_words(cut, counts), "hyphens")
    rare = body.where("what = 'word'").select("page_id", "line_no", "word")
    halves = divided.where("n_joined = 0").select("page_id", "line_no", F.col("joined").alias("word"), F.col("word").alias("half"), "rest_page", "rest_line")
    asked = written(rare.unionByName(halves, allowMissingColumns=True), "asked")
    wrong = written(misreadings(asked.groupBy("word").agg(F.count("*").alias("times")), counts), "misreadings")
    return marks, divided, asked.join(F.broadcast(wrong) if is_small(wrong) else wrong, "word")


def noisy_lines(page_extractions: DataFrame) -> DataFrame:
    """(page_id, line_no, kind, wrong, right): every line with noise, once for each wrong word on it.

    ``right`` is the whole or corrected word; both are null for furniture. Null and empty pages have no lines. Repeated
    page_ids count once. Lines count from 1 over all lines of a page.
    """
    marks, divided, hit = noise(written(distinct_pages(page_extractions), "pages"))
    # of a divided word the line with the wrong character counts
    below = F.col("half").isNotNull() & F.startswith("right", F.col("half")) & F.col("rest_line").isNotNull()
    misread = hit.select(F.when(below, F.col("rest_page")).otherwise(F.col("page_id")).alias("page_id"), F.when(below, F.col("rest_line")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("kind"), F.col("word").alias("wrong"), "right").distinct()
    hyphenation = divided.select("page_id", "line_no", F.lit("hyphenation").alias("kind"), F.concat("word", "hyphen").alias("wrong"), F.col("joined").alias("right"))
    none = F.lit(None).cast("string")
    heads = marks.select("page_id", "line_no", "kind", none.alias("wrong"), none.alias("right"))
    return heads.unionByName(hyphenation).unionByName(misread)


def found_noise(page_extractions: DataFrame) -> DataFrame:
    return noisy_lines(page_extractions).select("page_id", "line_no", "kind").distinct()


def recased(old: str, new: str, starts: bool) -> str:
    """``new`` (in lower case) with the capitals of ``old``, the misread word it replaces."""
    letters = [ch for ch in old if ch.isalpha()]
    if len(letters) > 1 and all(ch.isupper() for ch in letters):
        return new.upper()
    out = [new[j1:j2] if op != "equal" else old[i1:i2] for op, i1, i2, j1, j2 in SequenceMatcher(None, old.lower(), new, autojunk=False).get_opcodes()] if len(old.lower()) == len(old) else [new]
    word = "".join(out)
    return word[:1].upper() + word[1:] if old[:1].isupper() or (starts and not old[:1].isalpha()) else word


def corrected(token: str, right: dict[str, str], starts: bool) -> str:
    """The token with its misread word replaced, what stands around the word kept."""
    word = bare(token)
    open_ = "(" + word
    if open_ in right and token[0] == "(" and ")" not in token:  # the bracket is a misread letter
        return recased(token[: len(open_)], right[open_], starts) + token[len(open_) :]
    if word not in right:
        return token
    at = len(token) - len(token.lstrip("([{\"'“„«‘*_"))
    return token[:at] + recased(token[at : at + len(word)], right[word], starts) + token[at + len(word) :]


def is_wrapped(text: str) -> bool:
    """Whether the lines of a text are broken at a width of print: none is longer, and few words had room on the line before."""
    lines = [line.rstrip() for line in text.split("\n")]
    body = [line for line in lines if line and line[0] not in "#|"]
    width = max(map(len, body), default=0)
    if not 0 < width <= WIDEST_PRINT:
        return False
    pairs = [(a, b) for a, b in zip(lines, lines[1:]) if a and b and a[0] not in "#|-*>" and b[0].isalpha()]
    full = sum(len(a) + 1 + len(b.split()[0]) > width - ROOM_LEFT for a, b in pairs)
    return full >= 2 and full >= 0.7 * len(pairs)


def paragraphs(text: str, skip: set[int], divided: dict[int, str | None], right: dict[str, str], drop_first: bool, width: int) -> tuple[list[str], bool, bool]:
    """(paragraphs, whether the first may go on from the page before, whether the last goes on on the next one) of a scanned page.

    ``skip``: furniture lines; ``divided``: lines that end in a divided word, with its rest if that stands on the next
    page; ``right``: misread words; ``drop_first``: the page's first word belongs to the page before. A paragraph ends
    at a blank line, a heading, a table row or a line of numbers, and where the next word would have had room on the
    line (``width``).
    """
    out: list[tuple[str, list[str]]] = []  # (text, head or rows, tokens)
    glue, fresh, room = "", True, 0
    for n, line in enumerate(text.split("\n"), 1):
        if n in skip:
            continue
        tokens = line.split()
        if not tokens:
            fresh = True
            continue
        if drop_first:
            tokens, drop_first = tokens[1:], False
            if not tokens:
                fresh = False  # the rest of this page goes on after the word
                continue
        stripped = line.strip()
        kind = "head" if stripped[0] == "#" or STANDING.match(stripped) else "rows" if stripped[0] == "|" or not WORD_CHARS.search(stripped) else "text"
        if glue and out:
            whole = out[-1][1]
            if glue == "whole":
                whole[-1] = whole[-1][:-1] + tokens[0]
            elif glue == "compound" and tokens[0].strip(OUTER).lower() not in JOINING:
                whole[-1] += tokens[0]
            else:
                whole.append(tokens[0])
            whole += tokens[1:]
        elif kind == "rows" and not fresh and out and out[-1][0] == kind:
            out[-1][1].append("\n" + stripped)  # the rows of a table stay together
        elif fresh or kind != "text" or not out or out[-1][0] != kind or len(tokens[0]) < room:
            out.append((kind, tokens if kind == "text" else [stripped]))
        else:
            out[-1][1].extend(tokens)
        last = tokens[-1]
        glue, fresh, room = "", False, width - ROOM_LEFT - len(line.rstrip())
        if n in divided:
            rest = divided[n]
            if rest is None:
                glue = "whole"
            else:
                out[-1][1][-1] = out[-1][1][-1][:-1] + rest
        elif kind == "text" and len(last) > 1 and last[-1] in HYPHENS and last[-2].isalpha():
            glue = "compound"
    done = []
    for kind, tokens in out:
        starts = [True, *(t[-1] in ".!?" for t in tokens)]
        done.append(" ".join(corrected(t, right, s) for t, s in zip(tokens, starts)) if kind == "text" else "".join(tokens))
    goes_on = bool(out) and out[-1][0] == "text" and done[-1].rstrip("\"'”’»)]*_")[-1:] not in tuple(".!?:")
    return done, bool(out) and out[0][0] == "text", goes_on


def with_capitals(hit: DataFrame, pages: DataFrame) -> DataFrame:
    """``hit`` with a capital where the first letter is misread and the corpus mostly writes the right word with one (nouns, names)."""
    lost = ~F.col("word").rlike(r"^\p{L}")
    asked = hit.where(lost).select("right").distinct()
    token = F.explode(F.split("markdown", r"[^\p{L}\-'’]+")).alias("token")
    met = pages.select(token).withColumn("right", F.lower("token")).join(F.broadcast(asked) if is_small(asked) else asked, "right")
    high = met.groupBy("right").agg(F.avg((F.substring("token", 1, 1) != F.substring("right", 1, 1)).cast("int")).alias("high")).where("high > 0.5").select("right", F.lit(True).alias("high"))
    first = F.concat(F.upper(F.substring("right", 1, 1)), F.expr("substring(right, 2)"))
    return hit.join(high, "right", "left").select("page_id", "word", F.when(lost & F.col("high"), first).otherwise(F.col("right")).alias("right"))


def repaired_pages(page_extractions: DataFrame) -> DataFrame:
    """(page_id, item_key, page_num, text): every page, those of scanned papers as continuous paragraphs set apart by blank lines.

    Divided words are joined, misread ones replaced, running heads and page numbers dropped. A paragraph that goes on
    over pages stands whole on the page it begins on. A paper without any noise and without lines broken at a width of
    print was not scanned: its pages stay as they are, as do null and empty ones. Each page_id counts once; pages without one are left out.
    """
    pages = written(distinct_pages(page_extractions), "pages")
    marks, divided, hit = noise(pages)
    own = F.coalesce("item_key", F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("paper")
    keyed = pages.select("*", own)

    @F.pandas_udf("boolean")
    def printed(texts: pd.Series) -> pd.Series:
        return texts.map(is_wrapped)

    wrapped = pages.where(printed("markdown"))
    noisy = marks.select("page_id").union(divided.select("page_id")).union(hit.select("page_id")).union(wrapped.select("page_id")).distinct()
    scanned = written(keyed.join(noisy, "page_id", "left_semi").select("paper").distinct(), "scanned")
    hit = with_capitals(written(hit.select("page_id", "word", "right").distinct(), "hit"), pages)
    skip = marks.groupBy("page_id").agg(F.collect_set("line_no").alias("skip"))
    over = F.col("rest_page") != F.col("page_id")
    cuts = divided.groupBy("page_id").agg(F.collect_list(F.struct("line_no", F.when(over, F.col("rest")).alias("rest"))).alias("cuts"))
    words = hit.groupBy("page_id").agg(F.collect_set(F.struct("word", "right")).alias("words"))
    drop = divided.where(over).select(F.col("rest_page").alias("page_id"), F.lit(True).alias("drop_first")).distinct()
    longest = F.array_max(F.transform(F.filter(F.split("markdown", "\n"), lambda x: ~F.startswith(x, F.lit("|")) & (F.length(x) <= LONGEST_LINE)), lambda x: F.length(F.rtrim(x))))
    widths = keyed.join(scanned, "paper", "left_semi").select("paper", longest.alias("longest")).groupBy("paper").agg(F.percentile_approx("longest", 0.5).alias("width"))
    work = keyed.join(widths, "paper").join(skip, "page_id", "left").join(cuts, "page_id", "left").join(words, "page_id", "left").join(drop, "page_id", "left")

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda x: [] if x is None else x
        for pdf in parts:
            rows = []
            for pid, paper, num, text, lines, cut, wrong, first, width in zip(pdf["page_id"], pdf["paper"], pdf["page_num"], pdf["markdown"], pdf["skip"], pdf["cuts"], pdf["words"], pdf["drop_first"], pdf["width"]):
                found = paragraphs(text, set(none(lines)), {c["line_no"]: c["rest"] for c in none(cut)}, {w["word"]: w["right"] for w in none(wrong)}, first is True, int(width))
                rows.append((pid, paper, num, *found))
            yield pd.DataFrame(rows, columns=["page_id", "paper", "page_num", "parts", "joins", "open"])

    shape = f"page_id {pages.schema['page_id'].dataType.simpleString()}, paper string, page_num int, parts array<string>, joins boolean, open boolean"
    done = written(work.select("page_id", "paper", "page_num", "markdown", "skip", "cuts", "words", F.coalesce("drop_first", F.lit(False)).alias("drop_first"), F.coalesce("width", F.lit(0)).cast("int").alias("width")).mapInPandas(batches, shape), "paragraphs")
    # pages without text of their own don't end a paragraph
    order = W.partitionBy("paper").orderBy("page_num", "page_id")
    text = done.where(F.size("parts") > 0).withColumn("goes_on", F.coalesce(F.lag("open").over(order), F.lit(False)) & F.col("joins"))
    begins = ~F.col("goes_on") | (F.size("parts") > 1)
    text = text.withColumn("last_begun", F.last(F.when(begins, F.col("page_id")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    moved = text.where("goes_on").groupBy(F.col("last_begun").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("page_num", F.col("page_id").alias("at"), F.col("parts")[0].alias("part")))).alias("moved"))
    kept = text.select("page_id", F.when(F.col("goes_on"), F.slice("parts", 2, F.size("parts"))).otherwise(F.col("parts")).alias("kept"))
    kept = kept.join(moved, "page_id", "left").select("page_id", F.concat_ws(" ", F.array_join("kept", "\n\n"), F.array_join(F.transform("moved", lambda m: m["part"]), " ")).alias("new"))
    kept = done.select("page_id", F.lit(True).alias("scan")).join(kept, "page_id", "left")
    repaired = pages.join(kept, "page_id", "left").select("page_id", "item_key", "page_num", F.when(F.col("scan"), F.coalesce("new", F.lit(""))).otherwise(F.col("markdown")).alias("text"))
    empty = page_extractions.where(F.col("page_id").isNotNull()).select("page_id", "item_key", "page_num", F.col("markdown").alias("text")).dropDuplicates(["page_id"]).join(pages.select("page_id"), "page_id", "left_anti")
    return repaired.unionByName(empty)
