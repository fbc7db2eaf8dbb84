"""Several values packed in one field, split into one value per row.

Quoted spans and escaped characters are atomic. Semicolons, bars, tabs and line ends always separate; commas and
slashes may belong to a value. What they do is learned from the whole column, each column for itself:
expectation-maximisation estimates how often each value occurs and how often each kind of gap separates, and a Viterbi
pass picks the likeliest split of each run of pieces. In a field with unquoted semicolons a comma belongs to the entry.

A run of n pieces has n x n spans, but a value never met weighs as much as its pieces and gaps do one by one, so all
unmet spans together are one chain of n steps. Only the spans of values that were met are edges of their own. Everything
is summed as logarithms, so runs of any length neither underflow nor fill the memory.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions.text import stripped
from quillstack.runtime import lookup_join, written

STRONG = ";；|\n\t\r"
SEMICOLONS = ";；"
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’"}
ESCAPED = frozenset(STRONG + ",/\\" + "".join(QUOTES) + "".join(QUOTES.values()))  # what a backslash before it makes literal
UNSEEN = 0.1  # pseudo-count of a value never met
ROUNDS, STILL = 12, 0.005  # most rounds of the expectation-maximisation; it ends before when no share of a gap moves by more than STILL
LOST = 0.01  # occurrences by which the count of a value may fall short, as spans of tiny probability are not passed on
#: How often each kind of gap is taken to separate before anything is learned.
FIRST_CUTS = {",": 0.9, "/": 0.2, " / ": 0.95}

RUN = T.ArrayType(T.StructType([T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("gaps", T.ArrayType(T.StringType())), T.StructField("kinds", T.ArrayType(T.StringType()))]))


def _quoted(text: str, start: int) -> tuple[str, int] | None:
    """Content and end of the quoted span that opens at ``start``, if it closes right before a separator or the end."""
    close, i, out = QUOTES[text[start]], start + 1, []
    while i < len(text):
        ch = text[i]
        if ch == "\\" and text[i + 1 : i + 2] in ESCAPED:
            out.append(text[i + 1])
            i += 2
        elif ch == close:
            if close == '"' and text[i + 1 : i + 2] == '"':
                out.append('"')
                i += 2
                continue
            rest = text[i + 1 :].lstrip("  ")
            if not rest or rest[0] in STRONG or rest[0] in ",/":
                return "".join(out), i + 1
            out.append(ch)
            i += 1
        else:
            out.append(ch)
            i += 1
    return None


def lex(text: str) -> list[tuple[list[str], list[str], list[str]]]:
    """Runs of a field: each is (pieces, gaps between them as written, kinds of the gaps); runs are set apart by strong separators."""
    bare = text.strip()
    if bare.startswith("[") and bare.endswith("]"):
        try:
            values = json.loads(bare)
        except ValueError:
            values = None
        if isinstance(values, list):
            flat = [str(v).strip() for v in values if v is not None and not isinstance(v, (list, dict))]
            return [([v], [], []) for v in flat if v]
    tokens: list[tuple[str, str]] = []  # ('text' | 'quoted' | separator kind, content)
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            tokens.append(("text", "".join(buffer)))
            buffer.clear()

    def filled() -> bool:
        return len(buffer) > 64 or bool("".join(buffer).strip())

    i = 0
    while i < len(text):
        ch = text[i]
        if ch == "\\" and text[i + 1 : i + 2] in ESCAPED:
            buffer.append(text[i + 1])
            i += 2
            continue
        if ch in QUOTES and not filled() and (not tokens or tokens[-1][0] not in ("text", "quoted")):
            span = _quoted(text, i)
            if span:
                buffer.clear()
                tokens.append(("quoted", span[0]))
                i = span[1]
                while i < len(text) and text[i] in "  ":
                    i += 1
                continue
        if ch in '"“«' and buffer and buffer[-1].isspace():
            end = text.find(QUOTES[ch], i + 1)
            if end > 0:
                buffer.append(text[i : end + 1])
                i = end + 1
                continue
        if ch in STRONG or ch == ",":
            flush()
            tokens.append((ch, ch))
            i += 1
            continue
        if ch == "/":
            spaced = (i == 0 or text[i - 1].isspace()) and (i + 1 == len(text) or text[i + 1].isspace())
            flush()
            tokens.append((" / " if spaced else "/", ch))
            i += 1
            continue
        buffer.append(ch)
        i += 1
    flush()
    commas_belong = any(k in SEMICOLONS for k, _ in tokens if len(k) == 1)
    runs: list[tuple[list[str], list[str], list[str]]] = []
    pieces: list[str] = []
    gaps: list[str] = []
    kinds: list[str] = []
    open_piece: list[str] = []
    quoted = False

    def end_piece() -> bool:
        nonlocal quoted
        value = "".join(open_piece)
        open_piece.clear()
        keep = bool(value.strip())
        if keep:
            pieces.append(value if not quoted else value.strip())
        quoted = False
        return keep

    def end_run() -> None:
        end_piece()
        while len(gaps) > max(0, len(pieces) - 1):
            gaps.pop(), kinds.pop()
        if pieces:
            runs.append((pieces.copy(), gaps.copy(), kinds.copy()))
        pieces.clear(), gaps.clear(), kinds.clear()

    for kind, content in tokens:
        if kind in ("text", "quoted"):
            open_piece.append(content)
            quoted = quoted or kind == "quoted"
        elif kind in STRONG:
            end_run()
        elif kind == "," and commas_belong:
            open_piece.append(content)
        else:
            before_quoted = quoted
            if end_piece():
                gaps.append(content)
                kinds.append("quoted" if before_quoted else kind)
            elif pieces and gaps:  # an empty entry between two gaps: both separate
                kinds[-1] = "quoted"
    end_run()
    fixed = []
    for p, g, k in runs:  # a gap beside a quoted piece always separates: quoted spans are atomic
        cut = 0
        for n, kind in enumerate(k):
            if kind == "quoted":
                fixed.append((p[cut : n + 1], g[cut:n], k[cut:n]))
                cut = n + 1
        fixed.append((p[cut:], g[cut:], k[cut:]))
    return fixed


def _lex_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(runs=[[{"pieces": p, "gaps": g, "kinds": k} for p, g, k in lex(t)] for t in b["packed"]])


def joined(pieces: list[str], gaps: list[str], i: int, j: int) -> str:
    """Pieces i..j of a run as one value."""
    out = [pieces[i]]
    for n in range(i, j):
        out += [gaps[n], pieces[n + 1]]
    return "".join(out).strip()


class Lattice:
    """The splits of a run of n pieces: a chain for the values never met, an edge for each span whose value was.

    edges: (i, j) -> how often the value of pieces i..j was met. A value of g gaps never met counts
    UNSEEN x (UNSEEN / size) ** g, a met one that much more. log_cut and log_keep: of each gap.
    """

    def __init__(self, n: int, edges: dict[tuple[int, int], float], log_cut: list[float], log_keep: list[float], size: float):
        self.n, self.log_cut, self.log_keep = n, [*log_cut, 0.0], log_keep
        self.piece = math.log(UNSEEN / size)
        self.keeps = [0.0]  # running sums of the gaps kept
        for w in log_keep:
            self.keeps.append(self.keeps[-1] + w)
        self.edges = {(i, j): math.log(seen / size) + self.keeps[j] - self.keeps[i] for (i, j), seen in edges.items() if seen > 0}
        self.ends: dict[int, list[tuple[int, float]]] = {}
        self.starts: dict[int, list[tuple[int, float]]] = {}
        for (i, j), w in self.edges.items():
            self.ends.setdefault(j, []).append((i, w))
            self.starts.setdefault(i, []).append((j, w))

    def sums(self) -> None:
        """forward[e], backward[e]: all splits before and after a boundary before piece e; inside[e]: all ends of an unmet value that holds piece e."""
        n, cut, keep, piece = self.n, self.log_cut, self.log_keep, self.piece
        self.forward = [0.0] + [-math.inf] * n
        open_ = -math.inf
        for e in range(n):
            open_ = piece + (_add(self.forward[e], open_ + keep[e - 1]) if e else self.forward[e])
            self.forward[e + 1] = cut[e] + _add(open_, *[self.forward[i] + w for i, w in self.ends.get(e, ())])
        self.backward = [-math.inf] * n + [0.0]
        self.inside = [-math.inf] * n
        for e in range(n - 1, -1, -1):
            self.inside[e] = _add(cut[e] + self.backward[e + 1], keep[e] + piece + self.inside[e + 1]) if e < n - 1 else 0.0
            self.backward[e] = _add(piece + self.inside[e], *[w + cut[j] + self.backward[j + 1] for j, w in self.starts.get(e, ())])

    def boundary(self, gap: int) -> float:
        """Probability that the gap separates."""
        return math.exp(min(0.0, self.forward[gap + 1] + self.backward[gap + 1] - self.forward[self.n]))

    def spans(self, least: float) -> dict[tuple[int, int], float]:
        """Probability of each span being one entry, for all above ``least``."""
        out: dict[tuple[int, int], float] = {}
        whole, floor = self.forward[self.n], math.log(least)
        for i in range(self.n):
            lead = self.forward[i] - whole
            for j, w in self.starts.get(i, ()):
                out[i, j] = math.exp(min(0.0, lead + w + self.log_cut[j] + self.backward[j + 1]))
            for j in range(i, self.n):
                lead += self.piece + (self.log_keep[j - 1] if j > i else 0.0)
                if lead + self.inside[j] < floor:  # no unmet value from i through j is likelier
                    break
                p = lead + self.log_cut[j] + self.backward[j + 1]
                if p >= floor:
                    out[i, j] = out.get((i, j), 0.0) + math.exp(min(0.0, p))
        return {e: p for e, p in out.items() if p >= least}

    def best(self) -> list[tuple[int, int]]:
        """The likeliest split; of equal ones the one with more entries."""
        n, cut, keep, piece = self.n, self.log_cut, self.log_keep, self.piece
        done: list[tuple[float, int, int]] = [(0.0, 0, -1)]  # (score, entries, start of the last one) of the boundaries
        chain = (-math.inf, 0, -1)
        for e in range(n):
            fresh = (done[e][0] + piece, done[e][1] + 1, e)
            longer = (chain[0] + keep[e - 1] + piece, chain[1], chain[2]) if e else fresh
            chain = max(fresh, longer)
            options = [chain]
            for i, w in self.ends.get(e, ()):
                unmet = piece * (e - i + 1) + self.keeps[e] - self.keeps[i]
                options.append((done[i][0] + _add(w, unmet), done[i][1] + 1, i))
            top = max(options)
            done.append((top[0] + cut[e], top[1], top[2]))
        split, e = [], n
        while e:
            split.append((done[e][2], e - 1))
            e = done[e][2]
        return split[::-1]


def _add(*logs: float) -> float:
    """Logarithm of a sum, from the logarithms of its terms."""
    top = max(logs)
    return top if top == -math.inf or len(logs) == 1 else top + math.log(sum(math.exp(x - top) for x in logs))


def _gap_logs(kinds: list[str], cut: dict[str, float]) -> tuple[list[float], list[float]]:
    share = [min(0.999, max(0.001, cut.get(k, FIRST_CUTS.get(k, 0.5)))) for k in kinds]
    return [math.log(s) for s in share], [math.log(1 - s) for s in share]


def value_key(model: str, value: str) -> bytes:
    """What stands for a value of a model in tables: 16 bytes, however long the value is."""
    return hashlib.md5(f"{model}\u0001{value}".encode("utf-8", "surrogatepass")).digest()


def met_spans(runs: DataFrame, certain: DataFrame) -> DataFrame:
    """(run_id, i, j, value): all single pieces, and the spans as long as some value known for certain, which may be it."""
    lengths: dict[str, set[int]] = {}
    for r in certain.where("gaps").select("model", "length").distinct().collect():  # different lengths of such values, one row each
        lengths.setdefault(r["model"], set()).add(r["length"])
    shape = "run_id string, i int, j int, value binary"

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, model, pieces, gaps in zip(b["run_id"], b["model"], b["pieces"], b["gaps"]):
                wanted = lengths.get(model, set())
                longest = max(wanted, default=0)
                heads, tails = [len(p) - len(p.lstrip()) for p in pieces], [len(p) - len(p.rstrip()) for p in pieces]
                for i, piece in enumerate(pieces):
                    rows.append((rid, i, i, value_key(model, piece.strip())))
                    size = len(piece) - heads[i]
                    for j in range(i + 1, len(pieces)):
                        size += len(gaps[j - 1]) + len(pieces[j])
                        if size - tails[j] in wanted:
                            rows.append((rid, i, j, value_key(model, joined(pieces, gaps, i, j))))
                        if size - len(pieces[j]) > longest:
                            break
            yield pd.DataFrame(rows, columns=["run_id", "i", "j", "value"])

    return runs.select("run_id", "model", "pieces", "gaps").mapInPandas(spans, shape)


def split_runs(runs: DataFrame, certain: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Segment each distinct ambiguous run, each model (column) by its own frequencies.

    ``runs``: run_id, model, pieces, gaps, kinds, times; ``certain``: model, value (key), seen, length, gaps (whether the
    value holds a character that may separate). Returns run_id, entries.
    """
    spans = written(met_spans(runs, certain), "spans")
    start = certain.groupBy("model").agg(F.sum("seen").alias("n")).unionByName(runs.groupBy("model").agg(F.sum(F.size("pieces") * F.col("times")).cast("double").alias("n")))
    sizes = {r["model"]: r["n"] for r in start.groupBy("model").agg(F.sum("n").alias("n")).collect()}  # one row per column
    places = runs.agg(F.sum(F.size("pieces"))).first()[0] or 0
    least = min(1e-6, LOST / max(1, places))
    certain = certain.select("model", "value", "seen")
    learned, cuts, more = certain, {}, None

    def lattices(values: DataFrame, found: DataFrame | None) -> DataFrame:
        asked = spans if found is None else written(spans.unionByName(found).distinct(), "asked")
        met = lookup_join(asked, values.select("value", "seen"), "value", "inner")
        grouped = met.groupBy("run_id").agg(F.collect_list(F.struct("i", "j", "seen")).alias("edges"))
        return runs.join(grouped, "run_id", "left")

    def lattice(model: str, kinds: list[str], edges: list | None, cuts: dict, sizes: dict) -> Lattice:
        found = {} if edges is None else {(e["i"], e["j"]): e["seen"] for e in edges}
        return Lattice(len(kinds) + 1, found, *_gap_logs(kinds, cuts.get(model, {})), max(1.0, sizes.get(model, 1.0)))

    shape = "run_id string, model string, i int, j int, value binary, seen double, kind string, cut double, gaps double"
    for _ in range(rounds):
        now_cuts, now_sizes = {m: dict(c) for m, c in cuts.items()}, dict(sizes)

        def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for rid, model, pieces, gaps, kinds, times, edges in zip(b["run_id"], b["model"], b["pieces"], b["gaps"], b["kinds"], b["times"], b["edges"]):
                    kinds = list(kinds)
                    net = lattice(model, kinds, edges, now_cuts, now_sizes)
                    net.sums()
                    for (i, j), p in net.spans(least).items():
                        rows.append((rid, model, i, j, value_key(model, joined(pieces, gaps, i, j)), p * (1 if j > i else times), None, None, None))
                    for g, kind in enumerate(kinds):
                        rows.append((rid, model, None, None, None, None, kind, times * net.boundary(g), float(times)))
                yield pd.DataFrame(rows, columns=["run_id", "model", "i", "j", "value", "seen", "kind", "cut", "gaps"]).astype({"i": "Int32", "j": "Int32"})

        counted = written(lattices(learned, more).mapInPandas(expected, shape), "expected")
        shares = counted.where("kind is not null").groupBy("model", "kind").agg(((F.sum("cut") + 0.5) / (F.sum("gaps") + 1.0)).alias("share")).collect()  # one row per column and kind of gap
        moved = max((abs(r["share"] - cuts.get(r["model"], {}).get(r["kind"], FIRST_CUTS.get(r["kind"], 0.5))) for r in shares), default=0.0)
        for r in shares:
            cuts.setdefault(r["model"], {})[r["kind"]] = r["share"]
        # a value with gaps inside is only borne out by other runs than its own: one occurrence is taken off
        met = counted.where("value is not null").groupBy("model", "value", (F.col("j") > F.col("i")).alias("inner")).agg(F.sum("seen").alias("seen"))
        met = met.select("model", "value", F.when(F.col("inner"), F.col("seen") - 1).otherwise(F.col("seen")).alias("seen")).where("seen > 0")
        learned = written(certain.unionByName(met).groupBy("model", "value").agg(F.sum("seen").alias("seen")), "values")
        more = counted.where("j > i").select("run_id", "i", "j", "value")
        sizes = {r["model"]: r["n"] for r in learned.groupBy("model").agg(F.sum("seen").alias("n")).collect()}  # one row per column
        if moved <= STILL:
            break

    @F.pandas_udf("array<string>")
    def decode(model: pd.Series, pieces: pd.Series, gaps: pd.Series, kinds: pd.Series, edges: pd.Series) -> pd.Series:
        out = []
        for m, p, g, k, es in zip(model, pieces, gaps, kinds, edges):
            out.append([joined(p, g, i, j) for i, j in lattice(m, list(k), es, cuts, sizes).best()])
        return pd.Series(out)

    return lattices(learned, more).select("run_id", decode("model", "pieces", "gaps", "kinds", "edges").alias("entries"))


def unpack(rows: DataFrame, keys: list[str], field: str, packed: str) -> DataFrame:
    """One row per entry of the packed column: ``keys``, ``field``, pos (from 1), entry.

    ``field`` names the column a value comes from; each learns for itself. Entries are trimmed and freed of quoting and
    escapes, empty ones dropped and not counted, repeated ones kept. Null, empty and blank fields give no row. Equal
    input rows count once. Other columns are ignored. An entry may have any number of separators inside.
    """
    lead = [*keys, field]
    base = rows.select(*lead, F.col(packed).alias("packed")).where(F.col("packed").isNotNull()).distinct()
    base = base.withColumn("_row", F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in lead], "packed")))
    schema = T.StructType([*base.schema.fields, T.StructField("runs", RUN)])
    lexed = written(base.mapInPandas(_lex_batches, schema).drop("packed"), "lexed")
    sure = ~F.exists("runs", lambda r: F.size(r["pieces"]) > 1)
    model = F.coalesce(F.col(field).cast("string"), F.lit(""))
    single = lexed.select(model.alias("model"), F.explode(F.filter("runs", lambda r: F.size(r["pieces"]) == 1)).alias("run")).select("model", stripped(F.col("run.pieces")[0]).alias("text"))
    key = F.unhex(F.md5(F.concat("model", F.lit("\u0001"), "text")))
    certain = single.groupBy("model", key.alias("value")).agg(F.count("*").cast("double").alias("seen"), F.max(F.length("text")).alias("length"), F.max(F.col("text").rlike("[,/]")).alias("gaps"))
    certain = written(certain, "certain")
    run_id = F.md5(F.to_json(F.struct(model.alias("model"), "run.pieces", "run.gaps", "run.kinds")))
    mixed = written(lexed.where(~sure).select(*lead, "_row", model.alias("_model"), F.posexplode("runs").alias("at", "run")).select(*lead, "_row", "_model", "at", "run.*", run_id.alias("run_id")), "runs")
    open_runs = mixed.where(F.size("pieces") > 1).groupBy("run_id").agg(F.min("_model").alias("model"), *[F.min(c).alias(c) for c in ("pieces", "gaps", "kinds")], F.count("*").alias("times"))
    segmented = written(split_runs(written(open_runs, "open"), certain), "segmented")
    plain = lexed.where(sure).select(*lead, F.transform("runs", lambda r: r["pieces"][0]).alias("entries"))
    mixed = lookup_join(mixed.select(*lead, "_row", "at", "pieces", "run_id"), segmented, "run_id").withColumn("entries", F.coalesce("entries", "pieces"))
    mixed = mixed.groupBy(*lead, "_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "entries"))), lambda r: r["entries"])).alias("entries")).drop("_row")
    every = plain.unionByName(mixed).select(*lead, F.filter(F.transform("entries", stripped), lambda e: e != "").alias("entries"))
    return every.select(*lead, F.posexplode("entries").alias("pos", "entry")).withColumn("pos", F.col("pos") + 1)


def unpack_library(library_items: DataFrame) -> DataFrame:
    """(item_key, field_name, pos, entry) of the packed ``tags`` and ``collections``."""
    each = F.explode(F.array(F.struct(F.lit("tags").alias("field_name"), F.col("tags").alias("packed")), F.struct(F.lit("collections").alias("field_name"), F.col("collections").alias("packed"))))
    rows = library_items.select("item_key", each.alias("f")).select("item_key", "f.field_name", "f.packed")
    return unpack(rows, ["item_key"], "field_name", "packed").select("item_key", "field_name", "pos", "entry").distinct()
