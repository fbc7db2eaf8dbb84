"""Splitting oversized texts at natural boundaries, in SQL.

One regular expression with bounded quantifiers walks over the text. Its alternatives are ordered by the strength of
the boundary: end of text, blank line, end of sentence, end of line, blank, a whole unbroken stretch, and at last a
cut by characters. Each match is a tile; the tiles put together are the text. A piece is a tile led by the characters
before it, as many as the overlap asks for. All of it is one projection over the array of tiles; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.runtime import small_side, written

CHARS_PER_TOKEN = 4
BLANK = r" \t\n\r"
RUN = 256  # tiles whose lengths are summed at a time
LOOK_BACK = 4  # tiles in which the overlap is looked for before the whole text is


def tile_pattern(limit: Column, overlap: Column) -> Column:
    """The pattern for pieces of up to ``limit`` characters of which ``overlap`` repeat the piece before."""
    tile = limit - overlap
    half = F.greatest(F.lit(1), F.floor(tile / 2).cast("int"))
    reach = F.concat(F.lit(".{"), half.cast("string"), F.lit(","), tile.cast("string"), F.lit("}"))
    short = F.concat(F.lit(".{1,"), tile.cast("string"), F.lit("}"))
    return F.concat(
        F.lit("(?s)"), short, F.lit(r"\z"),
        F.lit("|"), reach, F.lit(r"(?<=\n[ \t]{0,3}\r?\n)"),
        F.lit("|"), reach, F.lit(rf"(?<=[.!?。][\])\"'’”]{{0,2}}[{BLANK}])"),
        F.lit("|"), reach, F.lit(r"(?<=\n)"),
        F.lit("|"), short, F.lit(rf"(?<=[{BLANK}])"),
        F.lit(rf"|[^{BLANK}]{{1,"), limit.cast("string"), F.lit(rf"}}(?![^{BLANK}])"),
        F.lit("|"), short,
    )


def tiled(texts: DataFrame, config: DataFrame, text: str = "full_markdown", config_id: str = "config_id") -> DataFrame:
    """Texts longer than 4 x chunk_size characters with their limit, overlap and tiles.

    Null and shorter texts, and those of an unknown configuration or one without a positive size, are left out: they
    need no cut. An overlap of the limit or more counts as one character less than it, so pieces always move on.
    """
    known = config.where(F.col("chunk_size") > 0).select(
        F.col("config_id").alias(config_id),
        (F.col("chunk_size") * CHARS_PER_TOKEN).cast("int").alias("limit"),
    ).dropDuplicates([config_id])
    laps = config.select(F.col("config_id").alias(config_id), F.greatest(F.lit(0), F.coalesce("chunk_overlap", F.lit(0)) * CHARS_PER_TOKEN).cast("int").alias("overlap")).dropDuplicates([config_id])
    known = known.join(laps, config_id).withColumn("overlap", F.least("overlap", F.col("limit") - 1))
    long = texts.join(small_side(known, 1000), config_id).where(F.length(text) > F.col("limit"))
    return long.withColumn("tiles", F.regexp_extract_all(text, tile_pattern(F.col("limit"), F.col("overlap")), F.lit(0)))


def ends_inside(tile: Column, after: Column) -> Column:
    """Whether the cut between two tiles goes through an unbroken stretch."""
    return ~tile.rlike(rf"[{BLANK}]\z") & F.coalesce(after.rlike(rf"\A[^{BLANK}]"), F.lit(False))


def cut_kind(tiles: Column) -> Column:
    """'forced' if some tile ends inside an unbroken stretch, else 'natural'."""
    inner = F.zip_with(F.slice(tiles, 1, F.size(tiles) - 1), F.slice(tiles, 2, F.size(tiles)), ends_inside)
    return F.when(F.exists(inner, lambda x: x), F.lit("forced")).otherwise(F.lit("natural"))


def running_sums(rows: DataFrame, numbers: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sums of an array of numbers up to each of them; run by run, so long arrays cost hardly more than in proportion."""
    empty = F.array().cast("array<int>")
    sums = lambda xs: F.aggregate(xs, empty, lambda done, x: F.concat(done, F.array(F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(0) + x)))
    size = F.size(numbers)
    runs = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / RUN).cast("int")), lambda r: sums(F.slice(numbers, r * RUN + 1, F.lit(RUN))))
    rows = rows.withColumn("_runs", F.when(size > 0, runs).otherwise(F.array().cast("array<array<int>>")))
    before = F.concat(F.array(F.lit(0)), sums(F.transform("_runs", lambda run: F.element_at(run, -1))))
    return rows.withColumn(out, F.flatten(F.zip_with("_runs", F.slice(before, 1, F.size("_runs")), lambda run, shift: F.transform(run, lambda x: x + shift)))).drop("_runs")


def once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` without repetitions. Only rows that are repeated are shuffled, the others stay where they are."""
    mark = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))
    marked = rows.withColumn("_mark", mark)
    again = small_side(written(marked.groupBy("_mark").agg(F.count("*").alias("n")).where("n > 1").select("_mark"), "repeated"))
    return marked.join(again, "_mark", "left_anti").unionByName(marked.join(again, "_mark", "left_semi").dropDuplicates(["_mark"])).drop("_mark")


def split_texts(texts: DataFrame, config: DataFrame, key: str = "item_key", text: str = "full_markdown") -> DataFrame:
    """Pieces of every oversized text: key, piece_no (from 1), char_start, char_end, cut, piece.

    The characters [char_start, char_end) count in code points from 0. No piece is longer than its limit; the pieces
    cover the text; piece n repeats the last ``overlap`` characters before its tile, also after a forced cut. Only a whole
    unbroken stretch that fits in the limit but not beside the overlap stands with less of it: the natural boundary wins.
    ``cut`` tells whether the end of the piece is natural or forced. Equal rows of a key count once; rows of a key with
    other texts or sizes are split each for itself.
    """
    sized = tiled(once(texts.select(key, text, "config_id"), [key, "config_id", text]), config, text)
    rows = sized.select(key, text, "limit", "overlap", "tiles", F.transform("tiles", F.length).alias("_lengths"))
    rows = running_sums(rows, "_lengths", "ends")

    def piece(tile: Column, n: Column) -> Column:
        end = F.get("ends", n)
        start = end - F.length(tile)
        lap = F.least(F.col("overlap"), F.col("limit") - F.length(tile), start)
        near = F.array_join(F.slice("tiles", F.greatest(F.lit(1), n + 1 - LOOK_BACK), F.least(n, F.lit(LOOK_BACK))), "")
        lead = F.when(lap <= 0, "").when(F.length(near) >= lap, F.right(near, lap)).otherwise(F.substring(F.col(text), start - lap + 1, lap))
        cut = F.when(ends_inside(tile, F.get("tiles", n + 1)), "forced").otherwise("natural")
        return F.struct((n + 1).alias("piece_no"), (start - lap).cast("long").alias("char_start"), end.cast("long").alias("char_end"), cut.alias("cut"), F.concat(lead, tile).alias("piece"))

    return rows.select(key, F.explode(F.transform("tiles", piece)).alias("p")).select(key, "p.*")


def found_cuts(texts: DataFrame, config: DataFrame) -> DataFrame:
    """(item_key, cut) of every paper that has to be split."""
    return tiled(texts.select("item_key", "full_markdown", "config_id"), config).select("item_key", cut_kind(F.col("tiles")).alias("cut")).distinct()
