"""Journal quartiles: overrides, exact titles, expanded abbreviations, fuzzy titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.fuzzy import indel_ratio
from quillstack.functions.text import normalized_title, title_expansions
from quillstack.runtime import small_side

FUZZY_LEAST = 90.0
LONGEST_SEGMENT = 5  # letters, for any title at this bound


def quartiles(publications: DataFrame, titles: DataFrame, overrides: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """(publication, quartile, tier) of each distinct publication; quartile and tier are null where none is found.

    ``titles``: title, quartile. Of repeated titles the one with the better quartile counts. Tiers: 0 override,
    1 exact, 2 expanded abbreviation, 3 at least 90 % alike. Publications are resolved once each, whatever their rows.
    Fuzzy candidates are exact: a title is cut into one segment more than the edits the bound allows, so a name within
    it holds one of them whole, shifted by no more than the edits. No pair is formed without an equality.
    """
    names = publications.select("publication").where(F.trim("publication") != "").distinct().withColumn("norm", normalized_title(F.col("publication")))
    known = titles.where(F.col("title").isNotNull() & F.col("quartile").isNotNull()).select(normalized_title(F.col("title")).alias("norm"), "quartile").groupBy("norm").agg(F.min("quartile").alias("quartile"))
    known_small = small_side(known)
    hits = names.join(known_small, "norm").select("publication", "quartile", F.lit(1).alias("tier"), F.lit(100.0).alias("score"))
    if overrides is not None:
        fixed = small_side(overrides.select(normalized_title(F.col("title")).alias("norm"), "quartile").groupBy("norm").agg(F.max("quartile").alias("quartile")))
        hits = hits.unionByName(names.join(fixed, "norm").select("publication", "quartile", F.lit(0).alias("tier"), F.lit(100.0).alias("score")))
    expanded = names.select("publication", F.explode(title_expansions(F.col("publication"))).alias("norm")).join(known_small, "norm")
    hits = hits.unionByName(expanded.select("publication", "quartile", F.lit(2).alias("tier"), F.lit(100.0).alias("score")))
    if fuzzy:
        left = names.join(hits.select("publication").distinct(), "publication", "left_anti")
        left = left.where(F.length("norm") > 0).select("publication", "norm", F.explode(F.sequence(F.lit(1), F.length("norm"))).alias("at"))
        left = left.select("*", F.explode(F.expr(f"transform(sequence(1, {LONGEST_SEGMENT}), n -> substring(norm, at, n))")).alias("part")).where(F.length("part") > 0).distinct()
        # a title of n letters, the longest name within the bound having n * 11 / 9, is at most so many edits from it
        parted = known.where(F.length("norm") > 0).select(F.col("norm").alias("title"), "quartile", F.length("norm").alias("n")).withColumn("edits", F.expr("int((n + n * 11 div 9) div 10)"))
        parted = parted.select("*", F.explode(F.expr("sequence(0, edits)")).alias("i")).withColumn("first", F.expr("int(i * n div (edits + 1))"))
        right = small_side(parted.select("title", "quartile", "edits", F.expr("substring(title, first + 1, int((i + 1) * n div (edits + 1)) - first)").alias("part"), (F.col("first") + 1).alias("place")))
        near = left.join(right, "part").where(F.abs(F.col("at") - F.col("place")) <= F.col("edits"))
        near = near.where(2.0 * F.least(F.length("norm"), F.length("title")) >= FUZZY_LEAST / 100 * (F.length("norm") + F.length("title")))
        near = near.select("publication", "norm", "title", "quartile").distinct().withColumn("score", indel_ratio("norm", "title")).where(F.col("score") >= FUZZY_LEAST)
        hits = hits.unionByName(near.select("publication", "quartile", F.lit(3).alias("tier"), "score"))
    best = hits.groupBy("publication").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"), "quartile")).alias("b"))
    return names.select("publication").join(best, "publication", "left").select("publication", "b.quartile", "b.tier")


def quartile_counts(titles: DataFrame) -> DataFrame:
    return titles.groupBy(F.coalesce("quartile", F.lit("none")).alias("quartile")).agg(F.count("*").alias("n"))
