"""Mapping freely typed values to the entries of a reference list, in SQL only.

Partition-based pigeonhole join: a reference form of length L that may be k edits away is cut into k + 1 segments;
at least one of them stands unchanged in the typed form, near its own place. Typed and reference forms meet by
equality on (length, segment number, substring), are verified with the built-in levenshtein, and what meets nothing
is found by an anti-join. Abbreviations meet by the same principle with words as segments: of n words all but a few
are exact prefixes in their place. Acronyms are equal to the initials of one title only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.runtime import lookup_join, small_side, written

# Words that titles lose or exchange when typed, letters that are written in several ways, words before a title.
SMALL_WORDS = ("of", "the", "and", "for", "in", "on", "de", "des", "der", "die", "das", "und", "et", "fur", "fuer", "la", "le", "du", "an", "a")
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinoooooouuuuyy"
MISDECODED = (("Ã¼", "ü"), ("Ã©", "é"), ("Ã¶", "ö"), ("Ã¤", "ä"), ("Ã¨", "è"), ("Ã±", "ñ"), ("â€“", "–"), ("&amp;", "&"), ("&#38;", "&"))
#: A word is a word of its own, not a misspelling, if it stands in at least OWN_STRINGS different values and in more than OWN_SHARE as many as the word it resembles.
OWN_STRINGS, OWN_SHARE = 3, 0.05


def folded(c: Column) -> Column:
    """Lower case without accents, misdecoded letters, spelling variants, and white space other than single blanks."""
    for wrong, right in MISDECODED:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    c = F.translate(F.lower(c), ACCENTED, UNACCENTED)
    c = F.regexp_replace(F.regexp_replace(c, "ß", "ss"), "æ|ae|oe|œ", "e")
    c = F.regexp_replace(F.regexp_replace(c, r"(?<=\w{3})our\b", "or"), r"[‐‑−]", "-")
    c = F.regexp_replace(c, "&", " and ")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[\s_]+", " "), r"^[ .,;:\"'“”]+|[ .,;:\"'“”]+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def content(ws: Column) -> Column:
    return F.filter(ws, lambda w: ~w.isin(*SMALL_WORDS))


def readings(c: Column) -> Column:
    """Forms of a typed value that may be the bare title: without lead-in, additions at the end, inversion."""
    base = F.regexp_replace(c, r"^(?:published in|appeared in|in)\s*:?\s+(?=\S)|^in:\s*", "")
    cuts = [
        F.regexp_replace(base, r"\s*[(\[][^()\[\]]*[)\]]\s*$", ""),
        F.regexp_replace(base, r",\s*(?:vol|no|nr|new ser|n\.? ?s|ser|bd|iss|part|\d)[^,]*$", ""),
        F.regexp_replace(base, r"\s+[–—/]\s+.*$", ""),
        F.regexp_replace(base, r":\s.*$", ""),
        F.regexp_replace(base, r":\s[^:]*$", ""),
    ]
    turned = [F.when(base.rlike(p), F.regexp_replace(base, p, "$2 $1")) for p in (r"^([^,]+),\s*([^,]+)$", r"^(.+?)\s*\(([^()]+)\)$")]
    return F.array_distinct(F.filter(F.array(c, base, *cuts, *turned), lambda x: x.isNotNull() & (x != "")))


MOST_EDITS = 5


def allowed(length: Column) -> Column:
    """Edits a form of this length may have."""
    return F.when(length >= 24, MOST_EDITS).when(length >= 14, 4).when(length >= 10, 3).when(length >= 8, 2).when(length >= 5, 1).otherwise(0)


def squeezed_forms(name: Column, ws: Column) -> Column:
    """The two compared forms: content words run together (kind 0) and all words run together (kind 1)."""
    both = [F.struct(F.lit(0).alias("kind"), F.array_join(content(ws), "").alias("form")), F.struct(F.lit(1).alias("kind"), F.array_join(ws, "").alias("form"))]
    return F.filter(F.array(*both), lambda f: f["form"] != "")


def pigeonhole(typed: DataFrame, reference: DataFrame) -> DataFrame:
    """Pairs within the allowed edits. typed: id, kind, form; reference: title, kind, form. Returns id, title, distance (least over the forms)."""
    ref = reference.withColumn("len", F.length("form")).withColumn("k", allowed(F.col("len")))
    segment = lambda i: (F.floor(i * F.col("len") / (F.col("k") + 1)).cast("int").alias("at"), (F.floor((i + 1) * F.col("len") / (F.col("k") + 1)) - F.floor(i * F.col("len") / (F.col("k") + 1))).cast("int").alias("size"))
    cut = lambda df: df.withColumn("s", F.explode(F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(i.alias("i"), *segment(i))))).where("s.size > 0")
    postings = cut(ref).select("title", "kind", F.col("form").alias("ref_form"), "k", "len", F.col("s.i").alias("i"), F.substring(F.col("form"), F.col("s.at") + 1, F.col("s.size")).alias("part"))
    postings = written(postings, "postings")
    # where segments lie follows from the length alone, so the typed side works them out itself for the lengths there are
    lengths = sorted(r["len"] for r in postings.select("len").distinct().collect())  # no more than the longest title has characters
    asked = typed.withColumn("typed_len", F.length("form")).withColumn("len", F.explode(F.sequence(F.col("typed_len") - MOST_EDITS, F.col("typed_len") + MOST_EDITS))).where(F.col("len").isin(*lengths) if lengths else F.lit(False))
    asked = asked.withColumn("k", allowed(F.col("len"))).where(F.abs(F.col("typed_len") - F.col("len")) <= F.col("k"))
    asked = cut(asked).select("id", "kind", "form", "typed_len", "len", "k", "s.i", "s.at", "s.size")
    shift = F.col("typed_len") - F.col("len")
    low = F.greatest(F.lit(0), F.col("at") - F.col("i"), F.col("at") + shift - (F.col("k") - F.col("i")))
    high = F.least(F.col("typed_len") - F.col("size"), F.col("at") + F.col("i"), F.col("at") + shift + (F.col("k") - F.col("i")))
    asked = asked.where(low <= high).withColumn("from", F.explode(F.sequence(low, high)))
    asked = asked.select("id", "kind", "form", "len", "i", F.substring(F.col("form"), F.col("from") + 1, F.col("size")).alias("part"))
    met = asked.join(small_side(postings), ["kind", "len", "i", "part"]).select("id", "title", "form", "ref_form", "k").distinct()
    met = met.withColumn("distance", F.levenshtein("form", "ref_form", MOST_EDITS)).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("k")))
    return met.groupBy("id", "title").agg(F.min("distance").alias("distance"))


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """typed -> title for every distinct non-blank typed value that names an entry of the list.

    ``values`` has the column typed, ``reference`` the column title. Null and blank values and titles are ignored,
    repeated ones count once. A value that fits two entries equally well is left unmatched. An empty list matches nothing.
    """
    titles = reference.select("title").where(F.col("title").isNotNull() & (F.trim("title") != "")).distinct()
    titles = written(titles.withColumn("words", words(folded(F.col("title")))).where(F.size("words") > 0), "titles")
    base = values.select("typed").where(F.col("typed").isNotNull()).distinct().withColumn("base", folded(F.col("typed"))).where(F.col("base") != "")
    forms = base.groupBy("base").agg(F.count("*").alias("n")).select("base", F.posexplode(readings(F.col("base"))).alias("order", "reading"))
    forms = forms.withColumn("words", words(F.col("reading"))).where(F.size("words") > 0)
    forms = written(forms.withColumn("id", F.md5(F.concat_ws("|", "base", "order"))), "forms")
    # how many different values a word stands in
    seen = forms.where(F.col("order") == 0).select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    listed = titles.select(F.explode("words").alias("word")).distinct()
    spread = written(seen.join(listed.withColumn("listed", F.lit(True)), "word", "full").select("word", F.coalesce("count", F.lit(0)).alias("spread"), F.coalesce("listed", F.lit(False)).alias("listed")), "words")

    def named(df: DataFrame) -> DataFrame:
        return df.join(forms.select("id", "base", F.col("words").alias("typed_words")), "id").join(small_side(titles.select("title", F.col("words").alias("title_words"))), "title")

    def without_other_words(pairs: DataFrame) -> DataFrame:
        """Drop pairs whose differing typed word is a word of its own. Needs id, title, differing: array<struct<t, r>>."""
        each = pairs.select("id", "title", F.explode("differing").alias("d")).select("id", "title", "d.t", "d.r")
        mine = each.join(spread.select(F.col("word").alias("t"), F.col("spread").alias("t_spread"), F.col("listed").alias("t_listed")), "t", "left")
        both = mine.join(spread.select(F.col("word").alias("r"), F.col("spread").alias("r_spread")), "r", "left")
        own = F.coalesce("t_listed", F.lit(False)) | ((F.coalesce("t_spread", F.lit(0)) >= OWN_STRINGS) & (F.col("t_spread") > OWN_SHARE * F.coalesce("r_spread", F.lit(0))))
        return pairs.join(both.where(own).select("id", "title").distinct(), ["id", "title"], "left_anti")

    typed_forms = forms.select("id", F.explode(squeezed_forms(F.col("reading"), F.col("words"))).alias("f")).select("id", "f.*").distinct()
    list_forms = titles.select("title", F.explode(squeezed_forms(F.col("title"), F.col("words"))).alias("f")).select("title", "f.*").distinct()
    near = named(pigeonhole(typed_forms, list_forms))
    tw, rw = content(F.col("typed_words")), content(F.col("title_words"))
    paired = F.filter(F.arrays_zip(tw.alias("t"), rw.alias("r")), lambda p: (p["t"] != p["r"]))
    aligned = F.size(tw) == F.size(rw)
    near = near.withColumn("differing", F.when(aligned, paired).otherwise(F.array().cast("array<struct<t:string,r:string>>")))
    close = F.forall("differing", lambda p: F.levenshtein(p["t"], p["r"]) <= F.when(F.length(p["r"]) >= 8, 4).when(F.length(p["r"]) >= 5, 3).otherwise(1))
    near = written(near.where((F.col("distance") == 0) | (aligned & close) | (~aligned & (F.col("distance") <= F.when(F.length("title") >= 24, 3).otherwise(2)))), "near")
    fuzzy = without_other_words(near.where("distance > 0"))
    matched = near.where("distance = 0").unionByName(fuzzy).select("base", "title", F.lit(0).alias("tier"), "distance")
    matched = written(matched, "matched")

    rest = forms.join(matched.select("base").distinct(), "base", "left_anti")
    # abbreviations: words are the segments, each a prefix of its word
    short = rest.select("id", content(F.col("words")).alias("tw")).withColumn("n", F.size("tw")).where(F.col("n") >= 2)
    full = titles.select("title", content(F.col("words")).alias("rw")).withColumn("n", F.size("rw"))
    prefixes = full.select("title", "n", F.posexplode("rw").alias("i", "w")).withColumn("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda z: F.substring(F.col("w"), F.lit(1), z)))).select("title", "n", "i", "part")
    hits = short.select("id", "n", F.posexplode("tw").alias("i", "part")).join(small_side(written(prefixes, "prefixes"), 100_000), ["n", "i", "part"])
    slack = F.when(F.col("n") >= 5, 2).otherwise(1)
    some = hits.groupBy("id", "title", "n").agg(F.count("*").alias("same")).where(F.col("same") >= F.col("n") - slack)
    some = some.join(short.select("id", "tw"), "id").join(small_side(full.select("title", "rw")), "title")
    off = F.filter(F.arrays_zip(F.col("tw").alias("t"), F.col("rw").alias("r")), lambda p: ~F.startswith(p["r"], p["t"]))
    near_prefix = lambda p: F.least(*[F.levenshtein(p["t"], F.substring(p["r"], F.lit(1), F.length(p["t"]) + x)) for x in (-1, 0, 1)])
    some = some.withColumn("differing", off)
    some = some.where(F.forall("differing", lambda p: (F.length(p["t"]) >= 3) & (near_prefix(p) <= F.when(F.length(p["t"]) >= 5, 2).otherwise(1))))
    some = written(some.withColumn("distance", F.aggregate("differing", F.lit(0), lambda a, p: a + near_prefix(p))), "short")
    shortened = some.where("distance = 0").unionByName(without_other_words(some.where("distance > 0")))
    shortened = shortened.join(forms.select("id", "base"), "id").select("base", "title", F.lit(1).alias("tier"), "distance")
    # acronyms: initials of the content words, of one title only
    initials = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    unique = full.select("title", initials(F.col("rw")).alias("acronym")).groupBy("acronym").agg(F.min("title").alias("title"), F.count("*").alias("n")).where("n = 1 and length(acronym) >= 2")
    letters = rest.where((F.col("order") == 0) & ((F.size("words") == 1) | F.forall("words", lambda w: F.length(w) == 1))).select("base", F.array_join("words", "").alias("acronym"))
    acronyms = letters.join(small_side(unique.select("acronym", "title")), "acronym").select("base", "title", F.lit(2).alias("tier"), F.lit(0).alias("distance"))
    every = matched.unionByName(shortened).unionByName(acronyms)
    best = every.groupBy("base", "title").agg(F.min(F.struct("tier", "distance")).alias("score"))
    top = best.groupBy("base").agg(F.min("score").alias("score"))
    one = best.join(top, ["base", "score"]).groupBy("base").agg(F.min("title").alias("title"), F.count("*").alias("n")).where("n = 1")
    return base.join(one.select("base", "title"), "base").select("typed", "title")


def map_publications(library_items: DataFrame, quartiles: DataFrame) -> DataFrame:
    """(item_key, publication, title_normalized) of every row with a non-blank publication; unmatched ones have a null title."""
    rows = library_items.select("item_key", "publication").where(F.col("publication").isNotNull() & (F.regexp_replace("publication", r"(?U)\s+", "") != "")).distinct()
    rows = written(rows, "publications")
    names = rows.select("publication").distinct()
    mapped = written(map_values(names.select(F.col("publication").alias("typed")), quartiles.select(F.col("title_normalized").alias("title"))), "mapped")
    mapped = mapped.select(F.col("typed").alias("publication"), F.col("title").alias("title_normalized"))
    missed = names.join(mapped.select("publication"), "publication", "left_anti").withColumn("title_normalized", F.lit(None).cast("string"))
    # one publication may hold much of the rows
    return lookup_join(rows, mapped.unionByName(missed), "publication").select("item_key", "publication", "title_normalized")


def found_titles(library_items: DataFrame, quartiles: DataFrame) -> DataFrame:
    return map_publications(library_items, quartiles).where(F.col("title_normalized").isNotNull()).select("item_key", "title_normalized").distinct()
