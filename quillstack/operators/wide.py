"""Attribute-value rows into a wide table by positional stitching.

Every entity gets a global ordinal; the ordinals are cut into segments of SEGMENT entities; each attribute of a
segment is written as one typed column aligned to the segment's ordinals, and the columns are put side by side by
position. No pivot over attribute values takes place, and a group never holds more than SEGMENT x attributes cells.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.runtime import cut_lineage, lookup_join, small_side, written

SEGMENT = 4096
FIRST_YEAR, LAST_YEAR = 1500, 2100

# Words that may stand around a number without changing it.
NUMBER_WORDS = (
    "volume", "vol", "v", "band", "bd", "jahrgang", "jg", "tome", "t", "number", "num", "no", "nr", "nº", "n°", "heft", "issue", "iss", "part", "pt", "series", "ser",
    "edition", "ed", "edn", "auflage", "aufl", "pages", "page", "pp", "p", "seiten", "s", "leaves", "ca", "circa", "c", "approx", "about",
)
WIDE_DIGITS = "０１２３４５６７８９"
PLAIN_DIGITS = "0123456789"


def squeezed(c: Column) -> Column:
    """Without white space of any kind, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, r"(?U)\s+", "") == "")


def year_reading(value: Column) -> Column:
    """The one year from 1500 to 2100 that a date names, else null. Eight digits are read as year, month, day."""
    v = F.translate(value, WIDE_DIGITS, PLAIN_DIGITS)
    v = F.regexp_replace(v, r"(?<!\d)(\d{4})(0\d|1[0-2])([0-2]\d|3[01])(?!\d)", "$1-$2-$3")
    years = F.array_distinct(F.regexp_extract_all(v, F.lit(r"(?<!\d)(1[5-9]\d\d|20\d\d|2100)(?!\d)"), F.lit(1)))
    return F.when(F.size(years) == 1, years[0].cast("int"))


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral in upper case (its form is checked by the caller)."""
    digit = F.create_map(*[F.lit(x) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in kv])
    numbers = F.transform(F.split(c, "(?<=.)(?=.)"), lambda ch: F.element_at(digit, ch))
    step = F.aggregate(
        numbers,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda a, x: F.struct((a["sum"] + x - F.when(a["last"] < x, a["last"] * 2).otherwise(0)).alias("sum"), x.alias("last")),
    )
    return step["sum"].cast("long")


def integer_reading(value: Column) -> Column:
    """The one whole number a value names (digits of any width, 1,234, 81.0, 2nd, vol. 7, Roman), else null."""
    v = F.regexp_replace(F.translate(value, WIDE_DIGITS, PLAIN_DIGITS), r"(?U)^\s+|\s+$", "")
    v = F.regexp_replace(v, "(?<=\\d)[,'’\u00a0\u2009\u202f](?=\\d{3}(?!\\d))", "")
    words = "|".join(re.escape(w) for w in NUMBER_WORDS)
    core = F.regexp_extract(v, rf"(?iU)^(?:(?:(?:{words})\b\.?|[#№(\[~])\s*)*(?:(?<![a-z]))?(\d+(?:\.0+)?)(?:st|nd|rd|th|er|re|e|º|ª|°)?[.)\]:,;]?\s*(?:(?:{words})\b\.?\s*)*$", 1)
    core = F.when(core == "", F.regexp_extract(v, r"(?i)^(?:v|vol|no|nr|bd|p|s)\.?(\d+(?:\.0+)?)\.?$", 1)).otherwise(core)
    digits = F.regexp_replace(core, r"\.0+$", "")
    roman = F.upper(F.regexp_extract(v, rf"(?iU)^(?:(?:{words})\b\.?\s*)*\(?((?=[MDCLXVI])M{{0,3}}(?:CM|CD|D?C{{0,3}})(?:XC|XL|L?X{{0,3}})(?:IX|IV|V?I{{0,3}}))\)?\.?$", 1))
    bare = F.upper(F.regexp_extract(v, r"(?i)^((?=[MDCLXVI])M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))\.?$", 1))
    roman = F.when(bare != "", bare).otherwise(roman)
    return F.when(digits != "", digits.try_cast("long")).when(roman != "", roman_value(roman))


def attribute_names(item_fields: DataFrame) -> DataFrame:
    """fieldid -> (fieldname trimmed and in lower case, valuetype); names that differ only in case or blanks are one attribute."""
    name = F.lower(F.regexp_replace("fieldname", r"(?U)^\s+|\s+$", ""))
    kind = F.lower(F.trim(F.coalesce(F.col("valuetype"), F.lit("text"))))
    return item_fields.where(F.col("fieldid").isNotNull() & ~is_blank(F.col("fieldname"))).select("fieldid", name.alias("fieldname"), kind.alias("valuetype")).dropDuplicates(["fieldid"])


def cells(item_data: DataFrame, item_fields: DataFrame, item_data_values: DataFrame) -> DataFrame:
    """One row per (itemid, fieldname) with at least one non-blank value: its lowest and highest reading, a value as written.

    Rows of unknown fields or values, null ids and blank values don't count. Values that don't read are ignored if
    another of the cell does. Everything is combined map-side before the shuffle on the cell.
    """
    names = small_side(attribute_names(item_fields))
    rows = item_data.select("itemid", "fieldid", "valueid").where(F.col("itemid").isNotNull()).join(names, "fieldid").select("itemid", "fieldname", "valuetype", "valueid")
    rows = written(rows, "rows")
    values = item_data_values.select("valueid", "value").where(F.col("valueid").isNotNull() & ~is_blank(F.col("value")))
    number, year = integer_reading(F.col("value")), year_reading(F.col("value"))
    values = values.select("valueid", "value", number.alias("_number"), year.cast("long").alias("_year"), squeezed(F.col("value")).alias("_text"))
    joined = lookup_join(rows, values, "valueid", "inner")
    reading = F.when(F.col("valuetype") == "integer", F.col("_number").cast("string")).when(F.col("valuetype") == "date", F.col("_year").cast("string")).otherwise(F.col("_text"))
    joined = joined.select("itemid", "fieldname", "valuetype", "value", reading.alias("reading"))
    shown = F.when(F.col("reading").isNotNull(), F.col("value"))
    return joined.groupBy("itemid", "fieldname").agg(F.max("valuetype").alias("valuetype"), F.min("reading").alias("low"), F.max("reading").alias("high"), F.min(shown).alias("shown"))


def with_ordinals(ids: DataFrame, key: str) -> DataFrame:
    """Dense ordinals from 0 in key order: range partitions are numbered locally and shifted by the partitions before them."""
    n = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    local = ids.repartitionByRange(n, key).sortWithinPartitions(key)
    local = cut_lineage(local.withColumn("_local", F.monotonically_increasing_id()))  # partition in the upper bits, row in the lower 33
    local = local.select(key, F.shiftright("_local", 33).cast("int").alias("_part"), F.col("_local").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    sizes = local.groupBy("_part").count().collect()  # one row per partition
    start, offsets = 0, []
    for r in sorted(sizes):
        offsets.append((r["_part"], start))
        start += r["count"]
    shift = F.broadcast(ids.sparkSession.createDataFrame(offsets, "_part int, _shift bigint"))
    return local.join(shift, "_part").select(key, (F.col("_shift") + F.col("_row")).alias("ordinal"))


KINDS = {"integer": T.LongType(), "date": T.IntegerType()}


def wide_table(item_data: DataFrame, item_fields: DataFrame, item_data_values: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per itemid, one typed column per attribute (text string, integer long, date int year) and ``unfilled``.

    ``unfilled`` lists the attributes that have a non-blank value but no reading, or several different ones; their
    cells stay null. An item without any usable row has no row. Empty inputs give an empty table with the same
    columns. An attribute called like a column of the result gets the suffix ``_field``. Extra input columns are ignored.
    """
    spark = item_data.sparkSession
    found = attribute_names(item_fields).groupBy("fieldname").agg(F.max("valuetype").alias("valuetype")).orderBy("fieldname").collect()  # the attribute list, one row per column of the result
    types = [(r["fieldname"], r["valuetype"]) for r in found]
    label = {n: n + "_field" if n in ("itemid", "unfilled") else n for n, _ in types}
    schema = T.StructType([T.StructField("itemid", item_data.schema["itemid"].dataType), *[T.StructField(label[n], KINDS.get(k, T.StringType())) for n, k in types], T.StructField("unfilled", T.ArrayType(T.StringType()))])
    filled = written(cells(item_data, item_fields, item_data_values), "cells")
    entities = with_ordinals(filled.select("itemid").distinct(), "itemid")
    placed = filled.join(entities, "itemid")
    placed = placed.select(F.floor(F.col("ordinal") / segment).alias("segment"), (F.col("ordinal") % segment).cast("int").alias("slot"), "itemid", "fieldname", "low", "high", "shown")

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["slot"].max()) + 1 if len(pdf) else 0
        ids = np.zeros(size, dtype=object)
        ids[pdf["slot"].to_numpy()] = pdf["itemid"].to_numpy()
        unfilled: list[list[str]] = [[] for _ in range(size)]
        columns: dict[str, object] = {"itemid": ids}
        by_name = dict(list(pdf.groupby("fieldname", sort=False)))
        for name, kind in types:
            column = np.full(size, None, dtype=object)
            part = by_name.get(name)
            if part is not None:
                good = (part["low"].notna() & (part["low"] == part["high"])).to_numpy()
                slots = part["slot"].to_numpy()
                ok = part[good]
                column[slots[good]] = [int(x) for x in ok["low"]] if kind in KINDS else ok["shown"].to_numpy()
                for s in slots[~good]:
                    unfilled[s].append(name)
            columns[label[name]] = pd.Series(column, dtype=("Int64" if kind in KINDS else object)) if kind in KINDS else column
        columns["unfilled"] = unfilled
        return pd.DataFrame(columns)

    if not types:
        return spark.createDataFrame([], schema)
    return placed.groupBy("segment").applyInPandas(stitch, schema)


def unfilled_cells(wide: DataFrame) -> DataFrame:
    """(itemid, fieldname) of each cell that has a value but not exactly one reading."""
    return wide.select("itemid", F.explode("unfilled").alias("fieldname"))
