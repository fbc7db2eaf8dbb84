import pytest
from pyspark.sql import functions as F

from quillstack.operators import wide

DATA = "itemid long, fieldid int, valueid long, value string"
FIELDS = "fieldid int, fieldname string, valuetype string, itemid long"
VALUES = "valueid long, value string"


@pytest.mark.parametrize(
    "value,number",
    [("04", 4), ("vol 69", 69), ("Vol. 88", 88), ("v.79", 79), ("Bd. 77", 77), ("LIV", 54), ("36.", 36), ("81.0", 81), ("１２", 12), ("#11", 11), ("(4)", 4), ("no. 2", 2), ("1,282", 1282), ("ca. 524", 524), ("168 pages", 168), ("183 S.", 183), ("2. ed.", 2), ("1st", 1), ("edition 9", 9), ("IX", 9),
     ("12-14", None), ("1–2", None), ("7/8", None), ("3 and 4", None), ("n/a", None), ("suppl.", None), ("?", None), ("", None), ("3.5", None), (None, None)],
)
def test_integer_reading(spark, value, number):
    assert spark.createDataFrame([(value,)], "v string").select(wide.integer_reading(F.col("v"))).first()[0] == number


@pytest.mark.parametrize("value,year", [("1994-04-03", 1994), ("2026", 2026), ("Spring 1991", 1991), ("20210114", 2021), ("1987?", 1987), ("27.05.1995", 1995), ("2018-11-00 November 2018", 2018), ("©2014", 2014), ("10/2002", 2002), ("2007-08-22T10:22:00Z", 2007), ("1990-1995", None), ("n.d.", None), ("20??", None), ("1st of May", None), ("1499", None), (None, None)])
def test_year_reading(spark, value, year):
    assert spark.createDataFrame([(value,)], "v string").select(wide.year_reading(F.col("v"))).first()[0] == year


def tables(spark):
    fields = spark.createDataFrame([(1, "title", "text", 0), (2, "Volume ", "integer", 0), (3, "volume", "integer", 0), (4, "DATE", "date", 0), (5, "itemid", "text", 0), (6, None, "text", 0)], FIELDS)
    values = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "other"), (4, "7"), (5, "VII"), (6, "tba"), (7, " "), (8, None), (9, "1999"), (10, "8"), (11, "x")], VALUES)
    data = spark.createDataFrame(
        [(1, 1, 1, ""), (1, 1, 2, ""), (1, 2, 4, ""), (1, 3, 5, ""), (1, 3, 6, ""), (1, 4, 9, ""), (2, 1, 1, ""), (2, 1, 3, ""), (2, 2, 6, ""), (2, 4, 7, ""), (3, 2, 4, ""), (3, 3, 10, ""), (3, 3, 10, ""), (4, 1, 8, ""), (4, 1, 7, ""), (5, 99, 1, ""), (5, 1, 999, ""), (6, 5, 11, ""), (None, 1, 1, ""), (7, 6, 1, "")],
        DATA,
    )
    return data, fields, values


def test_wide_table(spark):
    out = {r["itemid"]: r.asDict() for r in wide.wide_table(*tables(spark), segment=2).collect()}
    assert sorted(out) == [1, 2, 3, 6]
    assert out[1]["volume"] == 7 and out[1]["date"] == 1999 and out[1]["unfilled"] == []
    assert out[2]["title"] is None and sorted(out[2]["unfilled"]) == ["title", "volume"]
    assert out[3]["unfilled"] == ["volume"]
    assert out[6]["itemid_field"] == "x"


def test_against_brute_force(spark):
    found = {(r[0], r[1]) for r in wide.unfilled_cells(wide.wide_table(*tables(spark))).collect()}
    assert found == {(2, "title"), (2, "volume"), (3, "volume")}


def test_empty_tables(spark):
    data, fields, values = tables(spark)
    assert wide.wide_table(data.limit(0), fields, values).count() == 0
    assert wide.wide_table(data, fields.limit(0), values).count() == 0
    assert wide.wide_table(data, fields, values.limit(0)).count() == 0


def test_ordinals_are_dense(spark):
    rows = wide.with_ordinals(spark.range(1000).select((F.col("id") * 7).alias("k")), "k").orderBy("k").collect()
    assert [r["ordinal"] for r in rows] == list(range(1000))


def test_hot_value(spark):
    data = spark.range(3000).select(F.col("id").alias("itemid"), F.lit(1).alias("fieldid"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).cast("long").alias("valueid"))
    values = spark.range(4000).select(F.col("id").alias("valueid"), F.lit("v").alias("value"))
    fields = spark.createDataFrame([(1, "title", "text", 0)], FIELDS)
    assert wide.wide_table(data, fields, values).where("title = 'v'").count() == 3000
