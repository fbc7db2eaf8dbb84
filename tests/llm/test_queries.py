import duckdb
import pytest

import __spark_entry__ as entry
from quillstack.llm import queries


def test_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 3, 5, 7, 10)} | {"p8_ids", "p9_mix"} <= set(queries.QUERIES)


COLUMNS = {"p1_found": ["item_key", "title_normalized"], "p3_found": ["page_id", "line_no", "kind"], "p5_found": ["chunk_a", "chunk_b"], "p7_found": ["item_key", "cut"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0


def test_sql(spark, sf):
    c = duckdb.connect()
    for t in ("document_extractions", "chunk_config"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert {tuple(r) for r in queries.p7_found(spark, sf).collect()} == set(c.execute(queries.SQL["p7_found"]).fetchall())
