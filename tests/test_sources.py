import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillstack.operators import library
from quillstack.sources import library as src
from quillstack.sources.index_store import IndexStore, upserted
from quillstack.streaming import intake


def make_db(path):
    db = sqlite3.connect(path)
    db.executescript(
        """CREATE TABLE items (itemID INTEGER PRIMARY KEY, itemTypeID INT, key TEXT); CREATE TABLE deletedItems (itemID INTEGER PRIMARY KEY);
        CREATE TABLE itemAttachments (itemID INTEGER PRIMARY KEY, parentItemID INT, path TEXT, contentType TEXT, linkMode INT);
        CREATE TABLE empty (a TEXT);
        INSERT INTO items VALUES (1, 2, 'ONE'), (2, 2, 'TWO'), (3, 2, 'GONE'), (11, 14, 'ATT1'), (12, 14, 'ATT0'), (13, 14, 'ATT3');
        INSERT INTO deletedItems VALUES (3);
        INSERT INTO itemAttachments VALUES (11, 1, 'storage:a.pdf', 'application/pdf', 0), (12, 1, 'storage:b.pdf', 'application/pdf', 1), (13, 2, '/x.pdf', 'application/pdf', 2);"""
    )
    db.commit()
    db.close()


def test_sqlite_library(spark, tmp_path):
    path = str(tmp_path / "lib.sqlite")
    make_db(path)
    items, att, deleted = (src.sqlite_table(spark, path, t, 2) for t in ("items", "itemAttachments", "deletedItems"))
    assert items.count() == 6 and src.sqlite_table(spark, path, "empty").count() == 0
    none = lambda c: spark.createDataFrame([], f"itemid long, {c} string")
    attributes = spark.createDataFrame([(1, "Title", "2019-05", None, None)], "itemid long, title string, date string, publication string, doi string")
    rows = library.items_with_pdfs(items, att, attributes, none("authors"), none("tags"), none("collections"), deleted).orderBy("itemid").collect()
    assert [(r["item_key"], r["pdf_path"]) for r in rows] == [("ONE", "storage/ATT0/b.pdf"), ("TWO", None)]
    assert rows[0]["year"] == 2019 and rows[1]["title"] == "[No Title]" and rows[1]["authors"] == "[No Author]"
    assert src.citation_keys(spark, str(tmp_path / "absent.sqlite")).count() == 0
    counts = {r["measure"]: r["n"] for r in library.diagnostics(items, att, deleted).collect()}
    assert counts == {"total": 2, "with_pdf": 2, "no_attachment": 0}


def test_files(spark, tmp_path):
    (tmp_path / "j.csv").write_text("title_normalized,quartile\nnature,Q1\n,\n")
    assert [tuple(r) for r in src.journal_list(spark, str(tmp_path / "j.csv")).collect()] == [("nature", "Q1")]
    (tmp_path / "o.csv").write_text("# comment\nOdd: Journal,q2\n\n")
    assert [tuple(r) for r in src.journal_overrides(spark, str(tmp_path / "o.csv")).collect()] == [("odd journal", "Q2")]
    entry = {"timestamp": "t", "session_id": "s", "table_id": "x", "cost_usd": 0.5}
    (tmp_path / "costs.json").write_text(json.dumps([entry, entry]))
    log = src.cost_log(spark, str(tmp_path / "costs.json"))
    assert log.count() == 2 and src.cost_log(spark, str(tmp_path / "no.json")).count() == 0
    src.append_costs(log, str(tmp_path / "log"))
    src.append_costs(log, str(tmp_path / "log"))
    assert src.cost_log(spark, str(tmp_path / "log")).count() == 4
    (tmp_path / "w.json").write_text(json.dumps({"work_id": "W1", "referenced": ["W2", "W3"]}))
    assert [tuple(r) for r in src.cites_of(src.works_from_json(spark, str(tmp_path / "w.json"))).collect()] == [("W1", "W2", 0), ("W1", "W3", 1)]
    (tmp_path / "a.pdf").write_bytes(b"x")
    assert src.binary_files(spark, str(tmp_path)).count() == 1


def test_index_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), 4)
    assert store.read() is None and store.doc_ids() is None
    rows = spark.createDataFrame([("a", "c1", "text"), ("b", "c2", "text")], "doc_id string, chunk_id string, chunk_type string")
    store.write(rows)
    new = spark.createDataFrame([("a", "c9", "table", 3)], "doc_id string, chunk_id string, chunk_type string, table_index int")
    store.replace(new, new)
    assert sorted((r["doc_id"], r["chunk_id"]) for r in store.read().collect()) == [("a", "c9"), ("b", "c2")]
    store.delete(rows.where("doc_id = 'b'"))
    assert [r["doc_id"] for r in store.doc_ids().collect()] == ["a"] and store.get("a").count() == 1 and store.get("zz").count() == 0
    assert {tuple(r) for r in upserted(rows.select("doc_id", "chunk_id"), spark.createDataFrame([("a", "new")], "doc_id string, chunk_id string"), ["doc_id"]).collect()} == {("a", "new"), ("b", "c2")}


def test_store_touches_few_buckets(spark, tmp_path):
    root = tmp_path / "index"
    store = IndexStore(spark, str(root), 8)
    rows = spark.range(200).select(F.format_string("d%03d", "id").alias("doc_id"), F.format_string("c%03d", "id").alias("chunk_id"), F.when(F.col("id") % 3 == 0, "table").otherwise("text").alias("chunk_type"), F.lit("old").alias("v"))
    store.write(rows, {"note": "first"})
    before = {str(p) for p in root.rglob("*.parquet")}
    store.delete(rows.where("doc_id = 'd007'"))
    added = {str(p) for p in root.rglob("*.parquet")} - before
    assert {p.split("bucket=")[1].split("/")[0] for p in added} == {str(store._touched(rows.where("doc_id = 'd007'"))[0])}
    assert store.read().count() == 199 and store.state() == {"note": "first"}
    store.upsert(spark.createDataFrame([("d007", "c007", "text", "new", 1), ("d008", "c008", "text", "new", 2)], "doc_id string, chunk_id string, chunk_type string, v string, extra int"), ["doc_id", "chunk_id"])
    assert store.read().count() == 200 and {r["doc_id"] for r in store.read().where("v = 'new'").collect()} == {"d007", "d008"}
    assert store.get("d009", ["table"], ["chunk_id"]).collect()[0]["chunk_id"] == "c009" and store.get("d009", ["text"]).count() == 0
    assert [r["chunk_id"] for r in store.get(limit=2, columns=["chunk_id"]).collect()] == ["c000", "c001"]


def test_store_survives_broken_and_racing_writes(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), 4)
    rows = spark.createDataFrame([("a", "c1", "text"), ("b", "c2", "text")], "doc_id string, chunk_id string, chunk_type string")
    store.write(rows)
    publish = store.log.publish

    def broken(n, manifest):
        raise OSError("died before the swap")

    store.log.publish = broken
    with pytest.raises(OSError):
        store.delete(rows.where("doc_id = 'a'"))
    assert IndexStore(spark, str(tmp_path / "index"), 4).read().count() == 2

    def late(n, manifest):
        IndexStore(spark, str(tmp_path / "index"), 4).delete(rows.where("doc_id = 'b'"))
        publish(n, manifest)

    store.log.publish = late
    with pytest.raises(RuntimeError, match="taken"):
        store.delete(rows.where("doc_id = 'a'"))
    store.log.publish = publish
    assert [r["doc_id"] for r in store.read().collect()] == ["a"]
    store.delete(rows)
    assert store.read() is None or store.read().count() == 0
    store.write(rows)
    assert store.remove_old(1) > 0 and store.read().count() == 2


def test_tables_without_row_ids(spark, tmp_path):
    path = str(tmp_path / "w.sqlite")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE pairs (a TEXT PRIMARY KEY, b INT) WITHOUT ROWID")
    db.executemany("INSERT INTO pairs VALUES (?, ?)", [("x", 1), ("y", 2)])
    db.commit()
    assert {tuple(r) for r in src.sqlite_table(spark, path, "pairs").collect()} == {("x", 1), ("y", 2)}


def test_absent_files(spark, tmp_path):
    assert src.cost_log(spark, str(tmp_path / "none.json")).count() == 0 and src.citation_keys(spark, str(tmp_path / "none.db")).count() == 0
    assert src.cost_log(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "log.json").write_text('[{"timestamp": "t", "session_id": "s", "cost_usd": 1.5}]')
    assert src.cost_log(spark, f"file://{tmp_path}/log.json").first()["cost_usd"] == 1.5
