import hashlib

from quillstack.plans import reference


def test_every_text_is_hashed_by_its_bytes(spark, tmp_path):
    texts = {1: "plain", 2: "Grün – déjà", 3: "ä" * 40_000, 4: "a" + "ä" * 40_000, 5: "", 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["hash"] for r in reference.QUERIES["content_hash"](spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256(t.encode()[:65536]).hexdigest() for n, t in texts.items() if t is not None}
