from quillstack.llm import bpe, queries
from quillstack.runtime import table


def test_mix_holds_its_tokens(spark, sf):
    rows = queries.p9_mix(spark, sf).collect()
    assert rows and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    known = {i for r in bpe.encode_texts(table(spark, sf, "documents")).collect() for i in r["ids"]}
    assert {i for r in rows for i in r["ids"]} <= known


def test_shares_tell_how_much_is_used(spark, sf):
    rows = queries.p9_shares(spark, sf).collect()
    assert all(0 <= r["used_share"] <= 1 for r in rows)
    assert max(r["used_share"] for r in rows) == 1  # the source that sets the size
