import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import bpe

E = bpe.encoder()
PLAIN = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={})
D = bpe.Decoder(E.tokens)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeeiinorstu '\n\t.9九é😀") | st.characters(codec="utf-8"), max_size=80))
def test_same_as_plain_bpe(text):
    ids = list(E.encode(text))
    assert ids == PLAIN.encode_ordinary(text)
    assert D.decode(ids) == text


def test_long_pretokens():
    for text in ("a" * 20000, "九壌" * 5000, "=" * 3000, " " * 4000, "<|endoftext|>"):
        assert list(E.encode(text)) == PLAIN.encode_ordinary(text)


def test_table(spark):
    rows = [(1, "Hello world", "clash"), (2, None, "clash"), (3, "", "clash"), (4, "  ", "clash"), (4, "  ", "clash"), (None, "x", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_texts(df).collect()
    assert len(got) == 6 and [r["ids"] for r in got if r["doc_id"] in (2, 3)] == [[], []]
    assert [r["ids"] for r in got if r["doc_id"] == 4] == [PLAIN.encode_ordinary("  ")] * 2
    back = {(r["doc_id"], r["text"]) for r in bpe.decode_texts(bpe.encode_texts(df)).collect()}
    assert (1, "Hello world") in back and (2, "") in back
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}[1] == 2
    assert bpe.encode_texts(df.limit(0)).count() == 0
