import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import tokenizer as T

RAW = open(T.vocabulary_path(), "rb").read()
RANKS = T.read_ranks(RAW)
OWN = T.Encoder(RANKS)
OTHER = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text("abe \n\t's1.éя漢😀", max_size=60))
def test_same_ids_as_the_public_library(text):
    text = text.encode("utf-8", "replace").decode()
    ids = OWN.encode(text)
    assert ids == OTHER.encode_ordinary(text) and T.decode(ids, RANKS) == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3001, "=" * 4097, "x" + "é" * 999, "<|endoftext|>", " " * 3000, "1" * 2049])
def test_long_pieces_and_special_names(text):
    assert OWN.encode(text) == OTHER.encode_ordinary(text)


def test_a_megabyte_without_a_blank():
    ids = OWN.encode("abcdefgh" * 20_000)
    assert T.decode(ids, RANKS) == "abcdefgh" * 20_000


def test_empty_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in T.encode_corpus(df).collect()]
    want = OTHER.encode_ordinary("hello world")
    assert got == [(1, []), (2, []), (3, want), (3, want), (None, OTHER.encode_ordinary("a"))]
    assert dict(T.encode_corpus(df).dtypes)["ids"] == "array<int>" and T.encode_corpus(df.where("false")).count() == 0
    assert [r.n_tokens for r in T.count_tokens(df, ["doc_id"]).collect()] == [0, 0, 2, 2, 1]
