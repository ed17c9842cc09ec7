"""Tokenization against the public library, and the exact way back."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokenization as t
from millrace.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    x = Tokenizer.from_file(t.tokenizer_path())
    x.encode_special_tokens = True
    return x


CASES = ["", "aaa aaaa aaaaa", "hello world", " hello  world \n\n x", "don't we'll I'D", "<|endoftext|>", "中文、かな", "\U0001f469‍\U0001f4bb", "\x00\x1c\x85\xa0", "x" * 20_000, "\r\n\t ", "123456 ²½", "العربية", "ét\xe9"]


@pytest.mark.parametrize("text", CASES)
def test_cases(library, text):
    a = t.automaton(t.tokenizer_path())
    ids = a.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids and a.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=("Cn", "Co", "Cs")), max_size=60))
def test_round_trip(text):
    a = t.automaton(t.tokenizer_path())
    assert a.decode(a.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghilnorstuABT .'0123\n\xe9\xfc", max_size=60))
def test_like_the_library(library, text):
    assert t.automaton(t.tokenizer_path()).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_small_table(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in QUERIES["p7_ids"](spark, small).collect()}
    assert got.keys() == texts.keys()
    assert all(ids == (library.encode(texts[k], add_special_tokens=False).ids if texts[k] else []) for k, ids in got.items())
    assert {r.doc_id: r.n_tokens for r in QUERIES["p7_counts"](spark, small).collect()} == {k: len(v) for k, v in got.items()}


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "z"), (1, None, "z"), (None, "", "z"), (2, "ab", "z")], "doc_id bigint, text string, ids string")
    assert sorted((str(r.doc_id), list(r.ids)) for r in t.encoded(df).collect()) == [("1", []), ("1", []), ("2", [397]), ("None", [])]
    assert t.encoded(df.where("false")).isEmpty() and dict(t.encoded(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
