from __future__ import annotations

import pytest

from citeloom.llm import tokencount

TEXTS = ["", None, "Hello world", " the the  the", "naïve 東京 12345", "x" * 5000, "\n\n\t a<|endoftext|>b's", "\0" + "12 \0 34", "thththe erbleation ththe " * 50]


def test_counts_equal_whole_text_encoding(spark):
    one = tokencount.encoding(tokencount.VOCABULARY, tokencount.PATTERN)
    rows = [(i * (1 << 33) if i % 2 else i, t, "x", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pretoken string, n int")
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs).collect()}
    assert got == {i: len(one.encode_ordinary(t or "")) for i, t, *_ in rows}


def test_repeated_and_null_ids_are_summed(spark):
    docs = spark.createDataFrame([(1, "foo bar"), (1, "foo bar"), (None, "erbleation"), (None, "a")], "doc_id long, text string")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(docs).collect()}
    one = tokencount.encoding(tokencount.VOCABULARY, tokencount.PATTERN)
    assert got == {1: (4, 2 * len(one.encode_ordinary("foo bar"))), None: (2, len(one.encode_ordinary("erbleation")) + 1)}


def test_all_documents_against_the_tokenizer(spark):
    """Also a text of 20 MB, and a pre-token that every document has."""
    one = tokencount.encoding(tokencount.VOCABULARY, tokencount.PATTERN)
    rows = [(r.doc_id, f"xqzvwk {r.text}") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows.append((10**12, " ".join(f"v{i % 9_001}q" for i in range(3_000_000))))
    assert len(rows[-1][1]) > 20_000_000
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: len(one.encode_ordinary(t)) for d, t in rows}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_count(spark, rows):
    got = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, 0) for i, _ in rows]
