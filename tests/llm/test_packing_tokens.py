from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.llm import packing, tokencount


def test_conversations_count_tokens_of_the_vocabulary(spark):
    one = tokencount.encoding(tokencount.VOCABULARY, tokencount.PATTERN)
    texts = ["Antidisestablishmentarianism, xqzvw!", "日本語の文章は単語の間に空白がない" * 30, "x7f" * 3000, "", None, "  \n\n  tabs\t\there" + " " * 5000]
    rows = [(k // 2, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]
    got = {r.id: (r.tokens, r.loss_tokens) for r in packing.conversation_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    n = [len(one.encode_ordinary(t or "")) + 2 for t in texts]
    assert got == {k: (n[2 * k] + n[2 * k + 1], n[2 * k + 1]) for k in range(3)}
    assert n[1] > 30 and n[2] > 1000


def test_counts_are_those_of_operator_7(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = {r.id: r.tokens for r in packing.conversation_examples(turns).collect()}
    docs = turns.where("conv_id is not null").select(F.monotonically_increasing_id().alias("doc_id"), "conv_id", "text").toPandas()
    counts = {r.doc_id: r.n_tokens for r in tokencount.token_counts(spark.createDataFrame(docs[["doc_id", "text"]])).collect()}
    want: dict = {}
    for d, c in zip(docs["doc_id"], docs["conv_id"], strict=True):
        want[c] = want.get(c, 0) + counts[d] + 2
    assert got == want
