from __future__ import annotations


import numpy as np
import pytest

import corpus_pipeline
from citeloom.llm import decontaminate, packing, tokencount
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_ngramjoin import brute as brute_pairs
from tests.llm.test_warc_packing import greedy


def repetitive(t):
    """By sorting all suffixes: more than half in repeats of 40 characters, or one of over 1,000."""
    order = sorted(range(len(t)), key=lambda i: t[i : i + 1500])
    covered, longest = [False] * len(t), 0
    for a, b in zip(order[:-1], order[1:], strict=True):
        if t[a : a + 40] == t[b : b + 40] and max(a, b) + 40 <= len(t):
            n = 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            longest = max(longest, n)
            for at in (a, b):
                covered[at : at + n] = [True] * n
    return sum(covered) > 0.5 * len(t) or longest > 1000


def expected(rows, items):
    """The documents kept, by brute force: {doc_id: text}."""
    docs = {d: t for d, t in rows if not repetitive(t or "")}
    gone = brute_lines(sorted(docs.items()), 20)
    for d in list(docs):
        mine = {k for (x, k) in gone if x == d}
        if mine:
            docs[d] = "\n".join(line for k, line in enumerate(docs[d].split("\n")) if k not in mine)
            if not docs[d].strip(" "):
                del docs[d]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in brute_pairs(sorted(docs.items()), 3, 0.5):
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    docs = {d: t for d, t in docs.items() if find(d) == d}
    leaks = {d for d, _ in brute_leaks(sorted(docs.items()), items, 0.5, 0.6, 3, 128)}
    return {d: t for d, t in docs.items() if d not in leaks}


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = expected(rows, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert 0 < len(want) < len(rows) and set(got) == set(want)
    one = tokencount.encoding(tokencount.VOCABULARY, tokencount.PATTERN)
    size = {d: len(one.encode_ordinary(t)) for d, t in want.items()}
    assert {d: r.tokens for d, r in got.items()} == size
    bins: dict = {}
    for r in got.values():
        bins.setdefault((r.shard, r.bin_no), []).append(r)
    assert all(sum(r.tokens for r in b) <= packing.MAX_TOKENS or len(b) == 1 and b[0].oversize for b in bins.values())
    ids = sorted(want)
    tokens = np.array([size[d] for d in ids])
    limits = (packing.MAX_TOKENS, packing.MAX_SEGMENTS, packing.MAX_LOSS_TOKENS)
    assert [(got[d].bin_no, got[d].position) for d in ids] == greedy([(int(n), max(int(n) - 1, 0)) for n in tokens], limits)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, key string, __lower string, __gone string, __doc long, __text string, __node long"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, name, stage):
    sf = "/root/testdata/sf0.001"
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, sf).collect() == []
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "a line of a document without an id, which is long enough"), (3, long), (4, "one fine line of text that is long enough"), (4, "one fine line of text that is long enough"), (5, "  \n ")]
    docs = spark.createDataFrame([(d, t, None, None, None, 1, "k", None, "g", 2, "t", 3) for d, t in rows], SCHEMA)
    out = stage(spark, docs, sf)
    got = out.collect()
    if name == "packing":
        assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 4, 5]
        assert [r.oversize for r in got if r.doc_id == 3] == [True]
    else:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 4, 4, 5]


def test_rejections_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    spam = "buy these cheap things today, they are the very best\n" * 30
    docs = spark.createDataFrame([(1, spam, 5), (2, "x1 y2 z3 " + item.upper() + " and more words", 9)], "doc_id long, text string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()] == [2]
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, sf).collect()] == [1]
    assert decontaminate.THRESHOLD == 0.5
