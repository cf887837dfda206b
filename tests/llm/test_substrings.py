from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from citeloom.llm import substrings
from citeloom.llm.words import gram_hashes, word_runs


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute(rows, least):
    """Word positions of each document inside a run of `least` words that an earlier document has."""
    first: dict[tuple, int] = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - least + 1):
            k = tuple(w[i : i + least])
            first[k] = min(first.get(k, d), d)
    covered: dict[int, set[int]] = {}
    for d, t in rows:
        w = words(t)
        hit = [i for i in range(len(w) - least + 1) if first[tuple(w[i : i + least])] < d]
        if hit:
            covered.setdefault(d, set()).update(x for i in hit for x in range(i, i + least))
    return covered


def covered(found):
    out: dict[int, set[int]] = {}
    for r in found:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [make(n) for n in (9, 10, 11, 25, 60)]
    rows = []
    for d in range(60):
        w = make(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        rows.append((d * 7, " ".join(w)))
    rows += [(3, rows[5][1]), (1000, rows[5][1]), (1000, rows[5][1]), (1001, ""), (1002, None), (None, rows[5][1]), (1003, "a " * 300), (1004, "A, " * 200)]
    docs = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, pos int, hash string")
    want = brute([r for r in rows if r[0] is not None], 10)
    for batches in (3,):
        got = covered(substrings.repeated_passages(docs, 10, 6, batches, 2).collect())
        assert sum(map(len, want.values())) > 500 and got == want


def test_a_later_holder_is_found_where_the_earliest_has_too_little(spark):
    """Documents 2 and 3 share 52 words of which document 1 has 49."""
    run = [f"r{i}" for i in range(52)]
    other = lambda k, n: [f"o{k}x{i}" for i in range(n)]
    rows = [(1, other(1, 30) + run[:49] + other(2, 30)), (2, other(3, 40) + run + other(4, 9)), (3, run + other(5, 70)), (4, other(6, 5) + run[3:] + other(7, 40))]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    for batches in (1, 3):
        assert [tuple(r) for r in substrings.repeated_passages(docs, batches=batches).collect()] == [(3, 0, 52, 2, 40)]


def test_two_sessions_equal_one(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (10, 14, 40)]
    rows = []
    for d in range(40):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        w[0:0] = rng.choice(passages)
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(substrings.repeated_passages(docs, 10, 6, 1).collect())
    path, got = "file://" + str(tmp_path / "index"), []
    substrings.FingerprintIndex.create(spark, path, 10, 10, 6, 2).close()
    for low in (0, 10, 25):
        index = substrings.FingerprintIndex.open(spark.newSession(), path)
        with_texts = None if low != 25 else docs
        part = docs.where(f"doc_id >= {low} and doc_id < {({0: 10, 10: 25, 25: 40})[low]}")
        got += index.append(part, with_texts).collect()
        index.close()
    assert want and sorted(got) == want
    assert {level for level, *_ in substrings.FingerprintIndex.open(spark, path).runs} == {0, 1}


def test_hot_passages_and_a_very_long_text(spark):
    """A passage that every document holds, and a text of 20 MB that holds it too, cost their own windows only."""
    hot = " ".join(f"h{i}" for i in range(60))
    rows = [(d, f"lead{d} " + hot + f" tail{d} and{d}") for d in range(3000)]
    rows += [(5000, " ".join(f"v{i % 70_001}x{i // 70_001}" for i in range(2_000_000)) + " " + hot), (5001, hot), (5001, "other words"), (None, hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.repeated_passages(docs, batches=2).collect()
    assert len(got) == 3001 and {(r.earlier_doc_id, r.earlier_start, r.end_word - r.start_word) for r in got} == {(0, 1, 60)}


def test_real_passages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 50)
    got = covered(substrings.repeated_passages(docs).collect())
    assert want and got == want


def test_winnowing_keeps_one_of_every_window():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 80))) for _ in range(40)]
    for _, _, h, offsets, *_ in word_runs(pa.array(texts)):
        grams, at = gram_hashes(h, offsets, 3)
        text, pos = substrings.winnow(grams, at, 5)
        kept = set(zip(text.tolist(), pos.tolist(), strict=True))
        for t in range(len(texts)):
            n = at[t + 1] - at[t]
            for i in range(n - 4):
                w = grams[at[t] + i : at[t] + i + 5]
                assert {(t, i + int(k)) for k in np.flatnonzero(w == w.min())} <= kept


def test_no_documents(spark):
    assert substrings.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
