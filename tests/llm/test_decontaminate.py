from __future__ import annotations

import math
import random
import re
from collections import Counter

from citeloom.llm import decontaminate as d


WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words_of(text):
    return WORD.findall((text or "").lower())


def halves(text):
    parts = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) > 1:
        return sum(parts[:-1], []), parts[-1]
    words = parts[0]
    cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def share_of(part, passage, gram):
    n = min(gram, len(part))
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return len(grams(part) & grams(passage)) / len(grams(part)) if n else 1.0


def brute(docs, items, threshold, share, gram, passage_words):
    """BM25 of every item against every passage, on words as strings; nothing of the operator is used."""
    items = sorted({(i, t) for i, t in items if words_of(t)})
    df = Counter(w for _, t in items for w in set(words_of(t)))
    mean = sum(len(words_of(t)) for _, t in items) / max(1, len(items))
    out = {}
    for item, text in items:
        own = Counter(words_of(text))
        n = sum(own.values())
        weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean)) for w, c in own.items()}
        size = passage_words
        while size < 2 * n:
            size *= 2
        half = -(-size // 2)
        question, answer = halves(text)
        for doc, body in docs:
            w = words_of(body)
            for no in range(max(-(-len(w) // half) - 1, int(len(w) > 0))):
                p = w[no * half : (no + 2) * half]
                s = sum(weight[x] for x in own.keys() & set(p)) / sum(weight.values())
                if s < threshold - 1e-9:
                    continue
                q, a = share_of(question, p, gram), share_of(answer, p, gram)
                if q >= share and a >= share:
                    found = (round(s, 6), round(q, 6), round(a, 6), -no)
                    out[doc, item] = max(out.get((doc, item), found), found)
    return {k: (v[0], v[1], v[2], -v[3]) for k, v in out.items()}


def test_against_exhaustive_scoring(spark):
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.expovariate(0.02))}" for _ in range(3000)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.randrange(1, 20)) + rng.choice(["", ". " + make(4) + "."])) for i in range(60)]
    docs = []
    for k in range(120):
        w = make(rng.randrange(0, 150)).split()
        for _ in range(rng.randrange(3)):
            piece = rng.choice(items)[1].upper().split()
            if rng.random() < 0.5 and len(piece) > 3:
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece
        docs.append((k, " ".join(w)))
    items += [(100, ""), (101, items[0][1])]
    docs += [(500, None), (501, "")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([*((*r, "x") for r in items), (102, None, "x"), (None, "w1 w2", "x")], "item_id long, text string, doc_id string")
    for threshold in (0.3, 0.6):
        want = brute(docs, [x for x in items if x[1]], threshold, 0.5, 2, 30)
        got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap, r.passage_no) for r in d.contaminated(df, it, threshold, 0.5, 2, 30).collect()}
        assert got == want and len(want) > 60
    parts = d.contaminated(df, it, 0.6, 0.5, 2, 30, part_words=150).collect()
    assert {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap, r.passage_no) for r in parts} == want
    clean = {r.doc_id for r in d.without_contaminated(df, it, threshold, 0.5, 2, 30, part_words=100).collect()}
    assert clean == {k for k, _ in docs} - {k for k, _ in want}


def test_a_long_item_changes_no_other(spark):
    """Passages follow the length of the item looked for, so what is found of the others, and where, stays."""
    long = " ".join(f"q{i}" for i in range(5000))
    items = [(k, " ".join(f"w{k}x{i}" for i in range(12)) + ". and the answer") for k in range(40)]
    docs = [(1, "lead " * 300 + items[3][1] + " tail" * 300), (2, long.upper()), (3, items[5][1] + " lead" * 90 + " " + items[6][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda them: {(r.doc_id, r.item_id, r.passage_no) for r in d.contaminated(df, spark.createDataFrame(them, "item_id long, text string")).collect()}
    without = found(items)
    assert {x[:2] for x in without} == {(1, 3), (3, 5), (3, 6)}
    assert found([*items, (99, long)]) == without | {(2, 99, 0)}


def test_a_very_long_text(spark):
    item = "the item that hides here. in a very long text"
    text = " ".join(f"v{i % 50_021}" for i in range(3_000_000)) + " " + item
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(text) > 20_000_000
    assert [(r.doc_id, r.item_id) for r in d.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [(1, 7)]


def test_exact_copies_are_found_and_others_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts, leaks = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    want = {(i, k) for i, t in texts.items() for k, x in leaks.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()}
    assert want and got >= want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert d.contaminated(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b c"), (2, "a"), (None, "a b c")], "doc_id long, text string")
    assert d.contaminated(docs, items.limit(0)).collect() == []
    assert sorted((r.doc_id is None, r.item_id) for r in d.contaminated(docs, items).collect()) == [(False, 1), (True, 1)]
