from __future__ import annotations

import random
import re

import pytest

from citeloom.llm import components, ngramjoin
from citeloom.llm.components import connected_components


def grams(text, n):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def brute(rows, n, t):
    texts: dict[int, set[str]] = {}
    for d, text in rows:
        if d is not None:
            texts.setdefault(d, set()).add((text or "").lower())
    sets = sorted((d, grams("\n".join(sorted(t)), n)) for d, t in texts.items())
    out = {}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            o = len(x & y)
            if o and o / len(x | y) >= t - 1e-12:
                out[a, b] = (o, round(o / len(x | y), 6))
    return out


def found(rows):
    rows = [tuple(r) for r in rows]
    pairs = {(a, b): (o, j) for a, b, o, j in rows}
    assert len(pairs) == len(rows)
    return pairs


def test_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(150):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w) + 1) : 0] = [rng.choice(words)]
        else:
            w = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        rows.append((d * 1_000_003 - 50, " ".join(w)))
    rows += [(9, ""), (10, None), (11, "One two"), (12, "one  TWO!"), (13, "solo"), (None, rows[3][1]), rows[3], rows[4], (rows[5][0], rows[6][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, size int, grams int")
    for t, per in ((0.5, 4_000_000), (0.8, 60), (1.0, 300)):
        got = found(ngramjoin.near_pairs(docs, 2, t, per).collect())
        want = brute(rows, 2, t)
        assert got == want and len(want) > 10


def test_one_group_of_most_documents(spark, monkeypatch):
    """Near copies of one text, and copies of those: they meet in blocks of bounded size, with the same pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(160):
        w = list(base)
        w[rng.randrange(20)] = f"u{d % 120}"
        rows.append((d, " ".join(w)))
    rows += [(d, " ".join(rng.choices([f"z{i}" for i in range(400)], k=40))) for d in range(200, 240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 0.6)
    assert found(ngramjoin.near_pairs(docs, 3, 0.6).collect()) == want and len(want) > 10_000
    monkeypatch.setattr(ngramjoin, "HOT", 9)
    monkeypatch.setattr(ngramjoin, "CELL_PAIRS", 500)
    assert found(ngramjoin.near_pairs(docs, 3, 0.6, 1000).collect()) == want
    pairs = spark.createDataFrame([(a, b) for a in range(200) for b in range(a + 1, 200)], "a long, b long")
    placed, wanted = ngramjoin._cells(pairs, 1, 500)
    cells = {r.doc_id: set(r.cells) for r in placed.collect()}
    sizes: dict = {}
    for r in wanted.collect():
        assert r.cell in cells[r.a] & cells[r.b]
        sizes[r.cell] = sizes.get(r.cell, 0) + 1
    assert sum(sizes.values()) == 19900 and max(sizes.values()) < 6 * 500


def test_compressed_form_stands_for_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole, sets = found(ngramjoin.near_pairs(docs).collect()), found(ngramjoin.near_sets(docs).collect())
    assert sets.items() <= whole.items()


def test_one_of_each_group(spark):
    a = " ".join(f"x{i}" for i in range(60))
    rows = [(5, a, "en"), (2, a + " more", "en"), (7, a.upper(), "de"), (9, "quite another text", "en"), (None, a, "en"), (11, None, "en"), (12, "", "en")]
    kept = ngramjoin.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, node string"))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 9, 11, 12]


def test_very_long_texts(spark):
    """Two texts of 20 MB, of which one has a tenth of its words changed, among short ones."""
    words = [f"v{i % 70_001}x{i // 70_001}" for i in range(2_100_000)]
    other = [w if i % 30 else "changed" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "one two three four"), (4, "one two three four five")]
    assert len(rows[0][1]) > 18_000_000
    got = found(ngramjoin.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(got) == {(1, 2), (3, 4)} and 0.75 < got[1, 2][1] < 0.85


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c")]])
def test_no_pairs(spark, rows):
    assert ngramjoin.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_components(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1), (2, None)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    for a, b in real:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    want = {x: find(x) for p in real for x in p}
    for limit in (components.ONE_TASK, 0):
        monkeypatch.setattr(components, "ONE_TASK", limit)
        got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)


def classes(rows, n, t):
    """{doc_id: (class, links)} by brute force over all pairs."""
    pairs = brute(rows, n, t)
    label = {d: d for d, _ in rows if d is not None}
    links = dict.fromkeys(label, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return {d: (label[d], links[d]) for d in label}


def classed(df):
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == ["doc_id", "class_id", "links"] and len({r[0] for r in rows}) == len(rows)
    return {d: (c, k) for d, c, k in rows}


def test_classes_and_links_against_brute_force(spark, monkeypatch):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(300)]
    rows = [(d, " ".join(rng.choices(words[:40], k=rng.randrange(0, 12)))) for d in range(60)]
    for d in range(60, 260):  # copies of copies, so that classes are chains as well as heaps
        w = rng.choice(rows)[1].split()
        w[rng.randrange(len(w) + 1) : rng.randrange(len(w) + 1)] = rng.choices(words, k=rng.randrange(0, 3))
        rows.append((d * 7, " ".join(w)))
    rows += [(9999, None), (9998, ""), (None, rows[3][1]), rows[4], (rows[70][0], rows[71][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for t in (0.5, 0.7, 1.0):
        want = classes(rows, 2, t)
        assert classed(ngramjoin.near_classes(docs, 2, t)) == want and max(k for _, k in want.values()) > 1
    for name, value in (("HOT", 5), ("CELL_PAIRS", 50), ("BLOCK", 4), ("STEP_GRAMS", 60), ("HELD_PAIRS", 30)):
        monkeypatch.setattr(ngramjoin, name, value)
    assert classed(ngramjoin.near_classes(docs, 2, 0.5, 300)) == classes(rows, 2, 0.5)


def test_rows_and_candidates_grow_with_documents(spark, monkeypatch):
    """A heap of near copies has pairs as its square: neither the result nor the candidates do."""
    rng = random.Random(8)
    listed = []
    verified = ngramjoin._verified
    monkeypatch.setattr(ngramjoin, "_verified", lambda sole, candidates, *rest: listed.append(candidates.count()) or verified(sole, candidates, *rest))
    base = [f"w{i}" for i in range(90)]
    rows = []
    for d in range(600):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(90)] = f"u{rng.randrange(40)}"
        rows.append((d, " ".join(w)))
    got = classed(ngramjoin.near_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    want = classes(rows, 3, 0.5)
    assert got == want and sum(k for _, k in want.values()) > 100_000
    assert sum(listed) < 60 * len(rows)


@pytest.mark.parametrize("shape", [(3, 200), (40, 60), (120, 3000)])
def test_products(shape, monkeypatch):
    """Dense and by lists, whole and in steps, the overlaps of two documents are those of sets."""
    import numpy as np

    rng = random.Random(sum(shape))
    raw = [np.array(sorted(rng.sample(range(shape[1]), rng.randrange(0, 60))), np.uint64) for _ in range(shape[0])]
    everything, some = np.arange(len(raw)), np.arange(0, len(raw), 2)
    for step in (1_000_000, 30):
        monkeypatch.setattr(ngramjoin, "STEP_GRAMS", step)
        for left, right in ((everything, everything), (some, np.setdiff1d(everything, some))):
            want = np.array([[len(set(raw[a].tolist()) & set(raw[b].tolist())) for b in right] for a in left])
            apart = left[:, None] != right[None, :]
            assert (ngramjoin._products(raw, left, right)[apart] == want[apart]).all()


def test_candidates_come_in_parts():
    """All pairs between groups, none within one, and never more than a bound at once."""
    import numpy as np
    import pyarrow as pa

    n = 400
    group = np.where(np.arange(n) < 300, 0, np.arange(n))
    columns = {"gram": np.repeat([5, 6], n), "doc_id": np.tile(np.arange(n), 2), "size": np.full(2 * n, 9), "group": np.tile(group, 2), "side": np.zeros(2 * n, np.int8)}
    parts = [list(zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)) for b in ngramjoin._candidates(0.5, 1000)((), pa.table(columns))]
    want = {(a, b) for a in range(n) for b in range(max(a + 1, 300), n)}
    assert {p for part in parts for p in part} == want and max(map(len, parts)) <= 2000 and len(want) == 34_950


def test_memory_of_a_task_is_bounded():
    """Two tasks share with their executor's JVM what it has: a group's work may not take some hundred megabytes."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)

    def peak(work):
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    def candidates():
        n, grams = 3000, 4
        ids = np.tile(np.arange(n), grams)
        table = pa.table({"gram": np.repeat(np.arange(grams), n), "doc_id": ids, "size": np.full(n * grams, 9), "group": ids, "side": np.zeros(n * grams, np.int8)})
        for _ in ngramjoin._candidates(0.5, ngramjoin.HELD_PAIRS)((), table):
            pass

    docs = 20_000
    raw = [np.unique(rng.integers(7 << 36, 8 << 36, 130)).astype(np.uint64) for _ in range(docs)]
    left = pa.table({"doc_id": rng.permutation(docs), "size": [2 * len(g) for g in raw], "grams": [g.tobytes() for g in raw]})
    right = pa.table({"a": np.arange(docs // 2), "b": np.arange(docs // 2, docs)})
    edges = [rng.integers(0, 1_500_000, (2, 10_000)) for _ in range(200)]
    forest = [pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"]) for u, v in edges]
    assert peak(candidates) < 120
    assert peak(lambda: ngramjoin._overlaps(left, right)) < 130
    assert peak(lambda: list(components._contract(iter(forest)))) < 220


@pytest.mark.parametrize("wide", [False, True])
def test_overlaps_against_sets(wide, monkeypatch):
    """Rows in any order and of any chunks, absent documents, no n-grams in a part, and a range of n-grams too wide to be a key."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    values = rng.integers(0, (1 << 63) if wide else 90, 90).astype(np.uint64) * np.uint64(2 if wide else 1)
    sets = {int(d): np.unique(rng.choice(values, rng.integers(0, 40))) if d % 7 else values[:0] for d in rng.permutation(60)}
    rows = {"doc_id": list(sets), "size": [len(g) + d for d, g in sets.items()], "grams": [g.tobytes() for g in sets.values()]}
    left = pa.concat_tables([pa.table(rows).slice(0, 23), pa.table(rows).slice(23)])
    pairs = [(a, b) for a in range(0, 64, 3) for b in range(64) if a != b]
    right = pa.table({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]})
    both = [a in sets and b in sets for a, b in pairs]
    want = [(len(np.intersect1d(sets[a], sets[b])), len(sets[a]) + len(sets[b]) + a + b) if ok else (0, 0) for ok, (a, b) in zip(both, pairs, strict=True)]
    for step in (1_000_000, 50):
        monkeypatch.setattr(ngramjoin, "STEP_GRAMS", step)
        got = ngramjoin._overlaps(left, right)
        assert list(zip(got["overlap"].to_pylist(), got["sizes"].to_pylist(), strict=True)) == want
    assert ngramjoin._overlaps(left.slice(0, 0), right)["overlap"].to_pylist() == [0] * len(pairs)


def test_forests_meet_in_between(spark, monkeypatch):
    """More edges than one task takes, in many parts over few nodes: forests of forests, and then one task."""
    rng = random.Random(9)
    edges = [(rng.randrange(40) * 5 + k, rng.randrange(40) * 5 + k) for k in range(5) for _ in range(400)]
    pairs = spark.createDataFrame(edges, "a long, b long").repartition(8)
    monkeypatch.setattr(components, "ONE_TASK", 450)
    monkeypatch.setattr(components, "_star", None)
    want = {x: x % 5 + 5 * min(e[0] // 5 for p in edges if p[0] % 5 == x % 5 for e in [(min(p),)] if p[0] != p[1]) for p in edges if p[0] != p[1] for x in p}
    assert {r.node: r.component for r in connected_components(pairs).collect()} == want


def test_batches_to_the_jvm_are_small():
    """The postings of a bucket, and of n-grams of many documents, go in parts, with every row."""
    import numpy as np
    import pyarrow as pa

    n, grams = 7000, 30
    ids = np.tile(np.arange(n), grams)
    table = pa.table({"gram": np.repeat(np.arange(grams), n), "doc_id": ids, "size": np.full(n * grams, 9), "group": ids})
    for hot, copies in ((n, 1), (n // 2, 2)):
        rows = [b.num_rows for b in ngramjoin._meetings(5, hot)((), table)]
        assert sum(rows) == copies * n * grams and max(rows) <= 65_536
