from __future__ import annotations

import random

import pytest

from citeloom.llm import linededup


def near(a, b):
    """Whether one edit at most makes a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(rows, least):
    """{(doc_id, line_no): earliest place within one edit, or equal if the line is short} of the lines that have an earlier one."""
    lines = [((d, k), line.strip(" ")) for d, t in rows if d is not None and t is not None for k, line in enumerate(t.split("\n"))]
    lines, out, first = sorted(lines), {}, {}
    for p, x in lines:
        if x.strip() and len(x) < least and first.setdefault(x, p) != p:
            out[p] = first[x]
    lines = [(p, x) for p, x in lines if len(x) >= least]
    seen: list[tuple[str, tuple]] = []
    exact: dict[str, tuple] = {}
    for p, x in lines:
        if x in exact and exact[x] in out:
            out.setdefault(p, out[exact[x]])
        else:
            hit = next((q for y, q in seen if q < p and near(x, y)), None)
            if hit is not None:
                out.setdefault(p, hit)
        if x not in exact:
            exact[x] = p
            seen.append((x, p))
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randrange(6, 30))) for _ in range(60)] + ["aaaaaaaaaa", "aaaaaaaaaaa", "ababababab"]

    def edit(x):
        k, c = rng.randrange(len(x)), rng.choice("abxé日")
        return rng.choice([x, x[:k] + x[k + 1 :], x[:k] + c + x[k:], x[:k] + c + x[k + 1 :], x + c, c + x, " " + x + "  "])

    rows = []
    for d in range(120):
        rows.append((rng.choice([d, d + 500]) * 3, "\n".join(edit(edit(rng.choice(base))) if rng.random() < 0.5 else edit(rng.choice(base)) for _ in range(rng.randrange(0, 7)))))
    rows += [(7000, None), (7001, ""), (7002, "x" * 30_000), (7003, "x" * 29_999 + "y"), (None, base[0]), (7004, "short"), (7005, "short")]
    docs = spark.createDataFrame([(*r, "l", 3) for r in rows], "doc_id long, text string, line string, line_no int")
    got = {(r.doc_id, r.line_no): (r.earlier_doc_id, r.earlier_line_no) for r in linededup.duplicate_lines(docs, 6).collect()}
    want = brute(rows, 6)
    assert got == want and len(want) > 100
    assert sum(1 for p, q in want.items() if q != p) > 50


def test_exact_copies_of_short_lines_go(spark):
    rng = random.Random(4)
    pool = ["Les.", "Les", "}", "é日", "Share this", " Les. ", "", "  ", "\t", "a line that is long enough to be compared", "a line that is long enough to be compared!"]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for d in range(60)] + [(None, "Les."), (99, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, e int")
    got = {(r.doc_id, r.line_no): (r.earlier_doc_id, r.earlier_line_no) for r in linededup.duplicate_lines(docs).collect()}
    want = brute(rows, 20)
    assert got == want and len(want) > 60


def test_a_key_that_all_lines_share(spark):
    """Templated lines, all within one edit of another and sharing a block: no window holds them."""
    line = "a template of some length that all of these lines share, number "
    rows = [(d, f"{line}{d:06d}\nown text of document {d * 7919:09d} and no other") for d in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = linededup.duplicate_lines(docs)
    assert "Window" not in found._jdf.queryExecution().toString()
    got = {r.doc_id for r in found.where("line_no = 0").collect()}
    one = lambda a, b: sum(x != y for x, y in zip(f"{a:06d}", f"{b:06d}")) == 1
    assert got == {d for d in range(3000) if any(one(d, d - s * p) for p in (1, 10, 100, 1000) for s in range(1, 10) if d - s * p >= 0)}


def test_without_broadcasts(spark, monkeypatch):
    """Tables too large to broadcast are joined by shuffle, with the same result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = sorted(map(tuple, linededup.duplicate_lines(docs).collect()))
    monkeypatch.setattr(linededup, "small", lambda table, *_: table)
    assert sorted(map(tuple, linededup.duplicate_lines(docs).collect())) == first and first


def test_texts_are_rebuilt(spark):
    a, b = "the first line, which is long enough", "another line, which is long enough too"
    rows = [(1, f"{a}\nx\n{b}", 99), (2, f"{b}\nkept\n\n{a}!", 99), (3, f"{a}\n  ", 99), (4, "short\nshort", 99), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.without_duplicate_lines(docs).collect()}
    assert got == {1: (f"{a}\nx\n{b}", 99), 2: ("kept\n", 5), 4: ("short", 5), 5: (None, None)}


def test_bounds(spark):
    with pytest.raises(ValueError):
        linededup.duplicate_lines(spark.createDataFrame([], "doc_id long, text string"), 3)
    assert linededup.duplicate_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
