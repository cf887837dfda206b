"""Quality rules, licence scans and word hashing: operators that look at one row at a time."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from citeloom.llm import licenses, quality
from citeloom.llm.license_templates import TEMPLATES
from citeloom.llm.words import distinct_grams, gram_hashes, word_runs


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def test_word_hashes_tell_words_apart():
    rng = random.Random(8)
    texts = ["", None, "A b", "a-B_c", "straße 東京 x", "\0a\0", *(" ".join(rng.choice(["ab", "ba", "a", "b", "aa", "é", "e"]) for _ in range(rng.randrange(9))) for _ in range(60))]
    known: dict[str, int] = {}
    seen = []
    for column in (pa.array(texts), pa.array(["pad", *texts]).slice(1), pa.array(texts, pa.large_string())):
        got = []
        for _, _, h, at, start, end in word_runs(column):
            got += [h[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
            assert (end > start).all()
        assert [len(g) for g in got] == [len(words(t)) for t in texts]
        for g, t in zip(got, texts, strict=True):
            for h, w in zip(g, words(t), strict=True):
                assert known.setdefault(w, h) == h
        seen.append(got)
    assert seen[0] == seen[1] == seen[2] and len(set(known.values())) == len(known)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_grams(n):
    texts = ["a b c a b c a", "a b", "a", "", "c a b c"]
    for _, _, h, at, *_ in word_runs(pa.array(texts)):
        g, out = gram_hashes(h, at, n)
        u, uo = distinct_grams(g, out)
        for k, t in enumerate(texts):
            w = words(t)
            grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
            assert out[k + 1] - out[k] == len(grams) and uo[k + 1] - uo[k] == len(set(grams))
            assert len(set(zip(grams, g[out[k] : out[k + 1]].tolist(), strict=True))) == len(set(grams))


def brute_repetition(t, m):
    n = len(t)
    covered, longest = [False] * n, 0
    for size in range(n - 1, m - 1, -1):
        where: dict[str, list[int]] = {}
        for i in range(n - size + 1):
            where.setdefault(t[i : i + size], []).append(i)
        for places in where.values():
            if len(places) > 1:
                longest = max(longest, size)
                for p in places:
                    covered[p : p + size] = [True] * size
    return n, sum(covered), longest


def test_suffix_array_by_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        alphabet = rng.choice(["ab", "abc", "a", "éüabcd", "日本語ab\0", "ÿþa", "".join(map(chr, range(300, 900)))])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        if t and rng.random() < 0.6:
            k = rng.randrange(len(t))
            t += t[k : k + rng.randint(1, 40)] + t[:3]
        for m in (1, 3, 9, 12):
            if len(t) > m:
                assert quality.repetition(t, m)[:3] == brute_repetition(t, m)


def test_long_repetitive_texts():
    line = "one and the same line, over and over\n"
    n = 60_000 * len(line)
    assert quality.repetition(line * 60_000)[:3] == (n, n, n - len(line))
    rng = random.Random(6)
    half = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    assert quality.repetition(half + "|" + half)[:3] == (300_001, 300_000, 150_000)


def test_words_of_a_long_text_are_hashed_in_pieces():
    text = " ".join(f"w{i % 997}é" for i in range(40_000)) + " " + "q" * 30_000 + "  end"
    whole, pieces = (next(iter(word_runs(pa.array([text]), size)))[2:] for size in (1 << 30, 1 << 10))
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def test_rules(spark):
    rng = random.Random(2)
    clean = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(4000))
    part = clean[:1200]
    rows = [(1, clean), (2, "x" * 50_000), (3, "spam and eggs " * 40), (4, None), (5, ""), (6, "short"), (None, clean), (7, clean + part), (1, clean), (8, "日" * 30)]
    got = quality.repetition_rules(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, keep string")).collect()
    keep = [(r.doc_id, r.keep) for r in got]
    assert sorted(keep, key=str) == sorted([(1, True), (2, False), (3, False), (4, True), (5, True), (6, True), (None, True), (7, False), (1, True), (8, True)], key=str)
    by = {r.doc_id: r for r in got}
    assert (by[2].covered_chars, by[2].longest_repeat) == (50_000, 49_999) and by[7].longest_repeat >= 1200 and by[1].covered_chars == 0
    assert by[7].covered_chars < 0.5 * by[7].n_chars and (by[4].n_chars, by[4].covered_chars) == (0, 0)


def brute_licences(rows, t):
    def grams(text):
        w = words(text)
        return set(zip(w[:-1], w[1:], strict=True))

    known = [(k, name, grams(body)) for k, (name, body) in enumerate(TEMPLATES)]
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        blocks, k = [[]], 0
        for n, line in enumerate(lines):
            if 0 < n < len(lines) - 1 and not words(line):
                if blocks[-1] or n == 1 or words(lines[n - 1]):
                    blocks.append([]) if not (n > 1 and not words(lines[n - 1])) else None
                continue
            blocks[-1].append(line)
        units = [("line", n, line) for n, line in enumerate(lines)]
        units += [("paragraph", n, "\n".join(b)) for n, b in enumerate(blocks) if sum(1 for x in b if words(x)) > 1]
        if sum(1 for b in blocks if words("\n".join(b))) > 1:
            units.append(("document", 0, text))
        for kind, n, body in units:
            a = grams(body)
            found = [(round(2 * len(a & b) / (len(a) + len(b)), 6), -k, name, len(a & b)) for k, name, b in known if a and b and 2 * len(a & b) >= t * (len(a) + len(b)) - 1e-9]
            if found:
                dice, k, name, shared = max(found)
                out.append((d, kind, n, n, name, -k, shared, dice))
        filled = [n for n, b in enumerate(blocks) if words("\n".join(b))]
        best = {}
        for x, i in enumerate(filled):
            for y, j in enumerate(filled):
                if x < y and y - x < len(filled) - 1:
                    a = grams("\n".join("\n".join(blocks[n]) for n in filled[x : y + 1]))
                    for k, name, b in known:
                        shared = len(a & b)
                        if len(b) >= 40 and 2 * shared >= t * (len(a) + len(b)) - 1e-9:
                            one = (round(2 * shared / (len(a) + len(b)), 6), x - y, -i, -k, shared, j)
                            best[name] = max(best.get(name, one), one)
        out += [(d, "span", -i, j, name, -k, shared, dice) for name, (dice, _, i, k, shared, j) in best.items()]
    return out


def in_paragraphs(text, n):
    """The words of a text in paragraphs of n."""
    w = text.split()
    return "\n\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_licences_by_brute_force(spark):
    rng = random.Random(6)
    filler = "some ordinary words of no licence at all"
    rows = []
    for d in range(60):
        name, body = rng.choice(TEMPLATES)
        w = body.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        if rng.random() < 0.5 and len(w) > 30:
            cut = rng.randrange(10, len(w) - 10)
            body = " ".join(w[:cut]) + "\n" + " ".join(w[cut:])
        else:
            body = " ".join(w).upper()
        rows.append((d, rng.choice([body, f"{filler}\n\n{body}\n\n{filler}", f"{body}\n{filler}", f"Copyright 2020\n***\n{body}", f"{filler} {body}"])))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "a"), (None, "Released under the MIT License."), (104, "the of " * 20_000), (0, rows[0][1])]
    for d in range(200, 230):
        name, body = rng.choice([x for x in TEMPLATES if 60 < len(x[1].split()) < 400])
        rows.append((d, f"{filler}\n\n{in_paragraphs(body, rng.choice([25, 50]))}\n#\n{filler} {d}\n{filler}" + rng.choice(["", f"\n\n{in_paragraphs(rng.choice(TEMPLATES)[1], 40)}"])))
    docs = spark.createDataFrame([(*r, "l", 2) for r in rows], "doc_id long, text string, license string, unit int")
    for t in (0.8, 0.6):
        got = sorted((tuple(r) for r in licenses.license_scan(docs, t).collect()), key=str)
        want = sorted(brute_licences(rows, t), key=str)
        assert got == want and len(want) > 60 and sum(w[1] == "span" for w in want) > 20


def test_full_licences_above_code(spark):
    """Texts of the licences in their own layout, and headers in paragraphs, with code below."""
    code = "\n\n".join(f"def f{k}(x):\n    return x + {k}" for k in range(60))
    full = [x for x in TEMPLATES if len(x[1]) > 5000]
    rows = [(k, body + "\n\n" + code) for k, (_, body) in enumerate(full)] + [(50, "# " + in_paragraphs(dict(TEMPLATES[8:12])["gpl-3.0"], 45).replace("\n", "\n# ") + "\n\n" + code), (51, code)]
    got = {(r.doc_id, r.license) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.unit in ("span", "document")}
    assert len(full) == 8 and {(k, name) for k, (name, _) in enumerate(full)} <= got and (50, "gpl-3.0") in got and not any(d == 51 for d, _ in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.license_scan(none).collect() == [] and quality.repetition_rules(none).collect() == []
