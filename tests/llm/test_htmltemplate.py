from __future__ import annotations

import math
import random
import re

from citeloom.llm import htmltemplate as h


def pages(seed=1):
    """Pages of two hosts with what their slots hold, and pages of lone hosts."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for k in range(40):
        title, items, body = text(5), [text(2) for _ in range(rng.randrange(1, 6))], text(30) + f" a&amp;{rng.random()}"
        ad = f'<div class="ad">{text(4)}</div>' if k % 2 else ""
        html = (
            f'<html><head><title>{title}</title><script>if (a < b) "<p>"</script></head><body><ul>'
            + "".join(f'<li><a href="/{rng.random()}">{i}</a></li>' for i in items)
            + f"</ul>{ad}<h1>Price list: {title}</h1><div id=main>{body}<br></div><p>Contact us at the office</body></html>"
        )
        rows.append((k, f"https://Shop.example:80/{k}", html))
        want[k] = (title, items, body.replace("&amp;", "&"))
    for k in range(100, 112):
        rows.append((k, "http://news.example", f"<html><body><div><b>By</b> {text(3)} <i>on</i> {text(2)}</div></body></html>"))
    rows += [(200, "http://lone.example/", "<p>only &lt;page&gt;</p>"), (201, None, "x"), (202, "http://lone.example/x", None), (203, "http://shop.example/e", ""), (None, "http://shop.example/e", "y")]
    return rows, want


def test_template_slots(spark, monkeypatch):
    rows, want = pages()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, class string, gap int").repartition(3)
    first = sorted(tuple(r) for r in h.extract_slots(df).collect())
    slots: dict[int, list[str]] = {}
    for page, _, _, _, _, text in first:
        slots.setdefault(page, []).append(text)
    for k, (title, items, body) in want.items():
        assert slots[k].count(title) == 2 and body in slots[k]
        assert all(slots[k].count(i) >= 1 for i in items)
        assert not any("Price" in s or "Contact" in s for s in slots[k])
    assert slots[200] == ["only <page>"] and slots[201] == ["x"] and 202 not in slots and 203 not in slots
    assert all(len(slots[k]) == 2 for k in range(100, 112))
    # the way for tables too large to broadcast gives the same
    monkeypatch.setattr(h, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(h, "SALT_PAGES", 10)
    assert sorted(tuple(r) for r in h.extract_slots(df).collect()) == first


def test_classes_by_brute_force(spark):
    """Occurrence vectors compared in full give the classes that hashed sums give."""
    rows, _ = pages(5)
    rows = [r for r in rows if r[0] is not None and r[1] and "hop.example" in r[1] and r[2]]
    tokens = h.Tokens()
    vectors: dict[tuple, list[int]] = {}
    for n, (_, _, html) in enumerate(rows):
        for role in ((path, w) for path, words in h._stretches(tokens, html) for w in words):
            vectors.setdefault(role, [0] * len(rows))[n] += 1
    known = h._known([("x", *r, k) for k, r in enumerate(vectors)])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(["x"] * len(rows)), pa.array([r[2] for r in rows])], names=["a", "b", "c"])
    got: dict[tuple, set] = {}
    for out in h._count(iter([batch]), known):
        for r in out.to_pylist():
            got.setdefault((r["support"], r["total"], r["v1"], r["v2"]), set()).add(r["role_no"])
    exact: dict[tuple, set] = {}
    for role, v in vectors.items():
        exact.setdefault(tuple(v), set()).add(known["x"][role[0]][role[1]])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, exact.values()))


def test_layouts_of_one_host(spark):
    """Four layouts of a quarter of the pages each, and one of a twentieth: each has its labels taken out."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    rows, want = [], {}
    for k in range(100):
        kind = 4 if k >= 94 else k % 4
        a, b = text(6), text(6)
        t = f"h{kind + 1}"
        rows.append((k, "http://many.example/", f"<html><body><div><{t}>Label{kind} of this</{t}> {a} <{t}>Other{kind} label</{t}> {b} <{t}>Foot{kind}</{t}></div></body></html>"))
        want[k] = sorted([a, b])
    got: dict[int, list[str]] = {}
    for r in h.extract_slots(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert {k: sorted(v) for k, v in got.items()} == want


def parsed(html):
    """(role, word or None) of each token of a page of plain tags."""
    path, out = (), []
    for t in re.findall(r"<[^>]+>|[^<\s]+", html):
        if t.startswith("</"):
            path = path[: len(path) - 1 - path[::-1].index(t[2:-1])]
            out.append(((path, t), None))
        elif t.startswith("<"):
            out.append(((path, t), None))
            path = (*path, t[1:-1])
        else:
            out.append(((path, t), t))
    return out


def occurrences(tokens, classes):
    """(class, places of its roles) of each occurrence on a page, and the roles of each class in order of the page."""
    of = {role: c for c, m in classes.items() for role in m}
    where: dict[int, list[int]] = {}
    for n, (role, _) in enumerate(tokens):
        if role in of:
            where.setdefault(of[role], []).append(n)
    size = {c: len(m) for c, m in classes.items()}
    return [(c, w[i : i + size[c]]) for c, w in where.items() for i in range(0, len(w), size[c])], {c: [tokens[n][0] for n in w] for c, w in where.items()}


def innermost(found, place, but=None):
    """The occurrence around a place: (class, its number, gap)."""
    around = [(w[-1] - w[0], c, w) for c, w in found if w[0] < place < w[-1] and w is not but]
    if not around:
        return 0, 0, 0
    _, c, w = min(around)
    return c, [x for d, x in found if d == c].index(w), sum(n < place for n in w) - 1


def brute_slots(rows, share, min_roles):
    """All from the definitions, a host at a time, with full vectors and intervals in place of hashes and stacks."""
    hosts: dict[str, list] = {}
    for page, url, html in rows:
        hosts.setdefault(url, []).append((page, parsed(html)))
    slots: dict[tuple, set] = {}
    for host, pages in hosts.items():
        vectors: dict = {}
        for n, (_, tokens) in enumerate(pages):
            for role, _ in tokens:
                vectors.setdefault(role, [0] * len(pages))[n] += 1
        groups: dict[tuple, set] = {}
        for role, v in vectors.items():
            if sum(map(bool, v)) >= max(2, math.ceil(share * len(pages) - 1e-9)):
                groups.setdefault(tuple(v), set()).add(role)
        classes = dict(enumerate((m for m in groups.values() if len(m) >= min_roles), 1))
        while True:
            bad, order, parent = set(), {}, {}
            for _, tokens in pages:
                found, roles = occurrences(tokens, classes)
                for c, rs in roles.items():
                    k = len(classes[c])
                    order.setdefault(c, set()).add(tuple(rs[:k]))
                    if len(set(rs[:k])) < k or rs != rs[:k] * (len(rs) // k):
                        bad.add(c)
                found = [o for o in found if o[0] not in bad]
                assert not any(a[0] < b[0] < a[-1] < b[-1] for _, a in found for _, b in found), "layouts of this test don't cross"
                for c, w in found:
                    d, _, gap = innermost(found, w[0], w)
                    parent.setdefault(c, set()).add((d, gap))
            bad |= {c for t in (order, parent) for c, x in t.items() if len(x) > 1}
            if not bad:
                break
            classes = {c: m for c, m in classes.items() if c not in bad}
        of = {role for m in classes.values() for role in m}
        for page, tokens in pages:
            found, _ = occurrences(tokens, classes)
            held: dict[tuple, list[str]] = {}
            for n, (role, word) in enumerate(tokens):
                if role not in of and word:
                    held.setdefault(innermost(found, n), []).append(word)
            for (c, k, gap), words in held.items():
                slots.setdefault((host, c), set()).add((page, k, gap, " ".join(words)))
    return {(host, c == 0, frozenset(s)) for (host, c), s in slots.items()}


def test_whole_by_brute_force(spark):
    """Classes, validity, nesting and slots of nested layouts, lists in them, and words out of order."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(6000)}" for _ in range(n))
    rows = []
    for k in range(90):
        host = f"http://h{k % 3}.example/"
        items = "".join(f"<i> item no </i> {text(1)} <b> price </b> {text(2)} <s> unit </s>" for _ in range(rng.randrange(1, 4)))
        swapped = ("up down over" if k % 2 else "over up down") if k % 7 else ""
        special = f"<h2> kind </h2> {text(2)} <h3> special offer </h3>" if k % 4 == 0 else ""
        nested = f"<em> note </em> {text(2)} <u> end of note </u>" if k % 5 else ""
        rows.append((k, host, f"<html><body><div> Title of page : {text(3)} </div><span> {items} </span> {text(4)} <strong> {swapped} </strong><code> {special} </code><q> {nested} </q><p> Foot of page {text(1)} here </p></body></html>"))
    got: dict[tuple, set] = {}
    for r in h.extract_slots(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect():
        got.setdefault((f"http://{r.host}/", r["class"]), set()).add((r.page_id, r.occurrence, r.gap, r.text))
    want = brute_slots(rows, h.MIN_SUPPORT, h.MIN_ROLES)
    assert {(host, c == 0, frozenset(x)) for (host, c), x in got.items()} == want and len(want) >= 9


def old_pieces(page):
    form = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[A-Za-z/!?][^>]*>", re.S | re.I)
    return [(m.start(), m.end(), (m.group(1) or "").lower()) for m in form.finditer(page)]


def test_markup_is_cut_as_by_the_plain_pattern():
    rng = random.Random(4)
    parts = ["<b>", "</b>", "<!--", "-->", "<script>", "<SCRIPT x='>'>", "</script >", "</script x>", "<style>", "</style>", "<", ">", "a", " ", "<!doctype html>", "<br/>", "<p class=x", "--", "<scripty>"]
    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert list(h.pieces(page)) == old_pieces(page), page


def test_long_deep_and_broken_pages(spark):
    """What nothing closes takes one pass: 200,000 open tags, comments, scripts and angles, and a text of 20 MB."""
    broken = ["<b>" * 200_000 + "x", "<b>" * 100_000 + "</i>" * 100_000, "<!--" * 200_000, "<script>" * 200_000, "<a" * 200_000, "<script></script x>" * 50_000, "<p>" * 100_000 + "<div>" * 100_000, "</p>" * 200_000]
    rows = [(k, "http://broken.example", page) for k, page in enumerate(broken)] + [(99, "http://long.example", "<p>" + "some text " * 2_100_000)]
    got = h.extract_slots(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert by[0] == "x" and len(by[99]) > 20_000_000 and 1 not in by


def test_no_pages(spark):
    assert h.extract_slots(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
