"""Ladders, comparisons, verdicts and reports; every accusation needs its evidence."""

from __future__ import annotations

import urllib.error

import pytest
from pyspark.sql import functions as F

from citeloom.functions.text import key_sets
from citeloom.operators import style, triage
from citeloom.operators.compare import authors_apart, raw_agreement, year_differs
from citeloom.operators.resolve import by_identifier, credible, fitting, look_up, verify_arxiv
from citeloom.operators.titlejoin import title_candidates
from citeloom.plans import audit
from citeloom.sources import bibtex, http
from citeloom.sources import registry as reg
from citeloom.sources.structured import STRUCTURED, structured_refs

RECORD = "registry_id long, " + reg.RECORD


def registry(spark, *rows):
    """Rows of (id, source, title, families, years, doi, arxiv, ctype)."""
    full = [(i, s, t, f, y[0] if y else None, y, d, a, c, None) for i, s, t, f, y, d, a, c in rows]
    return spark.createDataFrame(full, "registry_id long, source string, title string, families array<string>, year string, years array<string>, doi string, arxiv string, ctype string, venue string")


BASE = [
    (1, "crossref", "Attention Is All You Need", ["Vaswani", "Shazeer"], ["2017"], "10.1/Att", None, "proceedings-article"),
    (2, "datacite", "A dataset of things", ["Zhao"], ["2020"], "10.5281/zen", None, None),
    (3, "arxiv", "Decoupled Weight Decay Regularization", ["Ilya Loshchilov", "Frank Hutter"], ["2017"], None, "1711.05101", None),
    (4, "crossref", "Is Attention All You Need?", ["Mancini"], ["2025"], "10.1/book", None, "book-chapter"),
    (5, "crossref", "Graph based image segmentation", ["Chan"], ["2004"], "10.1/thesis", None, "dissertation"),
    (6, "openalex", "A quite particular open title", ["Müller"], ["2019"], None, None, None),
    (7, "s2", "Known only by the matcher", None, [], None, None, None),
    (8, "s2", "A title the matcher leads on from", None, [], "10.1/led", None, None),
    (9, "crossref", "Led to by another title", ["Abel"], ["2001"], "10.1/LED", None, None),
    (10, "crossref", "", [], [], "10.1/empty", None, None),
]


def structured(spark, *refs):
    names = [f.split(" ")[0] for f in STRUCTURED.split(", ")]
    rows = [("b", k, *({"n": str(k), "kind": "article", **r}.get(c) for c in names)) for k, r in enumerate(refs, 1)]
    return spark.createDataFrame(rows, f"bib string, pos int, {STRUCTURED}")


def judge(spark, *refs, down=(), compat=False):
    off = spark.createDataFrame([(f"b#{k}", s) for k, s in down], "ref_id string, source string")
    out = audit.audit_structured(structured(spark, *refs), registry(spark, *BASE), off, compat).orderBy("pos").collect()
    return [(r.verdict, r.how, sorted(f.priority for f in r.findings)) for r in out]


def test_structured_ladder(spark):
    got = judge(
        spark,
        {"doi": "10.1/ATT", "title": "Attention is all you need", "authors": ["Vaswani, A.", "Noam Shazeer"], "year": "2017"},
        {"doi": "10.5281/zen", "title": "A dataset of things", "authors": ["Zhao, B."], "year": "2020"},
        {"arxiv": "1711.05101v3", "title": "Decoupled weight decay regularization", "authors": ["Loshchilov, I.", "Hutter, F."], "year": "2019"},
        {"arxiv": "1711.99999", "doi": "10.1/att"},
        {"doi": "10.1/none", "title": "x"},
        {"title": "Attention is all you need", "authors": ["Vaswani, A."], "year": "2017"},
        {"title": "A quite particular open title", "authors": ["Mueller, K."], "year": "2019"},
        {"title": "Known only by the matcher", "authors": ["Anyone"], "year": "1999"},
        {"title": "A title the matcher leads on from", "authors": ["Abel, A."], "year": "2001"},
        {"title": "Nothing that any registry has ever held"},
        {"title": "An agency's report", "kind": "report"},
        {"title": "Blinded work", "anonymized": True},
        {"raw": "only text"},
        {"arxiv": "1711.051", "title": "cut"},
        {"doi": "10.1/att", "title": "Zebra fish genomics in brief", "authors": ["Vaswani"], "year": "2017"},
        {"doi": "10.1/att", "title": "Attention is all you need", "authors": ["Vaswani", "Nobody, N."], "year": "2015"},
        {"title": "Efficient graph-based image segmentation", "authors": ["Felzenszwalb", "Huttenlocher"]},
        {"doi": "10.1/empty", "title": "Whatever", "authors": ["Abel"], "year": "2000"},
    )
    assert [g[:2] for g in got[:4]] == [("OK", "crossref:doi"), ("OK", "datacite:doi"), ("OK", "arxiv"), ("FABRICATED", "arxiv")]
    assert got[3][2] == got[4][2] == [2] and got[4][0] == "FABRICATED"
    assert [g[:2] for g in got[5:8]] == [("OK", "crossref:search"), ("OK", "openalex"), ("OK", "s2:match")]
    assert got[8][1] == "s2->crossref" and got[8][0] in ("OK", "CHECK", "FABRICATED")
    assert got[9] == ("NOT FOUND", "search:4-sources", [1])
    assert got[10] == ("UNVERIFIABLE", "grey", [3]) and got[11] == ("UNVERIFIABLE", "grey", [])
    assert got[12][:2] == ("NOT FOUND", "no-title") and got[13] == ("CHECK", "arxiv:malformed", [3])
    assert got[14] == ("FABRICATED", "crossref:doi", [2])
    assert got[15] == ("CHECK", "crossref:doi", [2, 3])
    assert got[16][0] == "NOT FOUND" and got[17][0] == "OK"
    assert judge(spark, {"arxiv": "1711.051", "title": "cut"}, compat=True)[0][0] == "NOT FOUND"


def test_unavailable_is_never_absent(spark):
    refs = [{"doi": "10.1/none"}, {"arxiv": "1711.99999"}, {"doi": "10.1/none"}, {"title": "Nothing that any registry has ever held"}, {"title": "Nothing that any registry has ever held"}]
    down = [(1, "crossref"), (2, "arxiv"), (3, "datacite"), (4, "s2"), (4, "crossref"), (5, "s2"), (5, "crossref"), (5, "openalex")]
    assert [g[0] for g in judge(spark, *refs, down=down)] == ["LOOKUP FAILED"] * 3 + ["NOT FOUND", "LOOKUP FAILED"]
    # with nothing down, more sources never make a verdict worse
    assert judge(spark, refs[3])[0][1] == "search:4-sources" and judge(spark, refs[3], down=[(1, "s2")])[0][1] == "search:3-sources"


def test_binds(spark):
    from citeloom.functions.text import norm_col, squash_col

    rows = [
        ("Efficient graph-based image segmentation", ["Felzenszwalb"], "Graph based image segmentation", ["Chan"], None, False),
        ("Attention is all you need", ["Vaswani, A."], "Is Attention All You Need?", ["Mancini"], None, False),
        ("Attention is all you need", ["Vaswani, A."], "Attention is All you Need", ["Vaswani", "Shazeer"], None, True),
        ("Deep residual learning", ["He, K."], "Deep residual learning", ["Nakamura"], None, False),
        ("Deep residual learning", [], "Deep residual learning", ["He"], None, True),
        ("", ["He"], "", ["He"], None, False),
        ("Ещё одно", [], "Другое", [], None, False),
        ("Deep residual learning", [], "Deep residual learning", [], "dissertation", False),
    ]
    df = spark.createDataFrame([(k, *r[:5]) for k, r in enumerate(rows)], "k int, t string, a array<string>, rt string, ra array<string>, ctype string")
    df = df.select("k", norm_col(F.col("t")).alias("norm"), norm_col(F.col("rt")).alias("rec_norm"), F.flatten(key_sets(F.col("a"))).alias("keys"), F.flatten(key_sets(F.col("ra"))).alias("rec_keys"), "ctype", F.lit("").alias("described"))
    df = df.withColumns({"squash": squash_col(F.col("norm")), "rec_squash": squash_col(F.col("rec_norm"))})
    assert {r.k for r in credible(df).collect()} == {k for k, r in enumerate(rows) if r[5]}


def test_authors_are_named_right(spark):
    rows = [(["??", "Real, R.", "Ghost, G."], ["Real", "Other", "More", "Most"])]
    df = spark.createDataFrame(rows, "c array<string>, k array<string>").select("c", key_sets(F.col("c")).alias("ck"), key_sets(F.col("k")).alias("kk"))
    get = lambda compat, cut=False: df.select(authors_apart(F.col("c"), F.col("ck"), F.col("kk"), F.lit(cut), compat).alias("r")).first().r
    assert get(False).invented == ["Ghost, G."] and get(False).missing == 3 and get(False, True).missing == 0
    assert get(True).invented == ["Real, R."]  # as it was before: the wrong name


def test_years(spark):
    df = spark.createDataFrame([("2019", ["2017"]), ("2022", ["2017"]), ("2015a", ["2015"]), ("", ["2017"]), (None, ["2017"]), ("2016", ["2017"]), ("2017", [])], "y string, ys array<string>")
    got = [tuple(r) for r in df.select(year_differs(F.col("y"), F.col("ys"), F.lit(True)), year_differs(F.col("y"), F.col("ys"), F.lit(False))).collect()]
    assert got == [(False, True), (True, True), (True, True), (False, False), (False, False), (True, True), (False, False)]


def test_printed_references_never_accuse(spark):
    refs = [
        "Vaswani, A., Shazeer, N.: Attention is all you need. NeurIPS (2017). doi:10.1/att-none",
        "Vaswani, A., Shazeer, N.: Attention is all you need. NeurIPS (2017). doi:10.1000/att",
        "Loshchilov, I., Hutter, F.: Decoupled weight decay regularization. arXiv:1711.05101 (2017)",
        "ESA: Sentinel validation report on everything, 2015",
        "Anonymous. Our own earlier work. Under review, 2024.",
        "Ghost, G.: A work that nobody has ever written at all. Journal (2011)",
        "Zebra, Z.: Genomics of zebra fish, briefly told. arXiv:1711.05101 (1999)",
    ]
    rows = [("b", k, r) for k, r in enumerate(refs, 1)]
    known = registry(spark, *BASE, (20, "crossref", "Attention Is All You Need", ["Vaswani"], ["2017"], "10.1000/att", None, None))
    out = audit.audit_printed(spark.createDataFrame(rows, "bib string, pos int, ref string"), known).orderBy("pos").collect()
    assert [r.verdict for r in out] == ["OK", "OK", "OK", "UNINDEXED", "CHECK", "NOT FOUND", "SUSPECT"]
    assert {f.priority for r in out for f in r.findings} == {3}


def test_agreement_of_names(spark):
    cols = "n string, f string"
    df = spark.createDataFrame([("wu x", "wu"), ("gok e ozer", "gokce"), ("abel b", "zorn"), ("x", "")], cols)
    empty = F.array().cast("array<string>")
    got = df.select(raw_agreement(F.col("n"), F.lit(False), F.lit(1.0), F.lit("t"), F.col("f"), empty, empty).alias("r")).collect()
    assert [r.r.author for r in got] == [False, False, True, False]


BIB = """@comment{ignored}
@Article{one, title = {Attention Is All You Need}, author = "Vaswani, A. and Shazeer, N.", year = 2017, doi = {10.1/att}}
@misc{two, title={A {N}ested {{title}}}, eprint={1711.99999}, author={A and others},
  pages = {1-9}}
@article{three, title = {Attention Is All You Need}, author={Ghost, G. and others}, year={1999}, doi={10.1/att}, month = March}
@article{four, title = {Nothing that any registry has ever held}}
@article{broken, title = {x"""


def test_bibtex(spark):
    got = list(bibtex.parse_bibtex(BIB))
    assert [g[0] for g in got] == ["one", "two", "three", "four", "broken"] and got[0][1] == "article"
    assert got[0][2] == {"title": "Attention Is All You Need", "author": "Vaswani, A. and Shazeer, N.", "year": "2017", "doi": "10.1/att"}
    assert got[1][2]["title"] == "A {N}ested {{title}}" and got[2][2]["month"] == "March"
    entries = bibtex.bib_entries(spark.createDataFrame([("b", BIB), ("none", None)], "bib string, text string"))
    verdicts = audit.audit_entries(entries, registry(spark, *BASE))
    by = {r.ref: r for r in verdicts.collect()}
    assert {k: v.verdict for k, v in by.items()} == {"one": "OK", "two": "FABRICATED", "three": "MISMATCH", "four": "UNRESOLVED", "broken": "UNRESOLVED"}
    checks = {k: sorted(f.check for f in v.findings) for k, v in by.items()}
    assert checks["two"] == ["Y1", "Y2", "dead"] and {"C4", "Y5", "invented author", "year", "missing author"} <= set(checks["three"])
    signal = audit.with_generation_signal(audit.exploded(verdicts), entries).where("check = 'C5'").first()
    assert signal.detail == "two, three" and signal.priority == 3
    counts, tiers, gate = audit.summary(verdicts)
    assert {r.verdict: r.n for r in counts.collect()}["UNRESOLVED"] == 2 and gate.first().gate == 1
    assert [r.n for r in tiers.where("priority = 1").collect()] == [1]
    one = audit.audit_entries(entries, registry(spark, *BASE), key="one").collect()
    assert len(one) == 1
    replaced = audit.canonical_replacements(entries, verdicts, registry(spark, *BASE).withColumn("bibtex", F.lit("@inproceedings{Old, title={T}}")))
    assert [r.bibtex for r in replaced.collect()] == ["@inproceedings{three, title={T}}"]


def test_style(spark):
    cases = [
        ({"title": "{ChatML}"}, []),
        ({"title": "{Attention is all you need}"}, ["Y6"]),
        ({"pages": "35-49"}, ["Y1"]),
        ({"pages": "35--49"}, []),
        ({"doi": "https://doi.org/10.1/x", "url": "http://y/10.1/X"}, ["Y3", "Y4"]),
        ({"doi": "10.1/x"}, []),
        ({"author": "J.D. Owens"}, ["Y8"]),
        ({"title": "A title and no identifier"}, []),
        ({"title": "ALL IN CAPITALS", "month": "sept"}, ["Y5", "Y7"]),
        ({}, []),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "f map<string,string>")
    got = df.select(style.style_findings(F.col("f")).alias("r")).collect()
    assert [sorted(f.check for f in r.r) for r in got] == [w for _, w in cases]


def test_report(spark):
    rows = [("b", "ref 2", 2, 4, "s", ""), ("b", "ref 10", 1, 1, "t", "d"), ("b", "ref 10", 3, 2, "u", "x\ny")]
    df = spark.createDataFrame(rows, "bib string, ref string, pos int, priority int, summary string, detail string")
    out = {r.bib: r.report for r in triage.report(df, spark.createDataFrame([("b", 5), ("c", 3)], "bib string, total int")).collect()}
    assert out["c"] == "No findings across 3 references."
    assert [x for x in out["b"].split("\n") if x[:1] == "P"] == [f"P{p} {t} (1)" for p, t, _ in triage.TIERS if p != 3]
    assert "        x\n        y" in out["b"]
    assert [r.ref for r in triage.ranked(df).collect()] == ["ref 10", "ref 10", "ref 2"]


def test_structured_source(spark):
    files = spark.createDataFrame([("a", '[{"title": "T", "authors": ["X"], "kind": "Dataset"}, {"n": "7"}]'), ("b", "[]")], "bib string, text string")
    got = structured_refs(files).orderBy("pos").collect()
    assert [(r.n, r.title, r.kind) for r in got] == [("1", "T", "dataset"), ("7", None, "article")]
    for bad in ('{"title": "T"}', "[{]"):
        with pytest.raises(Exception):  # noqa: B017
            structured_refs(spark.createDataFrame([("a", bad)], "bib string, text string")).collect()


def test_decoders(spark):
    null = spark.createDataFrame([(None,), ("not json",), ("{}",)], "j string")
    for decode in (reg.crossref, reg.datacite, reg.openalex, reg.s2_match):
        assert [r.r.families for r in null.select(decode(F.col("j")).alias("r")).collect()] == [[], [], []] or decode is reg.s2_match
    error = spark.createDataFrame([("<feed><entry><title>Error</title></entry></feed>",), ("<feed/>",)], "x string")
    assert [r.r for r in error.select(reg.arxiv_atom(F.col("x")).alias("r")).collect()] == [None, None]
    shown = spark.createDataFrame([('{"title": ["T"], "published": {"date-parts": [[2009]]}, "published-print": {"date-parts": [[2008]]}, "author": [{"family": "A", "given": "B"}, {"family": "C"}]}',)], "j string")
    r = shown.select(reg.display(F.col("j")).alias("r")).first().r
    assert (r.title, r.year, r.first_author, r.authors) == ("T", "2008", "A, B", 2)


def test_title_candidates_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring_index("text", "\n", 1).alias("t")).collect()
    from citeloom.functions import similarity
    from citeloom.functions.text import norm_text

    titles = {r.doc_id: norm_text(r.t[:80]) for r in docs}
    refs = spark.createDataFrame([(d, n) for d, n in titles.items() if d % 2], "ref_id long, norm string")
    known = spark.createDataFrame([(d, "crossref", n) for d, n in titles.items() if not d % 2], "registry_id long, source string, norm string")
    met: dict = {}
    for r in title_candidates(refs, known).collect():
        met.setdefault(r.ref_id, set()).add(titles[r.registry_id])
    near = [(a, b) for a in titles if a % 2 for b in titles if not b % 2 and titles[a] and similarity.ratio(titles[a], titles[b]) >= 0.85]
    found = sum(1 for a in {a for a, _ in near} if any(titles[b] in met.get(a, ()) for x, b in near if x == a))
    assert near and found >= 0.95 * len({a for a, _ in near})
    assert look_up(spark.createDataFrame([(1, "Attention")], "ref_id long, title string"), reg.prepared(registry(spark, *BASE))).count() >= 1


def test_http(spark):
    def failing(*codes):
        left = list(codes)

        def fetch(url, timeout, headers):
            code = left.pop(0)
            if code == 200:
                return "ok"
            if code == 0:
                raise urllib.error.URLError("down")
            raise urllib.error.HTTPError(url, code, "", {"Retry-After": "99"}, None)

        return fetch

    waits: list[float] = []
    ask = lambda *codes: http.get("u", fetch=failing(*codes), sleep=waits.append)[:2]
    assert [ask(200), ask(404), ask(429, 200), ask(503, 503), ask(0, 0), ask(403), ask(400)] == [("hit", 200), ("miss", 404), ("hit", 200), ("unavailable", 503), ("unavailable", None), ("unavailable", 403), ("malformed", 400)]
    assert max(waits) <= 3
    out = http.fetch_all(spark.createDataFrame([("h", "a"), ("h", "a"), ("g", "b")], "host string, url string"), 0, fetch=lambda u, t, h: u.upper() + h.get("k", ""), headers=lambda host: {"k": "!"} if host == "g" else {}).collect()
    assert sorted((r.url, r.body) for r in out) == [("a", "A"), ("b", "B!")]


def test_stream(spark, tmp_path):
    from citeloom.streaming.intake import audit_stream

    (tmp_path / "in").mkdir()
    known = registry(spark, *BASE)
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.bib").write_text(f"@article{{k{k}, title={{Attention is all you need}}, doi={{10.1/att}}}}")
        audit_stream(spark, str(tmp_path / "in"), known, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.ref for r in got.collect()) == ["k1", "k2"] and {r.batch for r in got.collect()} == {0, 1}


def test_entry_contract():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 35


def _arxiv_registry(spark):
    known = spark.createDataFrame([(1, "arxiv", "A", ["X"], "2001", "2001.00001"), (2, "arxiv", "B", ["Y"], "2001", "2001.000002")], "registry_id long, source string, title string, families array<string>, year string, arxiv string")
    return reg.prepared(known.withColumn("doi", F.lit(None).cast("string")))


def test_what_is_no_arxiv_id_finds_nothing(spark):
    """A number that is too long is malformed, also where a registry has a record under it."""
    refs = spark.createDataFrame([(1, "2001.00001v2", None, []), (2, "arXiv:2001.000002", None, []), (3, "2001.000003", None, []), (4, "2001.000002", None, ["arxiv"])], "ref_id int, arxiv string, doi string, down array<string>")
    got = {r.ref_id: (r.registry_id, r.dead, r.how, r.status) for r in by_identifier(refs, _arxiv_registry(spark)).collect()}
    bad = (None, None, "arxiv:malformed")
    assert got == {1: (1, None, "arxiv", "hit"), 2: (*bad, "malformed"), 3: (*bad, "malformed"), 4: (*bad, "unavailable")}


def test_single_ids_are_hits_or_misses(spark):
    """A look-up of one id asks the registry, which has it or not."""
    ids = spark.createDataFrame([("2001.00001v2",), ("2001.000002v2",), ("2001.000003v2",)], "id string")
    got = {r.id: (r.status, r.title, r.authors) for r in verify_arxiv(ids, _arxiv_registry(spark)).collect()}
    assert got == {"2001.00001v2": ("hit", "A", 1), "2001.000002v2": ("hit", "B", 1), "2001.000003v2": ("miss", None, None)}


def test_entries_are_sent_on_as_they_are_parsed():
    """What Python holds of a file's entries doesn't grow with the file."""
    import pyarrow as pa

    text = "".join(f"@misc{{k{k}, title={{T {k}}}}}\n" for k in range(2500))
    files = pa.RecordBatch.from_arrays([pa.array(["a", "b", None]), pa.array([text, None, "@misc{x, year=2001}"])], names=["bib", "text"])
    out = list(bibtex._entries(iter([files])))
    assert [len(b) for b in out] == [1000, 1000, 501] and out[-1].column(1).to_pylist()[-2:] == [2500, 1]
    assert list(bibtex._entries(iter([]))) == []


def test_of_records_under_one_identifier_the_fitting_one(spark):
    rows = [(1, "arxiv", "Other words here", "2001.00001"), (2, "arxiv", "The title meant", "2001.00001"), (3, "arxiv", "The title meant", "2001.00001"), (4, "arxiv", "Alone", "2001.00002")]
    known = reg.prepared(spark.createDataFrame(rows, "registry_id long, source string, title string, arxiv string").withColumn("doi", F.lit(None).cast("string")))
    refs = spark.createDataFrame([(1, "2001.00001", None, [], "A. Abel: The title meant. 2001"), (2, "2001.00001", None, [], "zzz"), (3, "2001.00002", None, [], "zzz"), (4, "2001.00003", None, [], "The title meant")], "ref_id int, arxiv string, doi string, down array<string>, text string")
    got = fitting(by_identifier(refs, known), refs.select("ref_id", "text"), known).collect()
    assert {r.ref_id: (r.registry_id, r.status) for r in got} == {1: (2, "hit"), 2: (1, "hit"), 3: (4, "hit"), 4: (None, "miss")}
