"""The command line, requests to registries, and what audits leave behind."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from citeloom.__main__ import main
from citeloom.plans import audit, report
from citeloom.sources import http, requests
from citeloom.sources import registry as reg
from citeloom.storage import shared_dir, small, table_bytes
from tests.test_audit import BASE, BIB, registry


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("registry") / "records")
    registry(spark, *BASE).withColumn("bibtex", F.lit("@article{Old, title={T}}")).write.parquet(path)
    return path


def test_entries(spark, tmp_path, known, capsys):
    (tmp_path / "a.bib").write_text(BIB)
    out = str(tmp_path / "out")
    assert main(["entries", str(tmp_path / "a.bib"), "--registry", known, "--out", out, "--format", "json", "--show-bibtex"], spark) == 1
    text = capsys.readouterr().out
    assert "FABRICATED" in text and "P1 Cited work found nowhere" in text and "5 references" in text and "@article{three, title={T}}" in text
    assert spark.read.json(out + "/verdicts").count() == 5 and spark.read.json(out + "/findings").where("check = 'C5'").count() == 1
    assert main(["entries", str(tmp_path / "a.bib"), "--registry", known, "--key", "one"], spark) == 0
    assert main(["entries", str(tmp_path / "a.bib"), "--registry", known, "--key", "none"], spark) == 2
    assert main(["entries", str(tmp_path / "absent.bib"), "--registry", known], spark) == 2


def test_structured_and_printed(spark, tmp_path, known, capsys):
    (tmp_path / "good.json").write_text(json.dumps([{"title": "Attention is all you need", "authors": ["Vaswani, A."], "doi": "10.1/att", "year": "2017"}]))
    (tmp_path / "bad.json").write_text('{"title": "x"}')
    (tmp_path / "refs.txt").write_text("Some paper\nReferences\n" + "\n".join(f"[{k}] Vaswani, A., Shazeer, N.: Attention is all you need. NeurIPS {k} (2017). doi:10.1/att" for k in (1, 2, 3)))
    assert main(["structured", str(tmp_path / "good.json"), "--registry", known], spark) == 0
    assert main(["structured", str(tmp_path / "bad.json"), "--registry", known], spark) == 2
    assert main(["printed", str(tmp_path / "refs.txt"), "--registry", known, "--show-bibtex"], spark) == 0
    assert "OK: 3" in (text := capsys.readouterr().out) and text.count("@article{Vaswani2017") == 3


def test_look_up(spark, known, capsys):
    assert main(["look-up", "--registry", known, "--title", "Attention is all you need", "--rows", "1"], spark) == 0
    assert "10.1/Att" in capsys.readouterr().out
    assert main(["look-up", "--registry", known, "--title", "Attention is all you need", "--author", "Mancini"], spark) == 0
    assert capsys.readouterr().out.split()[-1] == "10.1/book"
    assert main(["look-up", "--registry", known, "--arxiv", "1711.05101v2"], spark) == 0
    assert main(["look-up", "--registry", known, "--arxiv", "1711.00000"], spark) == 1
    assert main(["look-up", "--registry", known], spark) == 2


def test_a_null_bibliography_is_no_other(spark):
    entries = spark.createDataFrame([(None, 1, "a", "article", {"title": "t", "doi": "10.1/att"}, ""), (None, 2, "b", "article", {"title": "t", "doi": "10.1/none"}, ""), ("x", 1, "c", "article", {"title": "t"}, "")], "bib string, pos int, key string, etype string, fields map<string,string>, raw string")
    got = {r.ref: r.verdict for r in audit.audit_entries(entries, registry(spark, *BASE)).collect()}
    assert len(got) == 3 and got["b"] == "FABRICATED" and got["c"] == "UNRESOLVED"


def test_keys_go_to_their_own_host_only(spark, monkeypatch):
    monkeypatch.setenv("S2_API_KEY", "secret")
    assert requests.headers_for(requests.S2) == {"x-api-key": "secret"}
    assert all(requests.headers_for(h) == {} for h in (requests.CROSSREF, requests.ARXIV, requests.OPENALEX, requests.DATACITE, "example.org"))
    refs = spark.createDataFrame([(1, "A title, with & signs", "10.1/a b", "2001.00001", "Abel"), (2, None, " ", None, None)], "ref_id long, title string, doi string, arxiv string, author string")
    asked = requests.by_doi(refs).unionByName(requests.by_arxiv(refs)).unionByName(requests.by_title(refs)).collect()
    assert {r.source for r in asked} == {"crossref", "datacite", "arxiv", "openalex", "s2"} and {r.ref_id for r in asked} == {1}
    assert all("secret" not in r.url and " " not in r.url for r in asked)
    assert any("query.author=Abel" in r.url for r in asked) and any(r.url.endswith("10.1%2Fa%20b") for r in asked)
    monkeypatch.delenv("S2_API_KEY")
    assert requests.headers_for(requests.S2) == {}


def test_bulk_requests_hold_each_id_once(spark):
    refs = spark.createDataFrame([(k, f"10.1/{k}", f"2001.{k:05d}") for k in range(230)], "ref_id long, doi string, arxiv string")
    for source in ("openalex", "arxiv"):
        rows = requests.in_bulk(refs, source).collect()
        assert sorted(i for r in rows for i in r.ref_ids) == list(range(230)) and max(len(r.ref_ids) for r in rows) <= 50


def test_answers_of_searches(spark):
    bodies = {
        requests.CROSSREF: {"message": {"items": [{"title": ["First"], "DOI": "10.1/f"}, {"title": ["Second"]}]}},
        requests.OPENALEX: {"results": []},
        requests.S2: {"data": [{"title": "Matched", "externalIds": {"DOI": "10.1/m"}}]},
    }

    def fetch(url, timeout, headers):
        host = url.split("/")[2]
        return json.dumps(bodies[host]) if host in bodies else "<feed xmlns='http://www.w3.org/2005/Atom'></feed>"

    refs = spark.createDataFrame([(1, "Some title")], "ref_id long, title string")
    got = {r.source: (r.status, r.record and r.record.title) for r in requests.answers(requests.by_title(refs), pause=0, fetch=fetch).collect()}
    assert got == {"crossref": ("hit", "First"), "openalex": ("miss", None), "s2": ("hit", "Matched"), "arxiv": ("miss", None)}


def test_patience():
    waits: list[float] = []

    def down(url, timeout, headers):
        raise TimeoutError

    assert http.get("u", **http.LOOK_UP, fetch=down, sleep=waits.append)[0] == "unavailable" and waits == [3, 6, 9]


def test_prepared_registries_are_taken_as_they_are(spark):
    once = reg.kept(registry(spark, *BASE))
    assert reg.kept(once) is once and reg.prepared(once) is once


def test_totals_and_log(spark):
    verdicts = spark.createDataFrame([("b", 1, "ref 1", "OK", "arxiv"), ("b", 2, "ref 2", "CHECK", None), ("c", 1, "ref 1", "OK", "arxiv")], "bib string, pos int, ref string, verdict string, how string")
    assert {r.bib: (r.n, r.verdicts) for r in report.totals(verdicts).collect()} == {"b": (2, {"CHECK": 1, "OK": 1}), "c": (1, {"OK": 1})}
    assert [r.line for r in report.log(verdicts).where("bib = 'b'").orderBy("pos").collect()] == ["OK             [ref 1]  arxiv", "CHECK          [ref 2]  ", "2 references; CHECK: 1, OK: 1"]


def test_storage(spark):
    few = spark.createDataFrame([("x" * 1000, [1, 2], [("a", 1)])] * 10, "s string, a array<int>, r array<struct<t: string, n: int>>")
    assert 10_000 < table_bytes(few) < 20_000
    hinted = small(few)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in hinted or "UnresolvedHint" in hinted
    assert small(few, 100) is few and shared_dir(spark)
