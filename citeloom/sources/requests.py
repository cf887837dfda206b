"""What to ask registries for, as rows (host, url, headers, ref_id, source, kind), and their answers as records.

Requests are columns made in the JVM; `sources.http` asks, a host at a time; the decoders of `sources.registry`
read the answers. A key goes to its own host only, and comes from the environment only.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.sources import registry as reg
from citeloom.sources.http import contact, fetch_all

CROSSREF, ARXIV, DATACITE, OPENALEX, S2 = "api.crossref.org", "export.arxiv.org", "api.datacite.org", "api.openalex.org", "api.semanticscholar.org"
OPENALEX_BATCH, ARXIV_BATCH, S2_BATCH = 50, 50, 500


def headers_for(host: str) -> dict[str, str]:
    """Headers of a host: the key of S2 for S2 alone."""
    key = os.environ.get("S2_API_KEY", "")
    return {"x-api-key": key} if key and host == S2 else {}


def _encoded(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def _mail(sign: str) -> Column:
    return F.lit(f"{sign}mailto={contact()}" if contact() else "")


def _request(refs: DataFrame, source: str, host: str, kind: str, url: Column) -> DataFrame:
    return refs.select("ref_id", F.lit(source).alias("source"), F.lit(host).alias("host"), F.lit(kind).alias("kind"), url.alias("url"))


def by_doi(refs: DataFrame) -> DataFrame:
    """Crossref and DataCite by the DOI of (ref_id, doi)."""
    asked = refs.where("trim(doi) <> ''")
    one = _request(asked, "crossref", CROSSREF, "id", F.concat(F.lit(f"https://{CROSSREF}/works/"), _encoded(F.trim("doi")), _mail("?")))
    return one.unionByName(_request(asked, "datacite", DATACITE, "id", F.concat(F.lit(f"https://{DATACITE}/dois/"), _encoded(F.trim("doi")))))


def by_arxiv(refs: DataFrame) -> DataFrame:
    return _request(refs.where("trim(arxiv) <> ''"), "arxiv", ARXIV, "id", F.concat(F.lit(f"https://{ARXIV}/api/query?id_list="), _encoded(F.trim("arxiv")), F.lit("&max_results=1")))


def by_title(refs: DataFrame, rows: int = 3) -> DataFrame:
    """The search of every source for the title of (ref_id, title), and the author of (..., author) for Crossref, if any."""
    asked, title = refs.where("trim(title) <> ''"), _encoded(F.trim("title"))
    author = F.coalesce(F.concat(F.lit("&query.author="), _encoded(F.col("author"))), F.lit("")) if "author" in refs.columns else F.lit("")
    crossref = F.concat(F.lit(f"https://{CROSSREF}/works?rows={rows}&query.bibliographic="), title, author, _mail("&"))
    arxiv = F.concat(F.lit(f"https://{ARXIV}/api/query?max_results={rows}&search_query="), _encoded(F.concat(F.lit('ti:"'), F.replace(F.trim("title"), F.lit('"'), F.lit(" ")), F.lit('"'))))
    openalex = F.concat(F.lit(f"https://{OPENALEX}/works?per-page={rows}&filter=title.search:"), _encoded(F.regexp_replace(F.trim("title"), "[,|:]", " ")), _mail("&"))
    s2 = F.concat(F.lit(f"https://{S2}/graph/v1/paper/search/match?fields=title,externalIds&query="), title)
    found = _request(asked, "crossref", CROSSREF, "search", crossref)
    for source, host, url in (("arxiv", ARXIV, arxiv), ("openalex", OPENALEX, openalex), ("s2", S2, s2)):
        found = found.unionByName(_request(asked, source, host, "search", url))
    return found


def in_bulk(refs: DataFrame, source: str) -> DataFrame:
    """(ref_ids, source, host, url): many ids in one request, of (ref_id, doi) for OpenAlex or (ref_id, arxiv) for arXiv.

    Answers come in any order and leave out what isn't there, so they are to be joined by key, never by place.
    """
    name, host, size = ("doi", OPENALEX, OPENALEX_BATCH) if source == "openalex" else ("arxiv", ARXIV, ARXIV_BATCH)
    asked = refs.where(F.trim(name) != "").select("ref_id", F.trim(name).alias("id"))
    # ids are dealt by hash to about as many groups as they fill, and groups that are over are cut
    groups = max(1, -(-asked.count() // size))
    dealt = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g")).agg(F.sort_array(F.collect_list(F.struct("id", "ref_id"))).alias("all"))
    parts = dealt.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / size).cast("int")), lambda k: F.slice("all", k * size + 1, size))).alias("part"))
    ids = F.transform("part", lambda x: x["id"])
    if source == "openalex":
        url = F.concat(F.lit(f"https://{OPENALEX}/works?per-page={size}&filter=doi:"), F.array_join(F.transform(ids, _encoded), "|"), _mail("&"))
    else:
        url = F.concat(F.lit(f"https://{ARXIV}/api/query?max_results={size}&id_list="), F.array_join(F.transform(ids, _encoded), ","))
    return parts.select(F.transform("part", lambda x: x["ref_id"]).alias("ref_ids"), F.lit(source).alias("source"), F.lit(host).alias("host"), url.alias("url"))


def answers(requests: DataFrame, **how) -> DataFrame:
    """(ref_id, source, status, record): each request's answer, decoded. A hit without a record is a miss; what could not be
    asked is unavailable. `how` goes to sources.http.fetch_all."""
    got = requests.join(fetch_all(requests, **how).drop("code"), "url")
    body, search = F.col("body"), F.col("kind") == "search"
    within = lambda path: F.when(search, F.to_json(F.try_variant_get(F.try_parse_json(body), path[0], "variant"))).otherwise(F.to_json(F.try_variant_get(F.try_parse_json(body), path[1], "variant")))
    decoded = {
        "crossref": reg.crossref(within(("$.message.items[0]", "$.message"))),
        "datacite": reg.datacite(within(("$.data[0].attributes", "$.data.attributes"))),
        "openalex": reg.openalex(within(("$.results[0]", "$"))),
        "s2": reg.s2_match(body),
        "arxiv": reg.arxiv_atom(body),
    }
    record = F.coalesce(*(F.when(F.col("source") == source, r) for source, r in decoded.items()))
    found = got.select("ref_id", "source", "status", F.when((F.col("status") == "hit"), record).alias("record"))
    empty = F.coalesce(F.col("record.title"), F.lit("")) == ""
    return found.select("ref_id", "source", F.when((F.col("status") == "hit") & empty, "miss").otherwise(F.col("status")).alias("status"), F.when(~empty, F.col("record")).alias("record"))


def unavailable(found: DataFrame) -> DataFrame:
    """(ref_id, source) of what could not be asked, as the ladders take it."""
    return found.where("status = 'unavailable'").select("ref_id", "source").distinct()
