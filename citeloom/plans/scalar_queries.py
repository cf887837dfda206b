"""Queries of single functions, comparisons and sources, with SQL that computes the same from the same rows."""

from __future__ import annotations

import urllib.error

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.classify import guess_title_col, namelike_col
from citeloom.functions.identifiers import has_identifier
from citeloom.functions.similarity import coverage_col, ratio_col
from citeloom.functions.text import delatex_col, expand_diacritics_col, family_key_col, family_keys_col, norm_col, squash_col, strip_accents_col
from citeloom.operators import triage
from citeloom.operators.compare import raw_agreement
from citeloom.operators.resolve import look_up_by_author, verify_arxiv
from citeloom.plans import audit
from citeloom.plans.ladder_queries import TITLE, duck
from citeloom.plans.queries import _doi_refs, _doi_registry, _part, _read, query
from citeloom.sources import registry as reg
from citeloom.sources import requests
from citeloom.sources.http import fetch_all
from citeloom.sources.structured import reference_section
from citeloom.storage import spread

_FIRST = "string_split(coalesce(text, ''), chr(10))[1]"
_SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ŋ": "ng", "Ŋ": "Ŋ", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i", "ĸ": "k"}
_WRITTEN = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "å": "aa", "Å": "Aa"}


def _replaced(x: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _stripped(x: str) -> str:
    return f"strip_accents({_replaced(x, _SPELLED)})"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(lower({_stripped(x)}), '[^0-9a-z]+', ' ', 'g'))"


def _letters(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9A-Za-z]+', ' ', 'g')"


@query(f"SELECT doc_id, {_letters(_stripped(_FIRST))} AS stripped, {_letters(_stripped(_replaced(_FIRST, _WRITTEN)))} AS expanded FROM documents")
def n2_expanded_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents taken off, and umlauts written out."""
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    plain = lambda c: F.regexp_replace(c, "[^0-9A-Za-z]+", " ")
    return _read(spark, sf_dir, "documents").select("doc_id", plain(strip_accents_col(first)).alias("stripped"), plain(expand_diacritics_col(first)).alias("expanded"))


_MACROS = {0: ("a", '\\"{a}'), 1: ("o", "{\\o}"), 2: ("c", "\\c{c}"), 3: ("e", "\\'e"), 4: ("ss", "\\ss "), 5: ("l", "\\L{}")}
_TEX = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN replace(p_name, '{a}', '{b.replace(chr(39), chr(39) * 2)}')" for k, (a, b) in _MACROS.items()) + " END"
_GLYPHS = [("ss", "ss"), ("o", "o"), ("O", "O"), ("l", "l"), ("L", "L"), ("aa", "a"), ("AA", "A"), ("ae", "ae"), ("AE", "AE"), ("oe", "oe"), ("OE", "OE"), ("i", "i"), ("j", "j")]
_PLAIN_TEX = r"""regexp_replace(regexp_replace(regexp_replace(s, '\\["''`^~=.]\s*\{?([\p{L}\p{N}_])\}?', '\1', 'g'), '\\[A-Za-z]+\{([\p{L}\p{N}_])\}', '\1', 'g'), '\\[A-Za-z]+\s+([\p{L}\p{N}_])', '\1', 'g')"""
for _macro, _glyph in _GLYPHS:
    _PLAIN_TEX = f"replace({_PLAIN_TEX}, '\\{_macro}', '{_glyph}')"


@query(f"SELECT k, {_PLAIN_TEX} AS plain FROM (SELECT p_partkey AS k, {_TEX} AS s FROM part)")
def n3_delatex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accent and glyph macros in names of parts."""
    k = F.col("p_partkey") % 6
    s = F.lit(None).cast("string")
    for n, (a, b) in _MACROS.items():
        s = F.when(k == n, F.replace("p_name", F.lit(a), F.lit(b))).otherwise(s)
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("k"), delatex_col(s).alias("plain"))


@query(f"""WITH t AS (SELECT doc_id, n, CASE doc_id % 4 WHEN 0 THEN n WHEN 1 THEN left(n, length(n) // 2) WHEN 2 THEN '' ELSE '~~~' END AS b FROM (SELECT doc_id, {_normal(f"left({_FIRST}, 80)")} AS n FROM documents) WHERE length(n) > 3),
s AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN length(n) WHEN 1 THEN length(b) ELSE 0 END AS common, replace(n, ' ', '') AS ns, replace(b, ' ', '') AS bs FROM t)
SELECT doc_id, round(2 * common / (length(n) + length(b)), 6) AS ratio, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN round(length(bs) / length(ns), 6) ELSE 0.0 END AS whole_in_part, CASE WHEN doc_id % 4 < 2 THEN 1.0 ELSE 0.0 END AS part_in_whole FROM s""")  # fmt: skip
def n5_title_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio and both coverages of titles with themselves, their first halves, nothing and what shares no character."""
    title = norm_col(F.left(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.lit(80)))
    k = F.col("doc_id") % 4
    t = _read(spark, sf_dir, "documents").select("doc_id", title.alias("n")).where(F.length("n") > 3)
    t = t.withColumn("b", F.when(k == 0, F.col("n")).when(k == 1, F.left("n", F.floor(F.length("n") / 2).cast("int"))).when(k == 2, "").otherwise("~~~"))
    ns, bs = squash_col(F.col("n")), squash_col(F.col("b"))
    return t.select("doc_id", F.round(ratio_col(F.col("n"), F.col("b")), 6).alias("ratio"), F.round(coverage_col(ns, bs), 6).alias("whole_in_part"), F.round(coverage_col(bs, ns), 6).alias("part_in_whole"))


_GOLDEN = [
    ("Efficient graph-based image segmentation", "Graph based image segmentation", 0.8571, 0.75, 1.0),
    ("Attention is all you need", "Is Attention All You Need?", 0.88, 0.9048, 0.9048),
    ("Attention is all you need", "Attention is All you Need", 1.0, 1.0, 1.0),
    ("Decoupled Weight Decay Regularization", "Fixing Weight Decay Regularization in Adam", 0.7089, 0.7353, 0.6757),
]


@query("SELECT title, CAST(ratio AS DOUBLE) AS ratio, CAST(a_in_b AS DOUBLE) AS a_in_b, CAST(b_in_a AS DOUBLE) AS b_in_a FROM (VALUES " + ", ".join(f"('{a}', {r}, {x}, {y})" if k != 2 else f"('{a}!', {r}, {x}, {y})" for k, (a, _, r, x, y) in enumerate(_GOLDEN)) + ") v(title, ratio, a_in_b, b_in_a)")
def n5_known_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles whose similarities are known."""
    rows = spark.createDataFrame([(a + "!" if k == 2 else a, b) for k, (a, b, *_) in enumerate(_GOLDEN)], "a string, b string")
    na, nb = norm_col(F.col("a")), norm_col(F.col("b"))
    rows = rows.select("a", na.alias("na"), nb.alias("nb"))
    sa, sb = squash_col(F.col("na")), squash_col(F.col("nb"))
    return rows.select(F.col("a").alias("title"), F.round(ratio_col(F.col("na"), F.col("nb")), 4).alias("ratio"), F.round(coverage_col(sa, sb), 4).alias("a_in_b"), F.round(coverage_col(sb, sa), 4).alias("b_in_a"))


_W = [f"split_part(p_name, ' ', {n})" for n in (1, 2, 3)]
NAME = f"CASE p_partkey % 5 WHEN 0 THEN concat({_W[0]}, ' ', replace({_W[1]}, 'o', 'ö'), ', ', {_W[2]}) WHEN 1 THEN concat({_W[0]}, ' ', {_W[1]}, ' ', replace({_W[2]}, 'a', 'ä')) WHEN 2 THEN concat({_W[0]}, '-', {_W[1]}, ', ', {_W[2]}) WHEN 3 THEN concat('{{', {_W[0]}, '}} Ø', {_W[1]}) ELSE {_W[0]} END"
NAME = NAME.replace("{{", "{").replace("}}", "}")
_BARE = "trim(replace(replace(name, '{', ''), '}', ''))"
_TAIL = "regexp_extract({x}, '([^ ]*)$', 1)"


@query(f"""WITH n AS (SELECT p_partkey AS k, {NAME} AS name FROM part), b AS (SELECT k, {_BARE} AS s FROM n), w AS (SELECT *, string_split(s, ' ') AS w FROM b),
u AS (SELECT *, CASE WHEN contains(s, ',') THEN [split_part(s, ',', 1)] WHEN len(w) > 1 THEN [w[-1], w[-2] || ' ' || w[-1], w[-2]] ELSE [s] END AS surnames FROM w),
f AS (SELECT k, s, unnest(list_concat(list_transform(surnames, lambda x: {_normal("x")}), list_transform(surnames, lambda x: {_normal(_replaced("x", _WRITTEN))}))) AS n FROM u),
a AS (SELECT k, unnest([n, replace(n, ' ', ''), {_TAIL.format(x="n")}]) AS key FROM f),
l AS (SELECT k, {_normal(f"CASE WHEN contains(s, ',') THEN split_part(s, ',', 1) ELSE {_TAIL.format(x='s')} END")} AS n FROM b)
SELECT l.k, {_TAIL.format(x="any_value(l.n)")} AS key, array_to_string(list_sort(list(DISTINCT a.key) FILTER (length(a.key) > 1)), ',') AS keys FROM l JOIN a USING (k) GROUP BY l.k""")  # fmt: skip
def n8_family_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a name, and all that it may go by."""
    names = _part(spark, sf_dir).select(F.col("p_partkey").alias("k"), F.expr(NAME).alias("name"))
    return names.select("k", family_key_col(F.col("name")).alias("key"), F.array_join(family_keys_col(F.col("name")), ",").alias("keys"))


_CHUNK = "CASE WHEN doc_id % 2 = 0 THEN 'J. ' || upper(left(t, 1)) || substr(t, 2) || ' and ' || upper(substr(t, 20, 1)) || substr(t, 21) ELSE t END"


@query(f"""SELECT doc_id, len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}') OR regexp_full_match(x, '[\\p{{L}}\\p{{N}}_]\\.'))) >= 0.8 * len(w) AS namelike
FROM (SELECT doc_id, list_filter(string_split_regex(c, '\\s+'), lambda x: x <> '' AND lower(x) NOT IN ('and', 'et', 'al.')) AS w FROM (SELECT doc_id, {_CHUNK} AS c FROM (SELECT doc_id, left({_FIRST}, 40) AS t FROM documents)))""")  # fmt: skip
def i10_namelike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of documents, half of them made to look more like names."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.left(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.lit(40)).alias("t"))
    return docs.select("doc_id", namelike_col(F.expr(_CHUNK)).alias("namelike"))


_CITED = f"CASE p_partkey % 4 WHEN 0 THEN concat('Abel, A., Böll, B.: ', {TITLE}, '. Journal, 2001, 12, 34') WHEN 1 THEN concat('A. Abel. B. Böll. 2001. ', {TITLE}, '. In Proceedings. https://doi.org/10.1000/x') WHEN 2 THEN concat('(2001). ', {TITLE}, '. Elsewhere. arXiv:2001.00001') ELSE concat('Abel A and Böll B: ', {TITLE}, '. ', 'doi: 10.1000/y') END"


@query(duck(f"SELECT p_partkey AS k, {TITLE} AS title FROM part").replace("AS title FROM", "|| CASE WHEN p_partkey % 4 = 3 THEN '.' ELSE '' END AS title FROM"))
def i11_guess_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles found again in references printed in four ways."""
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("k"), guess_title_col(F.expr(_CITED)).alias("title"))


@query("SELECT p_partkey AS k, p_partkey % 3 = 0 AND p_partkey % 2 = 0 OR p_partkey % 5 = 0 AND p_partkey % 7 <> 0 AS claims FROM part")
def i14_has_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    doi, eprint = F.when(k % 3 == 0, F.when(k % 2 == 0, "10.1/x").otherwise(" ")), F.when((k % 5 == 0) & (k % 7 != 0), "2001.00001").otherwise("")
    fields = F.map_from_entries(F.filter(F.array(F.struct(F.lit("doi").alias("k"), doi.alias("v")), F.struct(F.lit("eprint").alias("k"), eprint.alias("v"))), lambda x: x["v"].isNotNull()))
    return _part(spark, sf_dir).select(k.alias("k"), has_identifier(fields).alias("claims"))


_FAMILY = f"CASE p_partkey % 5 WHEN 0 THEN {_W[0]} WHEN 1 THEN concat(substr({_W[1]}, 1, 5), 'zz') WHEN 2 THEN concat({_W[2]}, 'berg') WHEN 3 THEN 'zzzzzz' ELSE '' END"


@query(f"""WITH t AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS w, {_FAMILY} AS f, p_partkey % 7 = 0 AS anon, p_size / 50.0 AS cov, p_partkey % 9 <> 0 AS titled,
CASE p_partkey % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['2001'] ELSE ['2001', '1999'] END AS a, CASE WHEN p_partkey % 4 = 0 THEN []::VARCHAR[] ELSE ['1999'] END AS b FROM part)
SELECT k, anon AS anonymized, NOT anon AND titled AND cov < 0.8 AS title, NOT anon AND titled AND cov < 0.45 AS wrong_work,
NOT anon AND f <> '' AND len(list_filter(w, lambda x: x = f OR starts_with(x, left(f, 5)) OR starts_with(f, x))) = 0 AS author, NOT anon AND len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b) AS year FROM t""")  # fmt: skip
def c3_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed references against records: coverage, first family among the words, and years."""
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    ours = F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(F.lit("2001"))).otherwise(F.array(F.lit("2001"), F.lit("1999")))
    agreed = raw_agreement(F.col("p_name"), k % 7 == 0, F.col("p_size") / 50.0, F.when(k % 9 != 0, F.col("p_name")), F.expr(_FAMILY), ours, F.when(k % 4 == 0, none).otherwise(F.array(F.lit("1999"))))
    return _part(spark, sf_dir).select(k.alias("k"), agreed.alias("a")).select("k", "a.*")


_BITS = {"status": "CASE WHEN p_partkey % 5 = 0 THEN 'unavailable' ELSE 'hit' END", "dead": "CASE WHEN p_partkey % 7 = 0 THEN 'doi:x' END", "found": "p_size % 2 = 0", "anonymized": "p_size % 3 = 0", "grey": "p_partkey % 4 = 0",
         "how": "CASE p_partkey % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'search' ELSE 'crossref:doi' END", "issues": "p_size % 5 < 2", "wrong": "p_size % 11 < 3"}


@query("SELECT k, CASE WHEN status = 'unavailable' THEN 'LOOKUP FAILED' WHEN dead IS NOT NULL THEN 'SUSPECT' WHEN NOT found THEN CASE WHEN anonymized THEN 'CHECK' WHEN grey THEN 'UNINDEXED' ELSE 'NOT FOUND' END WHEN wrong AND how <> 'search' AND NOT anonymized THEN 'SUSPECT' WHEN issues THEN 'CHECK' ELSE 'OK' END AS printed, "
       "CASE WHEN status = 'unavailable' THEN 'LOOKUP FAILED' WHEN dead IS NOT NULL THEN 'FABRICATED' WHEN NOT found THEN CASE WHEN anonymized OR grey THEN 'UNVERIFIABLE' ELSE 'NOT FOUND' END WHEN wrong AND how <> 'search' THEN 'FABRICATED' WHEN issues THEN 'CHECK' ELSE 'OK' END AS structured, "
       "CASE WHEN status = 'unavailable' THEN 'LOOKUP FAILED' WHEN dead IS NOT NULL THEN 'FABRICATED' WHEN NOT found THEN 'UNRESOLVED' WHEN issues AND how = 'crossref:doi' THEN 'MISMATCH' WHEN issues THEN 'CHECK' ELSE 'OK' END AS entry FROM (SELECT p_partkey AS k, " + ", ".join(f"{e} AS {n}" for n, e in _BITS.items()) + " FROM part)")  # fmt: skip
def v3_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three verdicts on all mixtures of evidence."""
    t = _part(spark, sf_dir).select(F.col("p_partkey").alias("k"), *(F.expr(e).alias(n) for n, e in _BITS.items()))
    c = {n: F.col(n) for n in _BITS}
    kind = F.when(F.col("grey"), "report").otherwise("article")
    return t.select(
        "k",
        triage.raw_verdict(c["status"], c["dead"], c["found"], c["anonymized"], c["grey"], c["how"], c["issues"], c["wrong"]).alias("printed"),
        triage.structured_verdict(c["status"], c["dead"], c["found"], c["anonymized"], kind, c["how"], c["issues"], c["wrong"]).alias("structured"),
        triage.bib_verdict(c["status"], c["dead"], c["found"], c["how"], c["issues"]).alias("entry"),
    )


_HEADING = "CASE doc_id % 4 WHEN 0 THEN 'References' WHEN 1 THEN '7. BIBLIOGRAPHY' WHEN 2 THEN 'references and more' END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN b ELSE concat_ws(chr(10), 'References of no use', a, {_HEADING}, b) END AS section FROM (SELECT doc_id, {_FIRST} AS a, 'last ' || {_FIRST} AS b FROM documents)")
def s5_reference_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the heading, where one is."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("a"), F.expr(_HEADING).alias("h"))
    text = F.concat_ws("\n", F.lit("References\f of no use"), "a", "h", F.concat(F.lit("last "), "a"))
    return docs.select("doc_id", reference_section(text).alias("section"))


@query("SELECT p_partkey AS k, p_name AS title, CAST(1990 + p_partkey % 30 AS VARCHAR) AS year, 'Abel, A.' AS first_author, CAST(2 AS INT) AS authors, '10.1000/' || p_partkey AS doi, CAST(1991 + p_partkey % 30 AS VARCHAR) AS atom_year, 'Ada Abel' AS atom_author, '2001.' || (10000 + p_partkey) AS atom_id FROM part")
def d5_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a look-up prints of a Crossref message, whose print year comes first, and of an Atom feed."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    date = lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    year = (1990 + k % 30).cast("int")
    people = F.expr("array(named_struct('family', 'Abel', 'given', 'A.'), named_struct('family', 'Bell', 'given', 'B.'))")
    json = F.to_json(F.struct(F.array("p_name").alias("title"), people.alias("author"), date(year + 1).alias("published"), date(year).alias("published-print"), F.concat(F.lit("10.1000/"), text).alias("DOI")))
    entry = [F.lit("<entry><id>http://arxiv.org/abs/2001."), (10000 + k).cast("string"), F.lit("v7</id><title>T</title><published>"), (year + 1).cast("string"), F.lit("-01-01</published><author><name>Ada Abel</name></author></entry></feed>")]
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), *entry)
    shown = spread(_part(spark, sf_dir)).select(k.alias("k"), reg.display(json).alias("r"), reg.display_atom(xml).alias("x"))
    return shown.select("k", "r.title", "r.year", "r.first_author", F.col("r.authors").cast("int").alias("authors"), "r.doi", F.col("x.year").alias("atom_year"), F.col("x.first_author").alias("atom_author"), F.col("x.arxiv").alias("atom_id"))


@query("SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 3 = 0 THEN '@book{Abel2001, title={' || p_name || '}}' ELSE '@misc{Abel2001,' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  author = {Abel and Bell},' || chr(10) || '  year = {2001},' || chr(10) || '  eprint = {2001.' || p_partkey || '},' || chr(10) || '  archivePrefix = {arXiv}' || chr(10) || '}' END AS bibtex FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 < 2")
def s20_recovered_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX for references that were resolved, of the publisher or made of an arXiv record."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    part = _part(spark, sf_dir)
    at = k % 3
    known = part.select(
        (k + 10).alias("registry_id"), F.when(at == 1, "arxiv").otherwise("openalex").alias("source"), F.col("p_name").alias("title"), F.array(F.lit("Abel"), F.lit("Bell")).alias("families"), F.lit("2001").alias("year"),
        F.when(at == 0, F.lit("10.1000/1")).alias("doi"), F.when(at == 1, F.concat(F.lit("2001."), k.cast("string"))).otherwise(none).alias("arxiv"), F.concat(F.lit("@book{Old_1, title={"), "p_name", F.lit("}}")).alias("bibtex"),
    )
    resolved = part.select(k.alias("ref_id"), F.when(k % 4 != 0, k + 10).alias("registry_id"))
    return reg.recovered_bibtex(resolved, known)


@query("SELECT DISTINCT 'DOI:10.1000/' || p_partkey AS id FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 2 <> 0")
def s15_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of many ids asked for at once, those that name no paper."""
    ids = _part(spark, sf_dir).select(F.concat(F.lit("DOI:10.1000/"), F.col("p_partkey").cast("string")).alias("id"))
    return reg.missing(ids.union(ids), _doi_registry(spark, sf_dir))


def _stand_in(url: str, timeout: float, headers: dict[str, str]) -> str:
    """A registry that knows some works, is busy about some and refuses others, by the number at the end of the url."""
    n = int(url.rpartition("%2F")[2].partition("?")[0])
    code = {0: 404, 1: 503, 2: 400}.get(n % 7)
    if code:
        raise urllib.error.HTTPError(url, code, "", {"Retry-After": "0"}, None)
    return '{"message": {"title": ["Work %d"], "DOI": "10.1000/%d", "author": [{"family": "Abel"}]}, "data": {"attributes": {"titles": [{"title": "Work %d"}]}}}' % (n, n, n)


@query("SELECT p_partkey AS ref_id, source, CASE p_partkey % 7 WHEN 0 THEN 'miss' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'malformed' ELSE 'hit' END AS status, CASE WHEN p_partkey % 7 > 2 THEN 'Work ' || p_partkey END AS title FROM part, (VALUES ('crossref'), ('datacite')) v(source) WHERE p_partkey <= 200")
def s16_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by DOI, asked of a stand-in for both registries, and the answers decoded."""
    refs = _part(spark, sf_dir).where("p_partkey <= 200").select(F.col("p_partkey").alias("ref_id"), F.concat(F.lit("10.1000/"), F.col("p_partkey").cast("string")).alias("doi"))
    patience = {"timeout": 1, "attempts": 2, "longest_wait": 0, "step": 0}
    return requests.answers(requests.by_doi(refs), pause=0, patience=patience, fetch=_stand_in).select("ref_id", "source", "status", "record.title")


@query("SELECT 'https://host/a%2F' || (p_partkey % 40) AS url, CASE p_partkey % 40 % 7 WHEN 0 THEN 'miss' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'malformed' ELSE 'hit' END AS status, CASE p_partkey % 40 % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 400 ELSE 200 END AS code FROM part GROUP BY ALL")
def s17_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct url is asked once, with the patience of a look-up."""
    urls = _part(spark, sf_dir).select(F.lit("host").alias("host"), F.concat(F.lit("https://host/a%2F"), (F.col("p_partkey") % 40).cast("string")).alias("url"))
    return fetch_all(urls, 0, {"timeout": 60, "attempts": 4, "longest_wait": 0, "step": 3}, _stand_in).select("url", "status", "code")


@query("SELECT p_brand AS bib, count(*) AS n, sum(CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END) AS unavailable, sum(CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 7 = 0 AND p_partkey % 2 <> 0 THEN 1 ELSE 0 END) AS dead FROM part GROUP BY p_brand")
def s21_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict log's totals of each bibliography."""
    from citeloom.plans.report import totals
    from citeloom.plans.queries import _judged

    judged = _judged(spark, sf_dir).select("bib", "verdict")
    return totals(judged).select("bib", "n", F.coalesce(F.element_at("verdicts", F.lit("LOOKUP FAILED")), F.lit(0)).cast("bigint").alias("unavailable"), F.coalesce(F.element_at("verdicts", F.lit("FABRICATED")), F.lit(0)).cast("bigint").alias("dead"))


@query("SELECT p_partkey AS ref_id, p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1000000 END AS registry_id, CASE WHEN p_partkey % 2 = 0 THEN 'crossref' ELSE 'arxiv' END AS source, CAST(1 AS INT) AS rank FROM part WHERE p_partkey % 3 <> 0 AND p_partkey <= 500")
def r4_look_up_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that several records have, told apart by an author."""
    k, none, text = F.col("p_partkey"), F.lit(None).cast("string"), F.col("p_partkey").cast("string")
    part = _part(spark, sf_dir).where("p_partkey <= 500")
    letters = F.concat(F.lit("Au"), F.translate(text, "0123456789", "abcdefghij"))
    titles = part.select(k.alias("ref_id"), F.expr(TITLE).alias("title"), F.when(k % 3 == 0, "Nobody").otherwise(F.concat(letters, F.lit(", X."))).alias("author"))
    one = lambda shift, family: part.select((k + shift).alias("registry_id"), F.when(k % 2 == 0, "crossref").otherwise("arxiv").alias("source"), F.upper(F.expr(TITLE)).alias("title"), F.array(family).alias("families"), none.alias("doi"), none.alias("arxiv"))
    known = one(0, F.when(k % 2 == 0, letters).otherwise("Other")).unionByName(one(1_000_000, F.when(k % 2 == 0, "Other").otherwise(letters)))
    return look_up_by_author(titles, reg.prepared(known))


@query("SELECT '2001.' || (10000 + p_partkey) || 'v2' AS id, CASE WHEN p_partkey % 5 = 0 THEN 'miss' ELSE 'hit' END AS status, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 5 <> 0 THEN CAST(2 AS INT) END AS authors FROM part")
def r4_verify_arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single arXiv ids."""
    number, none = F.concat(F.lit("2001."), (10000 + F.col("p_partkey")).cast("string")), F.lit(None).cast("string")
    part = _part(spark, sf_dir)
    known = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("registry_id"), F.lit("arxiv").alias("source"), F.col("p_name").alias("title"), F.array(F.lit("A"), F.lit("B")).alias("families"), F.lit("2001").alias("year"), none.alias("doi"), number.alias("arxiv"))
    return verify_arxiv(part.select(F.concat(number, F.lit("v2")).alias("id")), reg.prepared(known)).select("id", "status", "title", "authors")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 1 THEN '10.1000/' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 2 THEN '2001.' || p_partkey END AS arxiv FROM part")
def s13_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match by title leads to identifiers, if to anything."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    one = F.struct(F.col("p_name").alias("title"), F.struct(F.when(k % 3 == 1, F.concat(F.lit("10.1000/"), text)).alias("DOI"), F.when(k % 3 == 2, F.concat(F.lit("2001."), text)).alias("ArXiv")).alias("externalIds"))
    json = F.when(k % 3 == 0, '{"error": "Title match not found"}').otherwise(F.to_json(F.struct(F.array(one).alias("data"))))
    return _part(spark, sf_dir).select(k.alias("k"), reg.s2_match(json).alias("r")).select("k", "r.title", "r.doi", "r.arxiv")
