"""The audits end to end: references in, verdicts and ranked findings out.

Each takes many bibliographies at once and a registry table, and returns one row for each
reference: (bib, pos, ref, verdict, how, dead, registry_id, findings). Nothing is collected
and no step pairs all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.classify import guess_title_col, is_anonymized, is_grey
from citeloom.functions.identifiers import authors, blank_to_null, field_arxiv, printed_arxiv, printed_doi, unescape_identifier, years
from citeloom.functions.similarity import coverage_col, ratio_col
from citeloom.functions.text import each_family_key, key_sets, norm_col, squash_col
from citeloom.operators import triage
from citeloom.operators.compare import authors_apart, bib_differences, raw_agreement, title_apart, year_differs, years_on_record
from citeloom.operators.resolve import resolve_entries, resolve_printed, resolve_structured
from citeloom.operators.style import author_list_tells, collected, finding, generation_signal, style_findings
from citeloom.sources.registry import kept, rekeyed_bibtex
from citeloom.storage import spread, stored

VERDICT = ["bib", "pos", "ref", "verdict", "how", "dead", "registry_id", "findings"]


def _ids(refs: DataFrame) -> DataFrame:
    """A name for each reference; one without a bibliography is told apart by its place all the same."""
    return refs.withColumn("ref_id", F.concat(F.coalesce(F.col("bib").cast("string"), F.lit("\0")), F.lit("#"), F.coalesce(F.col("pos").cast("string"), F.lit("\0"))))


def _kept(refs: DataFrame) -> DataFrame:
    """References over all cores and stored: they are read for each rung and for the comparison, and what makes them, as parsing, is done once."""
    return stored(spread(_ids(refs)), "references")


def _records(registry: DataFrame) -> DataFrame:
    names = ("title", "families", "years", "year", "source", "norm", "squash", "doi")
    return registry.select("registry_id", *(F.col(c).alias(f"rec_{c}") for c in names))


def _with_records(refs: DataFrame, outcomes: DataFrame, registry: DataFrame) -> DataFrame:
    return refs.join(outcomes, "ref_id").join(_records(registry), "registry_id", "left").withColumn("found", F.col("registry_id").isNotNull())


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def audit_structured(refs: DataFrame, registry: DataFrame, down: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Structured references (bib, pos and the columns of sources.structured)."""
    registry = kept(registry)
    refs = _kept(refs)
    columns = ["ref_id", "title", "authors", "doi", "arxiv", "kind", "anonymized", "venue", "raw"]
    met = _with_records(refs, resolve_structured(refs.select(*columns), registry, down, compat), registry)
    norm = norm_col(_text(F.col("title")))
    blind = F.col("how") == "s2:match"  # evidence that the work exists, not what it says
    met = met.withColumn("coverage", coverage_col(_text(F.col("rec_squash")), squash_col(norm)))
    low, wrong = title_apart(F.col("coverage"), ~blind & (_text(F.col("title")) != "") & (_text(F.col("rec_title")) != ""))
    met = met.withColumns({"cited_keys": key_sets(F.coalesce("authors", F.array().cast("array<string>"))), "known_keys": key_sets(F.coalesce("rec_families", F.array().cast("array<string>")))})
    apart = authors_apart(F.col("authors"), F.col("cited_keys"), F.col("known_keys"), F.col("authors_truncated"), compat)
    preprint = F.contains("how", F.lit("arxiv")) | (_text(F.col("rec_source")) == "arxiv")
    year = year_differs(F.col("year"), years_on_record(F.col("rec_years"), F.col("rec_year")), preprint)
    met = met.withColumns({"apart": apart, "low": low, "wrong": wrong, "late": ~blind & year})
    invented = ~blind & (F.size("apart.invented") > 0)
    missing = ~blind & (F.col("apart.missing") > 0)
    kind = F.coalesce(blank_to_null(F.lower("kind")), F.lit("article"))
    anonymized = F.coalesce("anonymized", F.lit(False))
    met = met.withColumns({"invented": F.col("found") & invented, "missing": F.col("found") & missing, "is_kind": kind, "is_anonymized": anonymized})
    issues = F.col("found") & (F.col("low") | F.col("invented") | F.col("missing") | F.col("late"))
    verdict = triage.structured_verdict(F.col("status"), F.col("dead"), F.col("found"), F.col("is_anonymized"), F.col("is_kind"), F.col("how"), issues, F.col("wrong"))
    met = met.withColumn("verdict", verdict)
    shown = F.substring(F.coalesce(blank_to_null(F.col("title")), F.col("raw"), F.lit("?")), 1, 66)
    names = F.array_join("apart.invented", "; ")
    details = F.array_join(F.array_compact(F.array(
        F.when(F.col("low"), F.concat(F.lit("title on record: "), "rec_title")),
        F.when(F.col("missing"), F.concat(F.col("apart.missing").cast("string"), F.lit(" authors on record are not cited"))),
        F.when(F.col("late"), F.concat(F.lit("year cited: "), "year", F.lit(", on record: "), F.array_join(F.array_sort(years_on_record(F.col("rec_years"), F.col("rec_year"))), "/"))),
    )), "\n")
    v = F.col("verdict")
    findings = collected(
        (F.col("dead").isNotNull() & (v == "FABRICATED"), finding(2, "dead", F.concat("dead", F.lit(" names no paper")), shown, "correct the identifier, not the title")),
        ((v == "FABRICATED") & F.col("found"), finding(2, "wrong work", "the printed identifier is that of another work", F.concat_ws("\n", details, F.when(invented, names)), "resolve the identifier again from the title")),
        (v == "NOT FOUND", finding(1, "not found", F.concat(F.lit("no source has the title: "), "how"), shown, "search the exact title by hand")),
        ((v == "UNVERIFIABLE") & ~F.col("is_anonymized"), finding(3, "unverifiable", F.concat("is_kind", F.lit(": registries don't hold these")), shown, "see that the link resolves and an access date is given")),
        ((v == "CHECK") & (F.col("status") == "malformed"), finding(3, "malformed", "no identifier, though printed as one", shown, "compare with the paper: a line wrap may have cut it")),
        ((v == "CHECK") & F.col("invented") & F.col("how").isin(*triage.PINNED), finding(2, "invented author", F.concat(F.lit("not on record: "), names), F.col("how"), "take the authors from the record")),
        ((v == "CHECK") & F.col("found") & (details != ""), finding(3, "metadata", F.substring(F.substring_index(details, "\n", 1), 1, 110), details, "take the fields from the record, once it is the right one")),
    )
    label = F.concat(F.lit("ref "), F.coalesce(blank_to_null(F.col("n")), F.col("pos").cast("string")))
    return met.select("bib", "pos", label.alias("ref"), "verdict", "how", "dead", "registry_id", findings.alias("findings"))


def audit_entries(entries: DataFrame, registry: DataFrame, down: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """BibTeX entries (bib, pos, key, etype, fields, raw); only those of one key if given."""
    registry = kept(registry)
    entries = entries if key is None else entries.where(F.col("key") == key)
    get = lambda name: F.element_at("fields", F.lit(name))
    refs = _kept(entries).withColumns({"title": get("title"), "doi": unescape_identifier(get("doi")), "arxiv": field_arxiv(F.col("fields"))})
    met = _with_records(refs, resolve_entries(refs.select("ref_id", "title", "doi", "arxiv"), registry, down), registry)
    met = met.withColumns({"norm": norm_col(_text(F.col("title"))), "cited": each_family_key(authors(get("author"))), "known": each_family_key(F.coalesce("rec_families", F.array().cast("array<string>")))})
    met = met.withColumn("ratio", ratio_col(F.col("norm"), _text(F.col("rec_norm"))))
    differ = bib_differences(F.col("ratio"), _text(F.col("title")), _text(F.col("rec_title")), F.col("cited"), F.col("known"), get("year"), years_on_record(F.col("rec_years"), F.col("rec_year")))
    met = met.withColumn("d", differ).withColumn("pinned", F.col("how").isin(*triage.PRINTED))
    pinned = F.col("found") & F.col("pinned")
    count, missing, extra = pinned & F.col("d.count"), pinned & (F.size("d.missing") > 0), pinned & (F.size("d.extra") > 0)
    title, year = F.col("found") & F.col("d.title"), F.col("found") & F.col("d.year")
    verdict = triage.bib_verdict(F.col("status"), F.col("dead"), F.col("found"), F.col("how"), title | year | count | missing | extra)
    met = met.withColumn("verdict", verdict)
    remedy = "take the field from the canonical source"
    own = collected(
        (F.col("verdict") == "FABRICATED", finding(2, "dead", F.concat("dead", F.lit(" names no paper")), _text(F.col("title")), "correct the identifier, not the title")),
        ((F.col("verdict") == "UNRESOLVED") & (_text(F.col("title")) != ""), finding(1, "not found", F.lit("no source has this title"), _text(F.col("title")), "search the exact title by hand")),
        (title, finding(3, "title", F.lit("titles differ"), F.concat_ws("\n", "title", "rec_title"), remedy)),
        (count, finding(3, "author count", F.lit("another number of authors"), F.concat_ws(" / ", F.size("cited").cast("string"), F.size("known").cast("string")), remedy)),
        (missing, finding(3, "missing author", F.concat(F.lit("on record, not in the entry: "), F.array_join("d.missing", ", ")), F.lit(""), remedy)),
        (extra, finding(2, "invented author", F.concat(F.lit("in the entry, not on record: "), F.array_join("d.extra", ", ")), F.lit(""), remedy)),
        (year, finding(3, "year", F.lit("another year on record"), F.concat_ws(" / ", get("year"), F.array_join(years_on_record(F.col("rec_years"), F.col("rec_year")), ", ")), remedy)),
    )
    tells = F.when(F.col("found"), author_list_tells(get("author"), F.nullif(F.size("rec_families"), F.lit(0)))).otherwise(F.array().cast(own_type := "array<struct<priority:int,check:string,summary:string,detail:string,fix:string>>"))
    findings = F.concat(style_findings(F.col("fields")).cast(own_type), tells.cast(own_type), own.cast(own_type))
    return met.select("bib", "pos", F.col("key").alias("ref"), "verdict", "how", "dead", "registry_id", findings.alias("findings"))


def audit_printed(refs: DataFrame, registry: DataFrame, down: DataFrame | None = None) -> DataFrame:
    """References split out of text (bib, pos, ref). They were parsed by heuristics, so no finding is above tier 3."""
    registry = kept(registry)
    text = F.col("raw_ref")
    refs = spread(_ids(refs.withColumnRenamed("ref", "raw_ref")))
    refs = stored(refs.withColumns({"arxiv": printed_arxiv(text), "doi": printed_doi(text), "title_guess": guess_title_col(text), "norm": norm_col(text), "anonymized": is_anonymized(text), "grey": is_grey(text)}), "references")
    met = _with_records(refs, resolve_printed(refs.select("ref_id", "arxiv", "doi", "title_guess", F.col("raw_ref").alias("ref")), registry, down), registry)
    met = met.withColumns({"coverage": coverage_col(_text(F.col("rec_squash")), squash_col(F.col("norm"))), "known": each_family_key(F.coalesce("rec_families", F.array().cast("array<string>")))})
    agreement = raw_agreement(F.col("norm"), F.col("anonymized"), F.col("coverage"), F.col("rec_title"), F.get("known", F.lit(0)), years(text), years_on_record(F.col("rec_years"), F.col("rec_year")))
    met = met.withColumn("a", agreement)
    issues = F.col("found") & (F.col("a.anonymized") | F.col("a.title") | F.col("a.author") | F.col("a.year"))
    met = met.withColumn("issues", issues)
    verdict = triage.raw_verdict(F.col("status"), F.col("dead"), F.col("found"), F.col("anonymized"), F.col("grey"), F.col("how"), issues, F.col("found") & F.col("a.wrong_work"))
    met = met.withColumn("verdict", verdict)
    shown = F.concat(F.substring(text, 1, 70), F.when(F.length(text) > 70, "...").otherwise(""))
    what = F.array_join(F.array_compact(F.array(
        F.when(F.col("a.anonymized"), F.lit("withheld for review")),
        F.when(F.col("a.title"), F.concat(F.lit("title on record: "), "rec_title")),
        F.when(F.col("a.author"), F.concat(F.lit("first author on record: "), F.get("known", F.lit(0)))),
        F.when(F.col("a.year"), F.concat(F.lit("year on record: "), F.array_join(years_on_record(F.col("rec_years"), F.col("rec_year")), "/"))),
    )), "\n")
    v = F.col("verdict")
    findings = collected(
        ((v == "SUSPECT") & F.col("dead").isNotNull(), finding(3, "dead", F.concat(F.lit("PROVISIONAL: "), "dead", F.lit(" names no paper")), shown, "see whether a line wrap cut the identifier")),
        ((v == "SUSPECT") & F.col("found"), finding(3, "wrong work", F.lit("PROVISIONAL: the printed identifier is that of another work"), F.concat_ws("\n", what, shown), "see that the reference was split right")),
        (v == "UNINDEXED", finding(3, "grey", F.lit("registries don't hold works of this kind"), shown, "see that the link resolves and an access date is given")),
        (v == "NOT FOUND", finding(3, "not found", F.lit("PROVISIONAL: no source has it"), shown, "most likely split wrongly: compare with the paper")),
        ((v == "CHECK") & F.col("issues"), finding(3, "metadata", F.substring(F.substring_index(what, "\n", 1), 1, 110), what, "compare with the published record")),
    )
    label = F.concat(F.lit("ref "), F.col("pos").cast("string"))
    return met.select("bib", "pos", label.alias("ref"), "verdict", "how", "dead", "registry_id", findings.alias("findings"))


def exploded(verdicts: DataFrame) -> DataFrame:
    """(bib, pos, ref, priority, check, summary, detail, fix): one row for each finding, in order of emission by pos and k."""
    return verdicts.select("bib", "pos", "ref", F.posexplode("findings").alias("k", "f")).select("bib", "pos", "ref", "k", "f.*")


def with_generation_signal(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings of entries and, for bibliographies that say "and others" twice or more, one for the whole."""
    s = generation_signal(entries)
    summary = F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" entries say 'and others'"))
    detail = F.concat(F.array_join("keys", ", "), F.when(F.col("n") > 8, "...").otherwise(""))
    whole = s.select("bib", F.lit(2**31 - 1).alias("pos"), F.lit("(whole bibliography)").alias("ref"), F.lit(0).alias("k"), F.lit(3).alias("priority"), F.lit("C5").alias("check"), summary.alias("summary"), detail.alias("detail"), F.lit("check every identifier").alias("fix"))
    return findings.unionByName(whole)


def canonical_replacements(entries: DataFrame, verdicts: DataFrame, registry: DataFrame) -> DataFrame:
    """(bib, pos, key, bibtex) for entries that differ from the publisher's record; registry has a column bibtex."""
    wrong = verdicts.where("verdict = 'MISMATCH'").select("bib", "pos", "registry_id")
    met = entries.join(wrong, ["bib", "pos"]).join(registry.select("registry_id", "bibtex"), "registry_id")
    return met.select("bib", "pos", "key", rekeyed_bibtex(F.col("bibtex"), F.col("key")).alias("bibtex"))


def summary(verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdict counts, tier counts and the gate of each bibliography."""
    findings = exploded(verdicts)
    return triage.verdict_counts(verdicts), triage.tier_counts(findings), triage.gate(verdicts, findings)
