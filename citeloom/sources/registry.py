"""Registry records: decoders of what registries deliver, lookups and canonical BibTeX.

A registry is a table (registry_id, source, title, families, year, years, doi, arxiv, ctype,
venue) of sources crossref, datacite, arxiv, openalex and s2. Names are kept whole and keyed late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.identifiers import doi_key, drop_version
from citeloom.functions.text import norm_col, squash_col
from citeloom.storage import spread, stored

RECORD = "source string, title string, families array<string>, year string, years array<string>, doi string, arxiv string, ctype string, venue string"
_STRINGS = "array<string>"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _record(source: str, **columns: Column) -> Column:
    fields = [f.split(" ") for f in RECORD.split(", ")]
    return F.struct(*((F.lit(source) if name == "source" else columns.get(name, F.lit(None))).cast(kind).alias(name) for name, kind in fields))


def _names(people: Column, pick) -> Column:
    return F.coalesce(F.filter(F.transform(people, pick), lambda n: n.isNotNull() & (n != "")), F.array().cast(_STRINGS))


def crossref(json: Column) -> Column:
    """A Crossref message: families where given; all years deposited, online and print, the first of them as year."""
    v = F.try_parse_json(json)
    dates = F.array_distinct(F.array_compact(F.array(*(_get(v, f"$.{d}['date-parts'][0][0]") for d in ("published", "published-print", "published-online", "issued")))))
    people = _get(v, "$.author", "array<variant>")
    return _record(
        "crossref",
        title=F.coalesce(_get(v, "$.title[0]"), F.lit("")),
        families=_names(people, lambda p: _get(p, "$.family")),
        years=dates,
        year=F.get(dates, F.lit(0)),
        doi=_get(v, "$.DOI"),
        ctype=F.lower(F.trim(F.coalesce(_get(v, "$.type"), F.lit("")))),
        venue=F.coalesce(_get(v, "$['container-title'][0]"), F.lit("")),
    )


def datacite(json: Column) -> Column:
    """DataCite attributes: family names, else whole ones."""
    v = F.try_parse_json(json)
    year = _get(v, "$.publicationYear")
    people = _get(v, "$.creators", "array<variant>")
    return _record(
        "datacite",
        title=F.coalesce(_get(v, "$.titles[0].title"), F.lit("")),
        families=_names(people, lambda p: F.coalesce(_get(p, "$.familyName"), _get(p, "$.name"))),
        year=year,
        years=F.array_compact(F.array(year)),
        doi=_get(v, "$.doi"),
    )


def openalex(json: Column) -> Column:
    v = F.try_parse_json(json)
    year = _get(v, "$.publication_year")
    return _record(
        "openalex",
        title=F.coalesce(_get(v, "$.display_name"), F.lit("")),
        families=_names(_get(v, "$.authorships", "array<variant>"), lambda p: _get(p, "$.author.display_name")),
        year=year,
        years=F.array_compact(F.array(year)),
        doi=F.regexp_replace(_get(v, "$.doi"), r"^https://doi\.org/", ""),
    )


def s2_match(json: Column) -> Column:
    """A title match: its title and the identifiers it leads to."""
    v = F.try_parse_json(json)
    return _record("s2", title=F.coalesce(_get(v, "$.data[0].title"), F.lit("")), doi=_get(v, "$.data[0].externalIds.DOI"), arxiv=_get(v, "$.data[0].externalIds.ArXiv"))


def arxiv_atom(xml: Column) -> Column:
    """The first entry of an Atom feed; null if it has none, or the entry reports an error. The year is that of the first version."""
    title = F.trim(F.regexp_replace(F.xpath_string(xml, F.lit("/feed/entry/title")), r"\s+", " "))
    year = F.nullif(F.left(F.xpath_string(xml, F.lit("/feed/entry/published")), F.lit(4)), F.lit(""))
    record = _record(
        "arxiv",
        title=title,
        families=F.filter(F.transform(F.xpath(xml, F.lit("/feed/entry[1]/author/name/text()")), lambda n: F.trim(n)), lambda n: n != ""),
        year=year,
        years=F.array_compact(F.array(year)),
        arxiv=drop_version(F.substring_index(F.xpath_string(xml, F.lit("/feed/entry/id")), "/abs/", -1)),
    )
    return F.when(~title.isin("", "Error"), record)


def display(json: Column) -> Column:
    """What a look-up prints of a Crossref message: print year before others, first author, number of authors."""
    v = F.try_parse_json(json)
    people = _get(v, "$.author", "array<variant>")
    first = F.get(people, F.lit(0))
    return F.struct(
        _get(v, "$.title[0]").alias("title"),
        F.coalesce(*(_get(v, f"$.{d}['date-parts'][0][0]") for d in ("published-print", "published", "issued"))).alias("year"),
        F.concat_ws(", ", _get(first, "$.family"), _get(first, "$.given")).alias("first_author"),
        F.coalesce(F.size(people), F.lit(0)).alias("authors"),
        _get(v, "$['container-title'][0]").alias("venue"),
        _get(v, "$.DOI").alias("doi"),
    )


def display_atom(xml: Column) -> Column:
    """What a look-up prints of the first entry of an Atom feed; null if it has none."""
    r = arxiv_atom(xml)
    shown = F.struct(r["title"].alias("title"), r["year"].alias("year"), F.get(r["families"], F.lit(0)).alias("first_author"), F.size(r["families"]).alias("authors"), r["arxiv"].alias("arxiv"))
    return F.when(r.isNotNull(), shown)


def kept(registry: DataFrame) -> DataFrame:
    """`prepared`, written to shared storage, for what looks a registry up in many ways: names and titles are put in
    normal form once. A registry that is prepared already, as a long-lived one should be stored, is taken as it is."""
    return registry if "squash" in registry.columns else stored(prepared(spread(registry)), "registry")


def prepared(registry: DataFrame) -> DataFrame:
    """The registry with what lookups and comparisons need, computed once per record."""
    if "squash" in registry.columns:
        return registry
    norm = norm_col(F.coalesce("title", F.lit("")))
    with_norm = registry.withColumns({"doi_key": doi_key(F.col("doi")), "arxiv_key": F.lower(drop_version(F.trim("arxiv"))), "norm": norm})
    return with_norm.withColumn("squash", squash_col(F.col("norm")))


def rekeyed_bibtex(raw: Column, key: Column) -> Column:
    """Canonical BibTeX under the entry's own key."""
    return F.regexp_replace(raw, F.lit(r"^\s*@(\w+)\s*\{[^,]+,"), F.concat(F.lit("@$1{"), F.regexp_replace(key, r"([\\$])", r"\\$1"), F.lit(",")))


def arxiv_bibtex(key: Column, title: Column, author: Column, year: Column, arxiv: Column) -> Column:
    rows = [("title", title), ("author", author), ("year", year), ("eprint", arxiv), ("archivePrefix", F.lit("arXiv"))]
    body = [F.concat(F.lit(f"  {name} = {{"), F.coalesce(value, F.lit("")), F.lit("}")) for name, value in rows]
    return F.concat(F.lit("@misc{"), key, F.lit(",\n"), F.concat_ws(",\n", *body), F.lit("\n}"))


def canonical_bibtex(key: Column, source: Column, doi: Column, bibtex: Column, title: Column, author: Column, year: Column, arxiv: Column) -> Column:
    """The publisher's BibTeX where there is a DOI, one made of the arXiv record, or null."""
    return F.when(doi.isNotNull(), rekeyed_bibtex(bibtex, key)).when(source == "arxiv", arxiv_bibtex(key, title, author, year, arxiv))


def recovered_key(families: Column, year: Column) -> Column:
    return F.concat(F.coalesce(F.get(families, F.lit(0)), F.lit("ref")), F.coalesce(year, F.lit("")))


def recovered_bibtex(resolved: DataFrame, registry: DataFrame) -> DataFrame:
    """(ref_id, bibtex) for references (ref_id, registry_id) that were resolved; registry has a column bibtex.

    The publisher's under a key made of first family and year, or one made of an arXiv record, or none.
    """
    met = resolved.where("registry_id is not null").join(registry, "registry_id")
    made = canonical_bibtex(recovered_key(F.col("families"), F.col("year")), F.col("source"), F.col("doi"), F.col("bibtex"), F.col("title"), F.array_join("families", " and "), F.col("year"), F.col("arxiv"))
    return met.select("ref_id", made.alias("bibtex")).where("bibtex is not null")


def missing(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """Prefixed ids that name no paper, by anti-join on the key: answers in bulk come unordered and leave them out."""
    return batch_lookup(ids, registry).where("registry_id is null").select("id")


def batch_lookup(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, registry_id) of prefixed ids, DOI:... or ARXIV:...; null for those that name no paper. Duplicates of an id are one."""
    kind, value = F.upper(F.substring_index("id", ":", 1)), F.lower(F.expr("substring(id, instr(id, ':') + 1)"))
    asked = ids.select("id").distinct().withColumns({"kind": kind, "value": value})
    known = prepared(registry)
    keys = known.select(F.lit("DOI").alias("kind"), F.col("doi_key").alias("value"), "registry_id").unionByName(known.select(F.lit("ARXIV").alias("kind"), F.col("arxiv_key").alias("value"), "registry_id"))
    keys = keys.where("value is not null").groupBy("kind", "value").agg(F.min("registry_id").alias("registry_id"))
    return asked.join(keys, ["kind", "value"], "left").select("id", "registry_id")
