"""Checks of BibTeX entries that need no registry, and what author lists tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.identifiers import and_others

FINDING = "array<struct<priority:int,check:string,summary:string,detail:string,fix:string>>"


def finding(priority: int, check: str, summary: Column | str, detail: Column, fix: str) -> Column:
    text = summary if isinstance(summary, Column) else F.lit(summary)
    return F.struct(F.lit(priority).alias("priority"), F.lit(check).alias("check"), text.alias("summary"), detail.alias("detail"), F.lit(fix).alias("fix"))


def collected(*pairs: tuple[Column, Column]) -> Column:
    """The findings whose conditions hold, in order; a null condition doesn't."""
    return F.filter(F.array(*(F.when(c, f) for c, f in pairs)), lambda f: f.isNotNull())


def style_checks(get) -> list[tuple[str, Column, str, Column, str]]:
    """(check, condition, summary, value shown, remedy); get(name) is a field, '' if absent."""
    pages, doi, url, month, title, author = map(get, ("pages", "doi", "url", "month", "title", "author"))
    inner = F.regexp_replace(title, r"^[{}]+|[{}]+$", "")
    braced = title.startswith("{") & title.endswith("}") & (F.length(title) - F.length(F.replace(title, F.lit("{"), F.lit(""))) == 1)
    return [
        ("Y1", pages.rlike(r"^\s*\d+\s*-\s*\d+\s*$"), "a single hyphen in a page range", pages, "write 35--49"),
        ("Y2", pages.rlike(r"^\s*1\s*(?:--?|–)\s*\d+\s*$"), "pages that begin at 1, as placeholders do", pages, "compare with the published version, or leave pages out"),
        ("Y3", doi.rlike(r"(?i)https?://|doi\.org"), "a link where a bare DOI belongs", doi, "keep only what begins with 10."),
        ("Y4", (doi != "") & (url != "") & F.contains(F.lower(url), F.substring_index(F.lower(doi), "doi.org/", -1)), "a url that repeats the doi", url, "leave the url out"),
        ("Y5", F.trim(month).rlike("^[A-Za-z]{4,}$"), "a month in full", month, "use the three-letter macro"),
        ("Y6", braced & (F.contains(F.trim(inner), F.lit(" ")) | F.substring(inner, 1, 1).rlike(r"^\p{Ll}")), "braces around the whole title", title, "brace only words that must keep their capitals"),
        ("Y7", (F.length(title) > 8) & (title == F.upper(title)), "a title in capitals", F.substring(title, 1, 60), "write it in title case"),
        ("Y8", author.rlike(r"\b[A-Z]\.[A-Z]\."), "initials without a space between them", F.substring(author, 1, 70), "write J. D. Owens"),
    ]


def style_findings(fields: Column) -> Column:
    """Findings of tier 4 of a map of fields."""
    get = lambda name: F.coalesce(F.element_at(fields, F.lit(name)), F.lit(""))
    return collected(*((c, finding(4, check, summary, shown, fix)) for check, c, summary, shown, fix in style_checks(get)))


def author_list_tells(author: Column, on_record: Column) -> Column:
    """Findings of tier 3 on "and others"; on_record is the number of authors the registry has, or null."""
    author = F.coalesce(author, F.lit(""))
    listed = F.size(F.filter(F.split(author, r"\s+and\s+"), lambda a: F.trim(a) != "")) - 1
    detail = F.concat(F.lit("listed: "), listed.cast("string"))
    few = F.coalesce(on_record <= 6, F.lit(False))
    hidden = F.concat(F.lit("'and others' hides authors of a work that has "), on_record.cast("string"))
    return collected(
        (and_others(author) & few, finding(3, "C4", hidden, detail, "list all authors of the canonical record")),
        (and_others(author) & ~few, finding(3, "C4", "'and others' cuts the author list short", detail, "prefer the list as printed")),
    )


def generation_signal(entries: DataFrame) -> DataFrame:
    """(bib, n, total, keys): bibliographies in which two entries or more say "and others", with the first eight of their keys."""
    says = and_others(F.element_at("fields", F.lit("author")))
    keys = F.sort_array(F.collect_list(F.when(says, F.struct("pos", "key"))))
    found = entries.groupBy("bib").agg(F.count(F.when(says, 1)).alias("n"), F.count(F.lit(1)).alias("total"), keys.alias("k"))
    return found.where("n >= 2").select("bib", "n", "total", F.transform(F.slice("k", 1, 8), lambda x: x["key"]).alias("keys"))
