"""Comparison of a reference with the record it resolves to.

Each comparison returns a struct of what was found; verdicts are made of those.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.similarity import COVERAGE, MATCH_RATIO, WRONG_WORK

MARKERS = ("others", "al", "etal", "anonymous", "anon")
_NONE = "array<string>"


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def years_on_record(years: Column, year: Column) -> Column:
    years = F.array_compact(_strings(years))
    return F.when(F.size(years) > 0, years).when(year.isNotNull(), F.array(year)).otherwise(F.array().cast(_NONE))


def authors_apart(names: Column, cited: Column, known: Column, truncated: Column, compat: bool = False) -> Column:
    """struct(invented, missing): names of which no key is on record, and how many of the record's no cited key is of.

    cited and known are arrays of key sets, cited in step with names. compat pairs names with key
    sets after those without keys have gone, which misnames what follows one.
    """
    marks = F.array(*(F.lit(m) for m in MARKERS))
    bare = lambda sets: F.transform(F.coalesce(sets, F.array().cast("array<array<string>>")), lambda s: F.array_except(s, marks))
    filled = lambda sets: F.filter(sets, lambda s: F.size(s) > 0)
    names = F.filter(_strings(names), lambda n: n.isNotNull() & (n != ""))
    cited, known = bare(cited), filled(bare(known))
    pairs = F.arrays_zip(names.alias("name"), (filled(cited) if compat else cited).alias("keys"))
    cited_all, known_all = F.flatten(cited), F.flatten(known)
    both = (F.size(cited_all) > 0) & (F.size(known) > 0)
    strange = F.filter(pairs, lambda p: (F.size(p["keys"]) > 0) & ~F.arrays_overlap(p["keys"], known_all))
    missing = F.size(F.filter(known, lambda s: ~F.arrays_overlap(s, cited_all)))
    missing = F.when(both & ~F.coalesce(truncated, F.lit(False)), missing).otherwise(0)
    return F.struct(
        F.when(both, F.transform(strange, lambda p: p["name"])).otherwise(F.array().cast(_NONE)).alias("invented"),
        F.when(missing > 2, missing).otherwise(0).alias("missing"),
    )


def year_differs(year: Column, years: Column, arxiv: Column) -> Column:
    """A year that the record hasn't; a preprint may be posted up to three years before the year cited."""
    year = F.nullif(F.trim(year), F.lit(""))
    since = lambda y: F.try_subtract(F.expr("0") + year.try_cast("int"), y.try_cast("int"))
    later = F.exists(years, lambda y: F.coalesce(since(y).between(1, 3), F.lit(False)))
    return F.coalesce((F.size(years) > 0) & ~F.array_contains(years, year) & ~(arxiv & later), F.lit(False))


def title_apart(coverage: Column, has_titles: Column) -> tuple[Column, Column]:
    """Whether titles differ, and whether so much that it is another work."""
    low = F.coalesce(has_titles & (coverage < COVERAGE), F.lit(False))
    return low, low & (coverage < WRONG_WORK)


def bib_differences(ratio: Column, title: Column, rec_title: Column, cited: Column, families: Column, year: Column, years: Column) -> Column:
    """For an entry: struct(title, count, missing, extra, year); authors as sorted lists of family keys."""
    cited, families = F.array_sort(_strings(cited)), F.array_sort(_strings(families))
    differ = (F.size(families) > 0) & (cited != families)
    sets = lambda a, b: F.when(differ, F.array_sort(F.array_except(a, b))).otherwise(F.array().cast(_NONE))
    year = F.trim(F.coalesce(year, F.lit("")))
    return F.struct(
        F.coalesce((title != "") & (rec_title != "") & (ratio < MATCH_RATIO), F.lit(False)).alias("title"),
        (differ & (F.size(cited) != F.size(families))).alias("count"),
        sets(families, cited).alias("missing"),
        sets(cited, families).alias("extra"),
        ((year != "") & (F.size(years) > 0) & ~F.array_contains(years, year)).alias("year"),
    )


def raw_agreement(ref_norm: Column, anonymized: Column, coverage: Column, rec_title: Column, first: Column, ref_years: Column, years: Column) -> Column:
    """For a reference as printed: struct(anonymized, title, wrong_work, author, year).

    The first family counts as found if a word of the reference is it, begins with its first five
    letters, or begins it.
    """
    words = F.filter(F.split(ref_norm, " "), lambda w: w != "")
    there = F.exists(words, lambda w: (w == first) | w.startswith(F.substring(first, 1, 5)) | first.startswith(w))
    open_ = ~anonymized
    low, wrong = title_apart(coverage, F.coalesce(rec_title, F.lit("")) != "")
    return F.struct(
        anonymized.alias("anonymized"),
        (open_ & low).alias("title"),
        (open_ & wrong).alias("wrong_work"),
        (open_ & F.coalesce((first != "") & ~there, F.lit(False))).alias("author"),
        (open_ & (F.size(ref_years) > 0) & (F.size(years) > 0) & ~F.arrays_overlap(ref_years, years)).alias("year"),
    )
