"""Verdicts, tiers, counts, order and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INVENTED, FABRICATED, METADATA, STYLE = 1, 2, 3, 4
TIERS = [
    (INVENTED, "Cited work found nowhere", "Search by hand before acting; where it does not exist, the claim that cites it has no support."),
    (FABRICATED, "Identifier of nothing, or author not on record", "Correct the identifier from the title, never the title from the identifier."),
    (METADATA, "Real work, wrong details", "Take the fields from the canonical source; no question of integrity."),
    (STYLE, "Format", "Safe to settle last and all at once."),
]
#: Ways of resolution that an identifier pins.
PINNED = ("arxiv", "crossref:doi", "datacite:doi", "s2->crossref", "s2->arxiv")
PRINTED = ("arxiv", "crossref:doi", "datacite:doi")
FINDING = "struct<priority:int,summary:string,detail:string>"


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "priority int, title string, guidance string")


def structured_verdict(status: Column, dead: Column, found: Column, anonymized: Column, kind: Column, how: Column, issues: Column, wrong_work: Column) -> Column:
    """The verdict on a structured reference; unavailable lookups come before anything else."""
    return (
        F.when(status == "unavailable", "LOOKUP FAILED")
        .when(status == "malformed", "CHECK")
        .when(dead.isNotNull(), "FABRICATED")
        .when(~found & (anonymized | (kind != "article")), "UNVERIFIABLE")
        .when(~found, "NOT FOUND")
        .when(wrong_work & how.isin(*PRINTED), "FABRICATED")
        .when(issues, "CHECK")
        .otherwise("OK")
    )


def bib_verdict(status: Column, dead: Column, found: Column, how: Column, issues: Column) -> Column:
    """The verdict on a BibTeX entry: a difference is hard only against the publisher's record of a printed DOI."""
    return (
        F.when(status == "unavailable", "LOOKUP FAILED")
        .when(dead.isNotNull(), "FABRICATED")
        .when(~found, "UNRESOLVED")
        .when(issues & (how == "crossref:doi"), "MISMATCH")
        .when(issues, "CHECK")
        .otherwise("OK")
    )


def raw_verdict(status: Column, dead: Column, found: Column, anonymized: Column, grey: Column, how: Column, issues: Column, wrong_work: Column) -> Column:
    """The verdict on a reference split out of plain text; none of its findings is above tier 3."""
    return (
        F.when(status == "unavailable", "LOOKUP FAILED")
        .when(dead.isNotNull(), "SUSPECT")
        .when(~found & anonymized, "CHECK")
        .when(~found & grey, "UNINDEXED")
        .when(~found, "NOT FOUND")
        .when(wrong_work & how.isin(*PRINTED) & ~anonymized, "SUSPECT")
        .when(issues, "CHECK")
        .otherwise("OK")
    )


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(bib, verdict, n)."""
    return verdicts.groupBy("bib", "verdict").agg(F.count(F.lit(1)).alias("n"))


def tier_counts(findings: DataFrame) -> DataFrame:
    """(bib, priority, n, worst) of findings (bib, priority, ...); priority null is the total, as rollup gives it."""
    counted = findings.rollup("bib", "priority").agg(F.count(F.lit(1)).alias("n"), F.min("priority").alias("worst"))
    return counted.where("bib is not null")


def gate(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """(bib, gate): 1 if any finding is of tier 1 or 2, or any printed reference is suspect or not found, else 0."""
    bad = verdicts.groupBy("bib").agg(F.max(F.col("verdict").isin("FABRICATED", "NOT FOUND", "MISMATCH", "SUSPECT").cast("int")).alias("v"))
    worst = findings.groupBy("bib").agg(F.min("priority").alias("w"))
    return bad.join(worst, "bib", "left").select("bib", F.greatest("v", F.coalesce((F.col("w") <= FABRICATED).cast("int"), F.lit(0))).alias("gate"))


def placed(findings: DataFrame) -> DataFrame:
    """Findings with place, their rank within a bibliography: by tier, then label as text, then place of emission."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("bib").orderBy("priority", "ref", "pos")))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings of all bibliographies in that order."""
    return placed(findings).orderBy("bib", "place").drop("place")


def report(findings: DataFrame, totals: DataFrame) -> DataFrame:
    """(bib, report): the ranked findings of each bibliography as text; totals is (bib, total)."""
    spark = findings.sparkSession
    line = F.concat(F.lit("  ["), "ref", F.lit("] "), "summary", F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit("\n        "), F.regexp_replace("detail", "\n", "\n        "))).otherwise(""))
    by_tier = findings.groupBy("bib", "priority").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ref", "pos", line.alias("line")))).alias("lines"))
    named = by_tier.join(F.broadcast(tiers(spark)), "priority")
    head = F.concat(F.lit("P"), F.col("priority").cast("string"), F.lit(" "), "title", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n    "), "guidance", F.lit("\n"))
    block = F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    whole = named.select("bib", "priority", "n", block.alias("block")).groupBy("bib").agg(F.array_sort(F.collect_list(F.struct("priority", "block"))).alias("b"), F.sum("n").alias("n"))
    text = F.concat(F.col("n").cast("string"), F.lit(" findings across "), F.col("total").cast("string"), F.lit(" references\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"))
    none = F.concat(F.lit("No findings across "), F.col("total").cast("string"), F.lit(" references."))
    return totals.join(whole, "bib", "left").select("bib", F.when(F.col("n").isNull(), none).otherwise(text).alias("report"))
