"""What an audit leaves behind: verdicts, findings and totals as tables, a log and a report as text, and an exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import triage
from citeloom.plans.audit import exploded


def totals(verdicts: DataFrame) -> DataFrame:
    """(bib, n, verdicts): how many references each bibliography has, and how many of each verdict."""
    counted = verdicts.groupBy("bib", "verdict").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("bib").agg(F.sum("c").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "c")))).alias("verdicts"))


def log(verdicts: DataFrame) -> DataFrame:
    """(bib, pos, line): one line for each reference, and one of totals, at the end, for each bibliography."""
    pad = F.rpad("verdict", 13, " ")
    each = verdicts.select("bib", F.col("pos").cast("long").alias("pos"), F.concat(pad, F.lit("  ["), "ref", F.lit("]  "), F.coalesce("how", F.lit(""))).alias("line"))
    parts = F.transform(F.map_entries("verdicts"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    whole = totals(verdicts).select("bib", F.lit((1 << 63) - 1).alias("pos"), F.concat(F.col("n").cast("string"), F.lit(" references; "), F.array_join(parts, ", ")).alias("line"))
    return each.unionByName(whole)


def report(verdicts: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(bib, report): the ranked findings of each bibliography as text."""
    findings = exploded(verdicts) if findings is None else findings
    return triage.report(findings, verdicts.groupBy("bib").agg(F.count(F.lit(1)).alias("total")))


def write(verdicts: DataFrame, folder: str, form: str = "parquet", findings: DataFrame | None = None) -> None:
    """verdicts, findings, totals and report as tables of a folder, which they replace. `verdicts` should be stored: it is read for each."""
    findings = exploded(verdicts) if findings is None else findings
    tables = {"verdicts": verdicts.drop("findings"), "findings": findings, "totals": totals(verdicts), "report": report(verdicts, findings)}
    for name, table in tables.items():
        table.write.mode("overwrite").format(form).save(f"{folder}/{name}")


def exit_code(verdicts: DataFrame, findings: DataFrame | None = None) -> int:
    """1 if any bibliography fails the gate, else 0."""
    findings = exploded(verdicts) if findings is None else findings
    return int(triage.gate(verdicts, findings).agg(F.max("gate")).first()[0] or 0)
