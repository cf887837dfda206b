"""Audits from the command line: `python -m citeloom entries|structured|printed|look-up ...`.

Exit codes: 0 nothing to act on, 1 a finding of tier 1 or 2 or a reference that fails the gate, 2 input that can't be audited.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.lines import split_references
from citeloom.operators.resolve import look_up, look_up_by_author, verify_arxiv
from citeloom.plans import audit, report
from citeloom.sources import registry as reg
from citeloom.sources.bibtex import read_bibtex
from citeloom.sources.structured import read_structured, reference_section, text_lines
from citeloom.storage import stored


class BadInput(Exception):
    """What can't be audited, with the reason."""


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="citeloom", description="Audits bibliographies against registry tables.")
    kinds = parser.add_subparsers(dest="kind", required=True)
    for kind, help_ in (("entries", "BibTeX files"), ("structured", "JSON arrays of references"), ("printed", "text of reference lists or papers")):
        sub = kinds.add_parser(kind, help=help_)
        sub.add_argument("path", help="files, a folder or a pattern")
        sub.add_argument("--registry", required=True, help="Parquet table of records")
        sub.add_argument("--down", help="Parquet table (ref_id, source) of what could not be asked")
        sub.add_argument("--out", help="folder for verdicts, findings, totals and report")
        sub.add_argument("--format", default="parquet", choices=("parquet", "json"))
        if kind == "entries":
            sub.add_argument("--key", help="audit only the entries of this key")
        if kind != "structured":
            sub.add_argument("--show-bibtex", action="store_true", help="print canonical BibTeX; the registry needs a column bibtex")
    sub = kinds.add_parser("look-up", help="candidates for one title, or one arXiv id")
    sub.add_argument("--registry", required=True)
    sub.add_argument("--title")
    sub.add_argument("--author")
    sub.add_argument("--arxiv")
    sub.add_argument("--rows", type=int, default=3)
    return parser


def _printed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), reference_section(F.col("value")).alias("text"))
    return split_references(text_lines(files)).select(F.col("doc_id").alias("bib"), F.col("ref_no").alias("pos"), "ref")


def _audited(spark: SparkSession, options: argparse.Namespace) -> int:
    registry, down = reg.kept(spark.read.parquet(options.registry)), spark.read.parquet(options.down) if options.down else None
    entries, findings = None, None
    if options.kind == "entries":
        entries = read_bibtex(spark, options.path)
        entries = stored(entries if options.key is None else entries.where(F.col("key") == options.key), "entries")
        if entries.isEmpty():
            raise BadInput(f"no entry {options.key!r} in {options.path}" if options.key else f"no entries in {options.path}")
        verdicts = stored(audit.audit_entries(entries, registry, down), "verdicts")
        findings = audit.with_generation_signal(audit.exploded(verdicts), entries)
    elif options.kind == "structured":
        verdicts = stored(audit.audit_structured(read_structured(spark, options.path), registry, down), "verdicts")
    else:
        refs = stored(_printed(spark, options.path), "references")
        if refs.isEmpty():
            raise BadInput(f"no references in {options.path}")
        verdicts = stored(audit.audit_printed(refs, registry, down), "verdicts")
    for row in report.log(verdicts).orderBy("bib", "pos").toLocalIterator():
        print(row["line"])
    for row in report.report(verdicts, findings).orderBy("bib").toLocalIterator():
        print(f"\n{row['bib']}\n{row['report']}")
    if getattr(options, "show_bibtex", False):
        if entries is not None:
            made = audit.canonical_replacements(entries, verdicts, registry)
        else:
            made = reg.recovered_bibtex(verdicts.select(F.concat_ws("#", "bib", F.col("pos").cast("string")).alias("ref_id"), "registry_id"), registry)
        for row in made.toLocalIterator():
            print(f"\n{row['bibtex']}")
    if options.out:
        report.write(verdicts, options.out, options.format, findings)
    return report.exit_code(verdicts, findings)


def _looked_up(spark: SparkSession, options: argparse.Namespace) -> int:
    registry = reg.kept(spark.read.parquet(options.registry))
    if options.arxiv:
        row = verify_arxiv(spark.createDataFrame([(options.arxiv,)], "id string"), registry).first()
        print(f"{row['id']}  {row['status']}  {row['year'] or ''}  {row['title'] or ''}  {row['first_author'] or ''} ({row['authors'] or 0} authors)")
        return 0 if row["status"] == "hit" else 1
    if not options.title:
        raise BadInput("a title or an arXiv id is needed")
    titles = spark.createDataFrame([(1, options.title, options.author)], "ref_id long, title string, author string")
    found = look_up_by_author(titles, registry, options.rows) if options.author else look_up(titles, registry, options.rows)
    shown = found.join(registry.select("registry_id", "title", "year", "families", "doi", "arxiv"), "registry_id").orderBy(F.col("source").desc(), "rank")
    for row in shown.toLocalIterator():
        print(f"{row['source']}  {row['year'] or ''}  {row['title']}  {(row['families'] or [''])[0]} ({len(row['families'] or [])} authors)  {row['doi'] or row['arxiv'] or ''}")
    return 0


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    options = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("citeloom").getOrCreate()
    try:
        return _looked_up(spark, options) if options.kind == "look-up" else _audited(spark, options)
    except BadInput as problem:
        print(problem, file=sys.stderr)
    except PySparkException as problem:
        print(str(problem).splitlines()[0], file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main())
