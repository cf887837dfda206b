"""Structured references as JSON arrays, and reference lists as plain text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRUCTURED = (
    "n string, title string, authors array<string>, year string, doi string, arxiv string, venue string, url string, "
    "identifier_printed string, kind string, authors_truncated boolean, anonymized boolean, raw string"
)
KINDS = ("article", "dataset", "report", "software", "standard", "thesis", "web")


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """(bib, pos, fields of STRUCTURED): one row for each object; a file that isn't a JSON array of objects is an error."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("bib"), "value")
    return structured_refs(text.withColumnRenamed("value", "text"))


def structured_refs(files: DataFrame) -> DataFrame:
    """The same from rows (bib, text). Label n defaults to the place in the list, kind to article."""
    array = F.from_json("text", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in STRUCTURED.split(', '))}>>", {"mode": "FAILFAST"})
    whole = F.when(F.ltrim("text").startswith("["), array).otherwise(F.raise_error(F.concat(F.lit("not a JSON array: "), "bib")))
    refs = files.select("bib", F.posexplode(whole).alias("k", "r")).select("bib", (F.col("k") + 1).alias("pos"), "r.*")
    return refs.withColumns({"n": F.coalesce(F.nullif("n", F.lit("")), F.col("pos").cast("string")), "kind": F.lower(F.coalesce(F.nullif("kind", F.lit("")), F.lit("article")))})


#: Every break that Unicode text counts as the end of a line.
LINE_BREAK = r"\r\n|[\n\r\f\u000b\u001c-\u001e\u0085\u2028\u2029]"


def text_lines(files: DataFrame, newline: str | None = None) -> DataFrame:
    """(doc_id, pos, line) of rows (doc_id, text), pos from 0; a break at the end begins no line.

    Where newline is given it alone separates lines and nothing else is done: what follows the last one is a line, though it be
    empty, as is an empty text. A null text has no lines.
    """
    if newline is not None:
        return files.select("doc_id", F.posexplode(F.split("text", re.escape(newline), -1)).alias("pos", "line"))
    parts = F.split(F.coalesce("text", F.lit("")), LINE_BREAK)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select("doc_id", F.posexplode(parts).alias("pos", "line"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))


def reference_section(text):
    """What follows the last line that is nothing but the heading References or Bibliography; all of it if none is. Form feeds go."""
    clean = F.translate(text, "\f", "")
    tail = F.regexp_extract(clean, r"(?is)^.*(?:^|\n)\s*(?:\d+\.?\s*)?(?:references|bibliography)\s*\n(.*)$", 1)
    return F.when(tail == "", clean).otherwise(tail)
