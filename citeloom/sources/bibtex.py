"""BibTeX as a source: entries of many files at once, parsed where the text is read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "bib string, pos int, key string, etype string, fields map<string,string>, raw string"
_HEAD = re.compile(r"@(\w+)\s*\{")
_KEY = re.compile(r"\s*([^,\s]+)\s*,")
_FIELD = re.compile(r"\s*([A-Za-z][\w-]*)\s*=\s*")
_BRACE = re.compile(r"[{}]")
#: Entries that are held and sent on at a time, however many a file has.
SENT_ENTRIES = 1000
_NO_ENTRY = ("comment", "preamble", "string")


def _closing(text: str, at: int) -> int:
    """The place after the brace that closes the one before `at`; the end of the text if none does."""
    depth = 1
    for m in _BRACE.finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def parse_fields(body: str) -> dict[str, str]:
    """Fields in braces, in quotes or bare; names in lower case, the last of equal ones counts."""
    fields, at = {}, 0
    while (m := _FIELD.match(body, at)) and m.end() < len(body):
        at = m.end()
        if body[at] == "{":
            end = _closing(body, at + 1)
            value, at = body[at + 1 : end - 1], end
        elif body[at] == '"':
            end = body.find('"', at + 1)
            end = len(body) if end < 0 else end
            value, at = body[at + 1 : end], end + 1
        else:
            value = re.match(r"[^,\n]*", body[at:]).group()
            at += len(value)
        fields[m.group(1).lower()] = " ".join(value.split())
        comma = body.find(",", at)
        if comma < 0:
            break
        at = comma + 1
    return fields


def parse_bibtex(text: str) -> Iterator[tuple[str, str, dict[str, str], str]]:
    """(key, type, fields, raw text) of each entry; comments, preambles and strings are passed over, not what is in them."""
    at = 0
    while (m := _HEAD.search(text, at)) is not None:
        etype, at = m.group(1).lower(), m.end()
        if etype in _NO_ENTRY:
            continue
        end = _closing(text, at)
        body = text[at : end - 1]
        raw, at = text[m.start() : end], end
        if key := _KEY.match(body):
            yield key.group(1), etype, parse_fields(body[key.end() :]), raw


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of batches (bib, text), SENT_ENTRIES of them at a time."""
    types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
    files = (file for batch in batches for file in zip(*batch.columns, strict=True))
    rows = ((bib.as_py(), k, key, etype, list(fields.items()), raw) for bib, text in files for k, (key, etype, fields, raw) in enumerate(parse_bibtex(text.as_py() or ""), 1))
    while some := list(islice(rows, SENT_ENTRIES)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=["bib", "pos", "key", "etype", "fields", "raw"])


def bib_entries(files: DataFrame) -> DataFrame:
    """Entries of (bib, text); pos counts entries of a file from 1. A null text has none."""
    return files.select(F.col("bib").cast("string"), F.col("text").cast("string")).mapInArrow(_entries, ENTRY)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("bib"), F.col("value").alias("text"))
    return bib_entries(files)
