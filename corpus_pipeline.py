"""A training-corpus pipeline of operators in citeloom.llm, from documents to packed bins.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns
what it keeps, with the same columns; the last returns where each document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import decontaminate, linededup, ngramjoin, packing, quality
from citeloom.llm.common import forget, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that mostly repeat themselves go.

    Each row is judged by itself: null and empty texts stay, as do rows of null doc_id; repeated rows stay or go
    together; texts of any length are judged whole; an empty table stays one.
    """
    return quality.without_repetitive(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has, give or take one edit, go; so do documents left empty by that.

    Short lines go only where they are equal. Rows of null doc_id or null text stay as they are, and so do documents
    that were empty before; lines at one place, by (doc_id, line number), as rows of one doc_id have, are not earlier than
    each other, so repeated rows stay; texts of any length are compared whole; an empty table stays one.
    """
    return linededup.without_duplicate_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id stays.

    Null, empty and wordless texts are like no other and stay, and so do rows of null doc_id; rows that repeat a doc_id are
    one document and stay or go together; equal texts are a group, of which the least doc_id stays; texts of any length count
    whole; an empty table stays one.
    """
    return ngramjoin.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Each row is judged by itself: null and empty texts stay, rows of null doc_id and repeated rows go by their text; every
    passage of a text of any length is searched; with no documents or no items nothing goes.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, shard, bin_no, position, tokens, loss_tokens, oversize) of each document.

    Rows of null doc_id have no name to be packed under and are left out here, though the stages before keep them; null and
    empty texts have no tokens and take a place; a text over a limit has a bin of its own, marked oversize; repeated rows are
    packed each; ties go to the lower demand, then the lower doc_id; an empty table gives no rows.
    """
    return packing.pack_examples(packing.document_examples(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Suffix arrays and the packing heuristic are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if k:  # what the stage before kept is of no more use
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
