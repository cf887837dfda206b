"""Bibliographies as they arrive: an extension, for audits are batches.

New files of a folder are parsed and audited a micro-batch at a time. Each batch is written under
its number, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from citeloom.plans.audit import audit_entries
from citeloom.sources.bibtex import bib_entries
from citeloom.sources.registry import kept


def audit_stream(spark: SparkSession, folder: str, registry: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Audits the .bib files of `folder` that were not yet seen, and ends; verdicts go to out/batch=N."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.bib").schema("value string").load(folder)
    named = files.select(F.col("_metadata.file_path").alias("bib"), F.col("value").alias("text"))

    registry = kept(registry)  # once for all batches

    def write(batch: DataFrame, number: int) -> None:
        audit_entries(bib_entries(batch), registry).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
