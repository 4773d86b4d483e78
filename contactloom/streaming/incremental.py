"""Incremental runs: new pages are captured and merged into the store, batch by batch.

Each batch makes a new version of a bucketed store, named by its number: a batch that runs again after a failure
finds its version or makes it, so nothing is counted twice, and only the buckets that it touches are rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators import extract
from contactloom.operators.bucketed import BucketedStore

PAGES = "page_id long, url string, html string"


def pages_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def current(spark: SparkSession, base: str, batch: int) -> DataFrame:
    """The store before a batch."""
    return BucketedStore(spark, base).read(batch)


def capture_stream(pages: DataFrame, base: str, checkpoint: str, *, captured_at: str, on_duplicate: str = "merge"):
    """A started query that takes what there is and ends. ``base`` and ``checkpoint`` are folders that all executors share."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        leads = extract.normalize_leads(extract.captured(rows, captured_at))
        leads = leads.where(extract.useful_values(leads) > 0)
        numbered = leads.withColumn("seq", F.monotonically_increasing_id())
        BucketedStore(spark, base).upsert(numbered, on_duplicate, captured_at, version=number + 1)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
