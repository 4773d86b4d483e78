"""The change feed of a bucketed store, and its five counts kept up by keyed streaming state.

``publish`` writes what changed between versions as files, a folder a version. ``counts`` reads them as a stream: the state knows what each page's lead
counted last, so a changed version of a lead becomes the difference to it. A row of a version that the state has seen already changes nothing, and the
sums are numbered by the stream's batches, so that batches and publications that run again count once.

The state's keys are ``GROUPS`` groups of pages, by a hash of their URL: a call of Python and its round trips to the state cost milliseconds, and are made for a
group instead of a page. As in the store, what a batch reads and writes grows with the groups that it touches. A checkpoint holds for one number of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contactloom.operators.bucketed import BucketedStore
from contactloom.sources import folders

COUNTS = ["leads", "phones", "whatsapp", "emails", "social_links"]
_EVENT = "source_url string, version long, " + ", ".join(f"{c} long" for c in COUNTS)
_TOTALS = ", ".join(f"{c} long" for c in COUNTS)
#: Keys of the state, each with the pages of one hash.
GROUPS = 1024
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(store: BucketedStore, since: int, until: int) -> DataFrame:
    """What each changed lead counts in the version ``until``: nothing if it is gone."""
    n = lambda c: F.coalesce(F.size(f"new.{c}"), F.lit(0)).cast("long")
    found = [F.col("new").isNotNull().cast("long").alias("leads")] + [F.when(F.col("new").isNull(), 0).otherwise(n(c)).alias(c) for c in COUNTS[1:]]
    return store.changes(since, until).select("source_url", F.lit(until).cast("long").alias("version"), *found)


def publish(store: BucketedStore, folder: str) -> list[int]:
    """Writes the changes of all versions that aren't in the folder yet; gives their numbers."""
    spark = store.spark
    done = {int(x.split("=")[1]) for x in folders.names(spark, folder) if x.startswith("feed=") and "_SUCCESS" in folders.names(spark, f"{folder}/{x}")}
    new = [v for v in store.versions()[1:] if v not in done]
    for v in new:
        events(store, v - 1, v).write.mode("overwrite").parquet(f"{folder}/feed={v:012d}")
    return new


def _packed(known: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(known.reset_index(), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(raw)).read_all().to_pandas().set_index("source_url")


class _Differences(StatefulProcessor):
    """The state of a group: the last version of each of its pages, and what it counted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "pages binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        known = None if held is None else _unpacked(held[0])
        changed, fresh = pd.Series(0, COUNTS), False
        for some in rows:
            latest = some.sort_values(["version", *COUNTS]).drop_duplicates("source_url", keep="last").set_index("source_url")[["version", *COUNTS]]
            known = latest[:0] if known is None else known
            old = known.reindex(latest.index, fill_value=0)
            newer = ~latest.index.isin(known.index) | (latest["version"] > old["version"]).to_numpy()
            if newer.any():
                fresh = True
                changed += (latest[newer] - old[newer])[COUNTS].sum()
                known = pd.concat([known[~known.index.isin(latest.index[newer])], latest[newer]])
        if fresh:
            self.last.update((_packed(known),))
        if changed.any():
            yield pd.DataFrame([changed.tolist()], columns=COUNTS)

    def close(self) -> None:
        pass


def totals(spark: SparkSession, base: str) -> DataFrame:
    """The counts after the last batch: one row."""
    done = [x for x in folders.names(spark, base) if "_SUCCESS" in folders.names(spark, f"{base}/{x}")]
    if not done:
        return spark.range(1).select(*(F.lit(0).cast("long").alias(c) for c in COUNTS))
    return spark.read.schema(_TOTALS).parquet(f"{base}/{done[-1]}")


def counts(spark: SparkSession, folder: str, base: str, checkpoint: str, files_at_once: int = 1000):
    """A started stream that adds what is in the folder to the counts under ``base`` and ends. The folders are shared by all executors."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        read = spark.readStream.schema(_EVENT).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").parquet(folder)
        grouped = read.withColumn("group", F.pmod(F.xxhash64("source_url"), F.lit(GROUPS))).groupBy("group")
        changed = grouped.transformWithStateInPandas(_Differences(), _TOTALS, "Append", "None")

        def add(rows: DataFrame, number: int) -> None:
            path = f"{base}/batch={number:012d}"
            known = [x for x in folders.names(spark, base) if x < f"batch={number:012d}" and "_SUCCESS" in folders.names(spark, f"{base}/{x}")]
            old = rows.sparkSession.read.schema(_TOTALS).parquet(f"{base}/{known[-1]}") if known else rows.sparkSession.createDataFrame([], _TOTALS)
            rows.unionByName(old).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).coalesce(1).write.mode("overwrite").parquet(path)

        return changed.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
