"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/contactloom/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores more as it takes to be no column's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def temporary(spark: SparkSession, path: str) -> None:
    """What lies there is removed when the driver ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: later uses don't compute them again, and lost executors lose none.

    The table is removed when the driver ends.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    temporary(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches end at ``BATCH_BYTES``, or earlier if it is set so.

    Each running task holds a batch in the JVM, more while its buffers grow, and one in its Python worker; Spark's own bound is 64 MiB.
    """
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)
