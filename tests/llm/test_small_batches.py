"""The pipeline's stages send texts to Python in small batches."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from contactloom.llm.shared import BATCH_BYTES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_end_at_a_few_mib(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("some words "), 9_000).alias("text"))  # 40 MB

    def _sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes], pa.int64())], ["bytes"])

    try:
        for name, stage in corpus_pipeline.STAGES:
            if name in ("n-gram Jaccard join", "benchmark decontamination", "packing"):
                spark.conf.unset(KEY)
                stage(spark, docs, sf_dir)
                sizes = [r[0] for r in texts.mapInArrow(_sizes, "bytes long").collect()]
                assert sum(sizes) > 39_000_000 and max(sizes) < 2 * BATCH_BYTES, name
        spark.conf.set(KEY, "1m")  # a smaller bound of the session's own stays
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.unset(KEY)
