"""From raw documents to packed token sequences, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)): it works on all that its predecessor
kept and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads
again as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined cases, of every stage: a null or empty text is a document without words, which is not
contaminated, has no secret and packs as its end id; the classifier judges it like any other, and it is
nobody's near duplicate, but of rows that repeat both id and text one stays. Nulls in other columns are kept as they
are; rows with a null id are rows like others. Further columns, whatever their names, are kept by all
stages but the last. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactloom.llm import decontaminate, jaccard, packing, quality, secret_scan
from contactloom.llm.shared import materialized, small_batches


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=quality.METADATA)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    small_batches(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_findings(spark)), length_col="n_chars")


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", _quality),
    ("n-gram Jaccard join", _near_duplicates),
    ("benchmark decontamination", _decontamination),
    ("secret scans", _secrets),
    ("packing", _packing),
]

#: No SQL: the classifier, the forest and the tokenizer can't be said in it. The tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialized(docs, f"stage{k}")
    return docs
