"""Bounded samples of labelled texts, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32 of the id as text leaves 0 here are never learnt from.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, *, doc_col: str = "doc_id", text_col: str = "text", row_bytes: int | None = None, **extra: Column) -> DataFrame:
    """(key, text, label, weight) of about ``most`` rows of each class at the most, chosen by a hash of the id, ``key``.

    ``weight`` makes up for a class that is sampled more thinly. Rows without id, label or text, and rows of
    the held-out fold, are left out, and so are texts of more than ``row_bytes`` bytes if that is given; an id
    labelled twice counts once if its labels agree, and an id that many documents share is one row, with its
    least text. ``extra``: further columns, expressions over ``docs``.
    """
    known = labels.select(F.col(doc_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    whole = 1 << 20
    rate = F.when(F.col("label") == 1, min(whole, most * whole // max(1, counts.get(1, 0)))).otherwise(min(whole, most * whole // max(1, counts.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < rate).withColumn("weight", F.lit(float(whole)) / rate)
    # about 2 * most rows of three numbers, whatever the tables' size
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(f"x_{k}") for k, c in extra.items())).where("text IS NOT NULL")
    if row_bytes:
        texts = texts.where(F.octet_length("text") <= row_bytes)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "weight").agg(F.min(F.struct("text", *(f"x_{k}" for k in extra))).alias("row"))
    return found.select(F.xxhash64("doc_id").alias("key"), "row.text", "label", "weight", *(F.col(f"row.x_{k}").alias(k) for k in extra))
