"""Each stage of the pipeline on what its predecessor kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactloom.llm import decontaminate, jaccard, secret_scan


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, texts = docs.columns, [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        kept.append(docs)
    for before, after in zip(kept, kept[1:4]):
        assert after.columns == columns and {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    groups = jaccard.similar_groups(kept[0])
    assert kept[1].count() == groups.select("component_id").distinct().count()
    reports = decontaminate.scan(kept[1], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert kept[2].count() == reports.where("NOT contaminated").count() > 0
    assert kept[3].count() == kept[2].count() and kept[3].where("n_chars <> length(text)").count() == 0
    assert secret_scan.scan(kept[3], secret_scan.train(secret_scan.labelled_findings(spark))).where("secret").count() == 0
    pieces = kept[4].groupBy("doc_id").sum("length").join(kept[4].select("doc_id", "doc_tokens").distinct(), "doc_id")
    assert pieces.where("`sum(length)` <> doc_tokens").count() == 0 and pieces.count() == kept[3].count()


PROSE = " ".join(np.random.default_rng(2).choice([f"word{k}" for k in range(300)], 200))
CLASHING = ["_row", "row", "found", "label", "hits", "pieces", "offset", "sid"]


@pytest.fixture(scope="module")
def hostile(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeats, and columns with the stages' own names."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 300").orderBy("item_id").first()["text"]
    secret = f'key token = "{"0123456789abcdef" * 2 + "01234567"}" end {PROSE[::-1]}'
    texts = [PROSE, PROSE, PROSE + " more", None, "", " \n", item, secret, "x " * 30_000]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(0, PROSE, None, None, None), (3, None, None, None, None), (None, secret, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING))).repartition(3)


@pytest.mark.parametrize("k", range(5))
def test_hostile_rows(spark, sf_dir, hostile, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = hostile.collect()
    got = stage(spark, hostile, sf_dir).collect()
    none = stage(spark, hostile.limit(0), sf_dir)
    assert none.count() == 0
    if k == 4:
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in rows}
        assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
        assert sum(r["start"] == 0 for r in got) == len(rows)
        return
    assert none.columns == hostile.columns and all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in got)
    key = lambda rs: sorted(map(str, ((r["doc_id"], r["text"]) for r in rs)))
    if k == 0:
        assert set(key(got)) <= set(key(rows))
    elif k == 1:
        kept = [(r["doc_id"], (r["text"] or "-")[:5]) for r in got]
        assert sorted(map(str, kept)) == sorted(map(str, [(0, PROSE[:5]), (3, "-"), (4, "-"), (5, " \n"), (6, rows_text(rows, 6)), (7, "key t"), (8, "x x x"), (None, "-")]))
    elif k == 2:
        assert key(got) == key([r for r in rows if r["doc_id"] != 6])
    else:
        assert len(got) == len(rows) and sum("[SECRET]" in (r["text"] or "") for r in got) == 2
        assert key([r for r in got if "[SECRET]" not in (r["text"] or "")]) == key([r for r in rows if "token =" not in (r["text"] or "")])


def rows_text(rows, k):
    return next(r["text"][:5] for r in rows if r["doc_id"] == k)
