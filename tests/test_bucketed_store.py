"""The store in buckets: as the plain upsert, few files a batch, killed batches, versions; and counts kept up from its changes."""

import os

import pytest
from pyspark.sql import functions as F

from contactloom.operators import store, views
from contactloom.operators.bucketed import BucketedStore
from contactloom.plans import catalog
from contactloom.streaming import feed


def rows(frame):
    return sorted(map(str, frame.select(*store.LEAD_FIELDS, "seq").collect()))


@pytest.mark.parametrize("rule", store.ON_DUPLICATE)
def test_same_as_the_plain_upsert(spark, sf_dir, tmp_path, rule):
    leads, batch = catalog.leads(spark, sf_dir), catalog._second_batch(spark, sf_dir)
    kept = BucketedStore(spark, str(tmp_path), buckets=16)
    assert kept.read().count() == 0 and kept.manifest().version == 0
    kept.upsert(leads, "reject", "t1")
    before = rows(kept.read())
    kept.upsert(batch, rule, "t2")
    plain = store.upsert(store.upsert(leads.limit(0), leads, "reject", "t1").drop("status"), batch, rule, "t2")
    assert rows(kept.read()) == rows(plain)
    assert rows(kept.read(1)) == before
    url = leads.first()["source_url"]
    assert kept.by_source_url(f" {url} ").count() == 1 and kept.by_source_url("").count() == 0


def test_few_files_a_batch_and_killed_batches(spark, tmp_path):
    leads = catalog.leads(spark, "/root/testdata/sf0.01")
    kept = BucketedStore(spark, str(tmp_path), buckets=512)
    kept.upsert(leads, "reject", "t")
    old = kept.manifest()
    few = leads.where("seq % 100 = 7").withColumn("page_title", F.lit("changed"))
    kept.upsert(few, "replace", "t")
    new = kept.manifest()
    other = [k for k in new.batches if new.batches[k] != old.batches.get(k)]
    assert 0 < len(other) <= few.count() == 15 and len(new.batches) > 450
    files = [f for d, _, names in os.walk(f"{tmp_path}/data/{new.batches[other[0]]}") for f in names if f.endswith(".parquet")]
    assert len(files) == len(other)
    assert kept.read().where("page_title = 'changed'").count() == 15 and kept.read(1).where("page_title = 'changed'").count() == 0

    # killed before its manifest: the files are there, the version is not
    before, real = rows(kept.read()), kept._commit
    kept._commit = lambda m: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        kept.upsert(few.withColumn("page_title", F.lit("never")), "replace", "t")
    kept._commit = real
    os.makedirs(f"{tmp_path}/manifest/version=000000000003/_temporary")  # and one killed while it wrote that
    again = BucketedStore(spark, str(tmp_path), buckets=7)
    assert again.versions() == [0, 1, 2] and again.buckets == 512 and rows(again.read()) == before
    assert again.upsert(few, "merge", "t") == 3

    # a batch with a version of its own counts once
    assert again.upsert(few, "merge", "t2", version=3) == 3 and again.versions() == [0, 1, 2, 3]
    gone = again.vacuum(keep=1)
    assert again.versions() == [3] and len(gone) > 3 and again.read().count() == leads.count()
    assert {d for d in os.listdir(f"{tmp_path}/data")} == set(again.manifest().batches.values())


def test_deletes_empty_batches_and_changes(spark, sf_dir, tmp_path):
    leads = catalog.leads(spark, sf_dir).where("seq <= 20")
    kept = BucketedStore(spark, str(tmp_path), buckets=8)
    kept.upsert(leads.unionByName(leads.limit(1).withColumn("source_url", F.lit("  "))), "reject", "t")
    assert kept.upsert(leads.limit(0), "merge", "t") == 2 and kept.changes(1, 2).count() == 0
    urls = [r["source_url"] for r in kept.read().orderBy("seq").limit(3).collect()]
    kept.delete(spark.createDataFrame([(urls[0],), (urls[0],), ("nowhere",), (None,)], "source_url string"))
    kept.upsert(kept.read().where(F.col("source_url") == urls[1]).withColumn("page_title", F.lit("x")), "replace", "t")
    found = {r["source_url"]: (r["old"] is None, r["new"] is None) for r in kept.changes(2).collect()}
    assert found == {urls[0]: (False, True), urls[1]: (False, False)}
    top = kept.manifest().top
    kept.clear()
    assert kept.read().count() == 0 and kept.manifest().top == top
    kept.upsert(leads.limit(1), "reject", "t")
    assert kept.read().first()["seq"] > top


def test_counts_follow_the_changes(spark, sf_dir, tmp_path):
    path = lambda name: str(tmp_path / name)
    leads, batch = catalog.leads(spark, sf_dir), catalog._second_batch(spark, sf_dir)
    kept = BucketedStore(spark, path("store"), buckets=4)

    def same():
        # each call is a restart of the stream
        feed.counts(spark, path("feed"), path("totals"), path("checkpoint")).awaitTermination()
        assert feed.totals(spark, path("totals")).collect() == views.kpis(kept.read()).collect()

    kept.upsert(leads, "reject", "t")
    assert feed.publish(kept, path("feed")) == [1] and feed.publish(kept, path("feed")) == []
    same()
    kept.upsert(batch, "replace", "t")
    kept.upsert(batch, "merge", "t")
    assert feed.publish(kept, path("feed")) == [2, 3]
    same()
    kept.delete(leads.where("seq % 3 = 0").select("source_url"))
    feed.publish(kept, path("feed"))
    # the files of a version once more: known to the state, so they change nothing
    feed.events(kept, 3, 4).write.parquet(f"{path('feed')}/again")
    same()
    kept.clear()
    kept.upsert(leads.limit(2), "reject", "t")
    feed.publish(kept, path("feed"))
    same()
    assert feed.totals(spark, path("totals")).first()["leads"] == 2
