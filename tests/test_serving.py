"""Pages and searches of the served copy give the rows of full scans, and read little."""

import pytest
from pyspark.sql import functions as F

from contactloom.operators import views
from contactloom.operators.serving import Served, build
from contactloom.plans import catalog

SEQS = lambda frame: [r["seq"] for r in frame.select("seq").collect()]


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    leads = catalog.leads(spark, "/root/testdata/sf0.01")
    odd = leads.where("seq <= 3").withColumn("seq", F.col("seq") + 10_000).withColumn("captured_at", F.when(F.col("seq") == 10_001, F.lit("no time"))).withColumn("page_title", F.lit("Ünïcode \U0001f600 title\nx"))
    leads = leads.unionByName(odd).cache()
    path = str(tmp_path_factory.mktemp("served"))
    build(leads, path, part_rows=100)
    return leads, Served(spark, path)


def test_pages(served):
    leads, kept = served
    assert len(kept.parts) > 10 and sum(n for _, n, _, _ in kept.parts) == leads.count()
    for size, number in ((50, 0), (50, 7), (130, 3), (50, 30), (50, 31), (1, 1502), (2000, 0)):
        assert SEQS(kept.page(size, number)) == SEQS(views.page(leads, size, number))
    some = kept.page(50, 20)
    assert len({f.split("/part=")[1].split("/")[0] for f in some.inputFiles()}) <= 2


def test_seek(served):
    leads, kept = served
    whole = leads.select("seq", views.captured_ms(F.col("captured_at")).alias("ms")).orderBy(F.desc("ms"), "seq").collect()
    for at in (0, 49, 99, 100, 101, 777, len(whole) - 2, len(whole) - 1):
        next_ = kept.after(whole[at]["ms"], whole[at]["seq"], 40)
        assert SEQS(next_) == [r["seq"] for r in whole[at + 1 : at + 41]]
        assert len(next_.inputFiles()) <= 3
    assert SEQS(kept.after(1 << 60, 0, 3)) == [r["seq"] for r in whole[:3]] and SEQS(kept.after(-1, 0, 3)) == []


@pytest.mark.parametrize("terms", ["", "77 INSTAGRAM.com/shop", "sales1499@", "shop 12", "7", "ünïcode", "\U0001f600 title", "title\tx", "nowhere-at-all", "+201000000123", "COM/P/ 99", "call tel-link", "ab"])
def test_searches(served, terms):
    leads, kept = served
    assert sorted(SEQS(kept.search(terms))) == sorted(SEQS(views.search(leads, terms)))


def test_a_rare_search_reads_few_parts(served):
    _, kept = served
    found = kept.search("sales1499@")
    assert len({f.split("/part=")[1].split("/")[0] for f in found.inputFiles() if "/part=" in f}) == 1
    plan = kept.candidates("sales1499@")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_empty_store(spark, tmp_path):
    build(catalog.leads(spark, "/root/testdata/sf0.001").limit(0), str(tmp_path))
    kept = Served(spark, str(tmp_path))
    assert kept.page().count() == 0 and kept.search("abc").count() == 0 and kept.search("").count() == 0 and kept.after(0, 0).count() == 0
