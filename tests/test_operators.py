"""Seeds, crawl, extraction, store and streaming, end to end on small tables."""

import pytest
from pyspark.sql import functions as F

from contactloom import cli
from contactloom.operators import export, extract, store, views
from contactloom.plans import catalog
from contactloom.sources.seeds import SeedError, read_seeds
from contactloom.sources.web import CrawlConfig, crawl
from contactloom.streaming import incremental

PAGE = """<html><head><title> Shop </title><script type="application/ld+json">{"telephone":"+20 100 000 0003"}</script></head><body>
<a href="https://wa.me/201001234567">WhatsApp</a><a href="tel:01001234567">Call</a><a href="mailto:Info@Shop.com">m</a><a href="mailto:b@shop.com">m</a>
<a href="https://instagram.com/Shop/?x=1">i</a><a href="https://facebook.com/shop">f</a><p>Phone: 010 0000 0002</p><a href="http://[bad">x</a><p>unclosed</body>"""


def test_seeds(spark, tmp_path):
    good = tmp_path / "a.txt"
    good.write_bytes("﻿https://www.a.com/x\n\nhttps://a.com\r\nhttp://b.com/ ".encode())
    assert [tuple(r) for r in read_seeds(spark, str(good)).collect()] == [(1, "https://www.a.com/x", "a.com"), (4, "http://b.com/", "b.com")]
    bad = tmp_path / "b.txt"
    bad.write_text("https://a.com\nnope\nhttps://a.com https://b.com\nftp://c.com\n")
    with pytest.raises(SeedError, match="line 2.*line 3.*line 4"):
        read_seeds(spark, str(bad))
    blank = tmp_path / "c.txt"
    blank.write_text("\n \n")
    with pytest.raises(SeedError, match="contains no URLs"):
        read_seeds(spark, str(blank))
    many = tmp_path / "d.txt"
    many.write_text("nope\n" * 1500)
    with pytest.raises(SeedError, match="line 1500 "):
        read_seeds(spark, str(many))
    (tmp_path / "e.txt").write_bytes(b"https://a.com\n\xff\n")
    with pytest.raises(SeedError, match="UTF-8"):
        read_seeds(spark, str(tmp_path / "e.txt"))
    with pytest.raises(SeedError, match="no such"):
        read_seeds(spark, str(tmp_path / "gone.txt"))
    with pytest.raises(SeedError, match=".txt"):
        read_seeds(spark, str(tmp_path / "c.md"))


def test_crawled_lead(spark):
    pages = spark.createDataFrame([(1, "https://shop.com.eg/", PAGE, None), (2, "https://www.shop.com.eg/contact", "<p>c@shop.com", None)], "page_id int, url string, html string, error string")
    lead = extract.crawled(pages, as_of="2026-01-01", default_country="EG").collect()
    assert len(lead) == 1
    row = lead[0].asDict()
    assert (row["name"], row["phone"], row["whatsapp"], row["email"], row["country"]) == ("shop.com.eg", "+201001234567", "+201001234567", "info@shop.com", "EG")
    assert row["social_url"] == "https://instagram.com/shop"
    assert row["notes"] == "other phones: +201000000002 | +201000000003; other emails: b@shop.com | c@shop.com; other socials: facebook: https://facebook.com/shop"


def test_captured_lead(spark):
    pages = spark.createDataFrame([("https://shop.com/", PAGE), ("about:blank", PAGE), ("https://empty.com/", None)], "url string, html string")
    leads = {r["hostname"]: r for r in extract.normalize_leads(extract.captured(pages, "2026-01-01T00:00:00Z")).collect()}
    assert set(leads) == {"shop.com", "empty.com"}
    found = leads["shop.com"]
    assert [p["normalized"] for p in found["phones"]] == ["+201000000002", "+201001234567"]
    assert found["phones"][1]["source"] == "tel-link"
    assert [p["normalized"] for p in found["whatsapp"]] == ["+201001234567", "+201000000002"]  # the second stands near a mention
    assert found["emails"] == ["Info@shop.com", "b@shop.com"]
    assert [s["platform"] for s in found["social_links"]] == ["whatsapp", "instagram", "facebook"]
    assert leads["empty.com"]["phones"] == []


def test_batch_is_as_good_as_one_by_one(spark, sf_dir):
    leads = catalog.leads(spark, sf_dir).where("seq < 20")
    changed = leads.withColumn("page_title", F.concat(F.lit("B"), "page_title")).withColumn("seq", F.col("seq") + 100)
    again = leads.withColumn("page_title", F.concat(F.lit("C"), "page_title")).withColumn("seq", F.col("seq") + 200)
    both = store.upsert(leads, changed.unionByName(again), "merge", "now")
    one = store.upsert(store.upsert(leads, changed, "merge", "now").drop("status"), again, "merge", "now")
    key = lambda df: sorted(map(str, df.drop("status").collect()))
    assert key(both) == key(one)
    assert set(r["page_title"][0] for r in both.collect()) == {"C"}


def test_views_and_exports(spark, sf_dir):
    leads = catalog.leads(spark, sf_dir)
    assert views.page(leads, 10, 1).count() == 10
    assert views.search(leads, "").count() == leads.count()
    assert store.delete(leads, "id1").count() == leads.count() - 1
    assert "- None" in export.text_blocks(leads.where("seq = 1"), "2026-01-01T00:00:00Z").first()["line"]


def test_crawl_and_resume(spark, tmp_path):
    def transport(url, config):
        if url.endswith("robots.txt"):
            return url, 200, "text/plain", b"User-agent: *\nDisallow: /" if "closed" in url else b""
        if "broken" in url:
            raise OSError("no route")
        return url, 200, "text/html; charset=utf-8", b"<a href='/contact'>Contact</a><p>info@%s" % url.split("/")[2].encode()

    targets = spark.createDataFrame([("a.com", "https://a.com/"), ("closed.com", "https://closed.com/"), ("broken.com", "https://broken.com/")], "host string, url string")
    rows = {(r["host"], r["page_no"]): r for r in crawl(targets, CrawlConfig(delay=0), transport).collect()}
    assert set(rows) == {("a.com", 0), ("a.com", 1), ("closed.com", 0), ("broken.com", 0)}
    assert "PermissionError" in rows["closed.com", 0]["error"] and "no route" in rows["broken.com", 0]["error"]
    seeds = tmp_path / "s.txt"
    seeds.write_text("https://a.com/\nhttps://broken.com/\n")
    out = str(tmp_path / "out")
    args = lambda *more: cli.parser().parse_args([str(seeds), "-o", out, "--delay", "0", "--date", "2026-01-01", *more])
    assert cli.run(spark, args(), transport=transport) == 0
    assert {r["name"]: r["email"] for r in cli.read_history(spark, out).collect()} == {"a.com": "info@a.com", "broken.com": ""}
    assert cli.run(spark, args("--retry-errors"), transport=lambda u, c: (u, 200, "text/html", b"now@broken.com")) == 0
    assert {r["name"]: r["email"] for r in cli.read_history(spark, out).collect()} == {"a.com": "info@a.com", "broken.com": "now@broken.com"}
    assert cli.run(spark, args(), transport=None) == 0  # nothing is asked
    assert cli.read_history(spark, out).count() == 2


def test_redirect_and_a_run_that_is_stopped(spark, tmp_path):
    """A lead is the seed's, wherever its site redirects to; rounds that are done are never asked again."""

    def transport(url, config):
        if url.endswith("robots.txt"):
            return url, 404, "", b""
        return ("https://other.org/home" if "moved" in url else url), 200, "text/html", b"<title>x</title><a href='https://moved2.com/contact'>Contact</a><p>i@x.org <a href='tel:+1 202 555 0143'>t</a>"

    seeds = tmp_path / "s.txt"
    seeds.write_text("https://moved1.com/a\nhttps://www.moved2.com/b\nhttps://c.com/\n")
    out = str(tmp_path / "out")
    args = cli.parser().parse_args([str(seeds), "-o", out, "--delay", "0", "--date", "2026-01-01", "--round", "1", "--concurrency", "2"])
    real = extract.crawled
    done = []

    def stops(pages, **options):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(1)
        return real(pages, **options)

    extract.crawled = stops
    try:
        with pytest.raises(KeyboardInterrupt):
            cli.run(spark, args, transport=transport)
    finally:
        extract.crawled = real
    saved = {r["name"]: r for r in cli.read_history(spark, out).collect()}
    assert {(n, r["website"], r["phone"], r["country"]) for n, r in saved.items()} == {("moved1.com", "https://moved1.com/a", "+12025550143", "US"), ("moved2.com", "https://www.moved2.com/b", "+12025550143", "US")}

    def rest(url, config):
        assert "moved" not in url, url
        return transport(url, config)

    assert cli.run(spark, args, transport=rest) == 0
    assert cli.read_history(spark, out).count() == 3


def test_stream(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "store")
    pages = lambda n, title: spark.createDataFrame([(n, f"https://s{n}.com/", f"<title>{title}</title><p>info@s{n}.com")], "page_id long, url string, html string")
    for number, frame in enumerate((pages(1, "a").unionByName(pages(2, "a")), pages(2, "b"))):
        frame.write.mode("append").parquet(source)
        incremental.capture_stream(incremental.pages_stream(spark, source), base, str(tmp_path / "check"), captured_at="2026-01-01T00:00:00Z").awaitTermination()
        found = incremental.current(spark, base, number + 1)
    assert sorted((r["hostname"], r["page_title"]) for r in found.collect()) == [("s1.com", "a"), ("s2.com", "b")]
