"""Hosts asked in turn, the data source, and the table of robots rules."""

import time
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from contactloom.sources import page_source, robots
from contactloom.sources.web import CrawlConfig, crawl, visits
from stub_sites import slow_sites

CONFIG = CrawlConfig(partitions=2, delay=0.05)


def test_a_slow_host_holds_nobody_else():
    order = []
    began = time.monotonic()
    hosts = [("slow1.com", "https://slow1.com/", [])] + [(f"s{k}.com", f"https://s{k}.com/", []) for k in range(40)]
    for rows in visits(iter(hosts), CrawlConfig(delay=0.1), slow_sites):
        order.append(rows[0][0])
        assert [r[2] for r in rows] == list(range(len(rows)))
    assert order[-1] == "slow1.com" and len(order) == 41
    # one after another they would take 40 * 3 * 0.1 s
    assert time.monotonic() - began < 8


def test_delay_is_kept_for_each_host():
    times = []

    def transport(url, config):
        times.append((url.split("/")[2], time.monotonic()))
        return slow_sites(url, config)

    list(visits(iter([(f"s{k}.com", f"https://s{k}.com/", []) for k in range(5)]), CrawlConfig(delay=0.2), transport))
    for k in range(5):
        own = [t for h, t in times if h == f"s{k}.com"]
        assert len(own) == 3 and all(b - a >= 0.19 for a, b in zip(own, own[1:]))


def test_data_source_gives_the_rows_of_crawl(spark, tmp_path):
    targets = spark.createDataFrame([(f"s{k}.com", f"https://s{k}.com/") for k in range(12)] + [("slow1.com", "https://slow1.com/"), ("broken.com", "https://broken.com/")], "host string, url string")
    rules = spark.createDataFrame([("https://s3.com", [("/", False)])], f"origin string, rules {robots.RULES.simpleString()}")
    expected = sorted(map(str, crawl(targets, CONFIG, slow_sites, rules).collect()))
    folder = str(tmp_path / "plan")
    with_rules = targets.withColumn("origin", robots.origin_of(F.col("url"))).join(rules, "origin", "left")
    page_source.plan(with_rules, folder, groups=3)
    spark.dataSource.register(page_source.PageSource)
    read = spark.read.format("contact_pages").option("targets", folder).option("transport", "stub_sites:slow_sites").option("delay", "0.05").load()
    assert sorted(map(str, read.collect())) == expected
    found = {(r["host"], r["page_no"]): r for r in read.collect()}
    assert "PermissionError" in found["s3.com", 0]["error"] and "no route" in found["broken.com", 0]["error"]
    # the page that robots rules close is left out, the other one is there
    assert ("s1.com", 1) in found and ("s1.com", 2) not in found
    assert read.rdd.getNumPartitions() <= 3
    empty = str(tmp_path / "empty")
    page_source.plan(targets.limit(0), empty)
    assert spark.read.format("contact_pages").option("targets", empty).load().count() == 0
    with pytest.raises(Exception, match="targets"):
        spark.read.format("contact_pages").load().count()


ROBOTS = [
    "",
    "User-agent: *\nDisallow: /private\nAllow: /\n",
    "User-agent: contactloom\nAllow: /private/open\nDisallow: /private\n\nUser-agent: *\nDisallow: /",
    "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow:\n",
    "User-agent: *\nDisallow: *\n",
    "User-agent: a\nUser-agent: *\nDisallow: /a%20b\nDisallow: /é\nDisallow: /q?x=1",
    "# nothing\nDisallow: /\n",
]
PATHS = ["/", "", "/private", "/private/open/x", "/privately", "/a b/c", "/a%20b", "/%C3%A9t", "/é", "/q?x=12", "/q", "/x#private"]


@pytest.mark.parametrize("text", ROBOTS)
def test_rules_decide_as_the_standard_parser(spark, text):
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    rules = robots.parsed(text, "contactloom/1.0")
    urls = [f"https://a.com{p}" for p in PATHS]
    assert [robots.allowed(rules, u) for u in urls] == [parser.can_fetch("contactloom/1.0", u) for u in urls]
    table = spark.createDataFrame([(u, robots.path_of(u), rules) for u in urls], f"url string, path string, rules {robots.RULES.simpleString()}")
    found = {r["url"]: r["x"] for r in table.withColumn("x", robots.allows(F.col("rules"), F.col("path"))).collect()}
    assert found == {u: parser.can_fetch("contactloom/1.0", u) for u in urls}


def test_each_origin_is_asked_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def transport(url, config):
        (log / f"{time.time_ns()}-{url.replace('/', '_')}").touch()
        return slow_sites(url, config)

    urls = spark.createDataFrame([(f"https://s{k % 4}.com/p{k}",) for k in range(40)] + [("nothing",), (None,)], "url string")
    table = robots.RobotsTable(spark, str(tmp_path / "robots"))
    first = table.refresh(urls, CONFIG, transport)
    assert sorted(r["origin"] for r in first.collect()) == [f"https://s{k}.com" for k in range(4)]
    assert first.first()["rules"][0]["path"] == "/private" and first.first()["status"] == 200
    table.refresh(urls.unionByName(spark.createDataFrame([("https://S9.com/",)], "url string")), CONFIG, transport)
    assert len(list(log.iterdir())) == 5
    # a table that is too old is asked again, and the latest row counts
    assert table.refresh(urls, CONFIG, transport, max_age_seconds=-1).count() == 0
    assert len(list(log.iterdir())) == 9 and table.read().count() == 5
    pages = crawl(spark.createDataFrame([(f"s{k}.com", f"https://s{k}.com/") for k in range(4)], "host string, url string"), CONFIG, transport, table.read())
    assert pages.count() == 8
    assert not [x for x in list(log.iterdir())[9:] if x.name.endswith("robots.txt")][9:]


def test_unreachable_robots_allow_everything(spark, tmp_path):
    def transport(url, config):
        if url.endswith("robots.txt"):
            raise OSError("down")
        return slow_sites(url, config)

    table = robots.RobotsTable(spark, str(tmp_path / "robots"))
    row = table.refresh(spark.createDataFrame([("https://a.com/",)], "url string"), CONFIG, transport).first()
    assert row["status"] is None and row["rules"] == [] and robots.allowed([], "https://a.com/x")
