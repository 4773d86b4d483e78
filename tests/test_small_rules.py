"""Rules that only a user calls, and whole pages read by another way."""

import html as entities
import re

from pyspark.sql import functions as F

from contactloom.functions import html, urls
from contactloom.operators import extract
from contactloom.plans import catalog


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_lists_of_urls(spark):
    values = F.array(*(F.lit(x) for x in ("https://A.com/x/?utm_source=1", "https://a.com/x", "mailto:a@b.c", "", "https://a.com/y#z")), F.lit(None).cast("string"))
    assert one(spark, urls.normalized_urls(values)) == ["https://a.com/x", "https://a.com/y"]


def test_current_page(spark):
    page = F.lit("https://a.com/x?b=1&a=2")
    for url, same in (("https://a.com/x/?a=2&b=1#top", True), ("https://a.com/x", False), ("https://a.com/x?a=2&b=1&utm_medium=m", True), ("nothing", False), ("", False)):
        assert one(spark, urls.is_current_page(F.lit(url), page)) is same


def test_resolved_links(spark):
    rows = [("https://a.com/b/c", "../d", "https://a.com/d"), ("https://a.com/b", "?q", "https://a.com/b?q"), ("https://a.com/", "HTTP://B.com/./x", "http://b.com/x"), ("https://a.com/", None, None), (None, "x", "x"), ("https://a.com/", "tel:1", "tel:1"), ("https://a.com/", "http://[x", None)]
    found = spark.createDataFrame(rows, "base string, href string, wanted string").withColumn("found", urls.resolved("base", "href")).collect()
    assert [r["found"] for r in found] == [w for _, _, w in rows]


def test_short_errors(spark):
    assert one(spark, extract.short_error(F.lit("OSError"), F.lit(" no \n\t route "))) == "OSError: no route"
    assert len(one(spark, extract.short_error(F.lit("E"), F.lit("x" * 500)))) == 300


def test_numbers_typed_in(spark, sf_dir):
    leads = catalog.leads(spark, sf_dir).where("seq IN (1, 2)")
    url = leads.where("seq = 2").first()["source_url"]
    sizes = lambda typed: {r["seq"]: len(r["phones"]) for r in extract.with_manual_number(leads, url, typed).collect()}
    assert sizes("+20 100 999 8888") == {1: 1, 2: 3}
    new = next(r for r in extract.with_manual_number(leads, url, "0100 999 8888").collect() if r["seq"] == 2)["phones"][-1]
    assert (new["raw"], new["normalized"]) == ("0100 999 8888", "+201009998888")
    # what it has already, none, and two numbers
    assert sizes("0020 10 0000 0002") == sizes("no number") == sizes("0100 999 8888 / 0100 999 7777") == {1: 1, 2: 2}


def plain_lines(page):
    """By patterns: enough for pages without hidden parts inside each other."""
    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>", "", page)
    page = re.sub(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>", "\n", page)
    shown = entities.unescape(re.sub(r"(?s)<[a-zA-Z/][^>]*>", "\n", page))
    return [x for x in (" ".join(y.split()) for y in shown.split("\n")) if x]


def test_texts_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = pages.withColumn("page", html.parsed("html", "url")).select("html", "page.lines", "page.text", "page.title", "page.buffer").collect()
    assert len(found) == pages.count()
    for r in found:
        lines = plain_lines(r["html"])
        assert r["lines"].split("\n") == lines and r["text"] == " ".join(lines)
        assert r["buffer"].split() == r["text"].split()
        assert r["title"] == " ".join(entities.unescape(re.search(r"(?is)<title>(.*?)</title>", r["html"])[1]).split())
