"""The page reader: trees of open and crossing tags, made by hand, and pages that are built to hurt."""

import time

import pytest

from contactloom.functions import html, phones
from contactloom.operators import extract
from pyspark.sql import functions as F


def sections(markup):
    page = html.read_page(markup, "https://a.com/")
    return [(e["tag"], page["buffer"][e["start"] : e["end"]]) for e in page["elements"]]


@pytest.mark.parametrize(
    "markup, expected",
    [
        ("<p class=contact>Call 1<p>Order 2", [("p", "Call 1")]),
        ("<p class=contact>a<div>b</div>c", [("p", "a")]),
        ("<p class=contact>a<span>b<i>c</span>d</p>e", [("p", "abc d")]),
        ("<p class=contact>a<button>b<p id=phone>c</p>d</button>e</p>f", [("p", "a b\nc\nd e"), ("button", "b\nc\nd"), ("p", "c")]),
        ("<ul><li class=phone>1<ul><li class=contact>2<li>3</ul>4<li class=phone>5</ul>6", [("li", "1\n2\n3\n4"), ("li", "2"), ("li", "5")]),
        ("<li class=phone>1<div>2<li class=phone>3", [("li", "1\n2"), ("li", "3")]),
        ("<dl><dt class=phone>1<dd class=phone>2<dt>3</dl>4", [("dt", "1"), ("dd", "2")]),
        ("<table class=contact><tr><td class=phone>1<td class=email>2<tr><td>3</table>4", [("table", "1 2\n3"), ("td", "1"), ("td", "2")]),
        ("<table><td class=phone>1</div></p></table>2", [("td", "1")]),
        ("<div class=contact><table><tr><td class=phone>1</div>2</table>3</div>4", [("div", "1\n2\n3"), ("td", "1\n2")]),
        ("<b class=contact>1<p class=phone>2</b>3</p>4", [("b", "1\n2"), ("p", "2 3")]),
        ("<a href=x>1<a href=y>2</a>3", [("a", "1"), ("a", "2")]),
        ("<h1 class=contact>1<h2 class=phone>2</h1>3", [("h1", "1"), ("h2", "2")]), ("<h2 class=phone>2</h1>3", [("h2", "2")]),
        ("<select><option class=phone>1<option class=email>2</select>3", [("option", "1"), ("option", "2")]),
        ("<footer>1</section></p></b>2</footer>3", [("footer", "1\n2")]),
        ("<div class=contact/>1<br/>2</div>3", [("div", "1\n2")]),
        ("<svg class=contact><path class=phone /><g id=email>1</svg>2", [("svg", "1"), ("path", ""), ("g", "1")]),
        ("<footer>a<script>no</script><style>no</style><!-- no -->b</body></html>c", [("footer", "a b\nc")]),
        ("<address> \n one \t two </address>", [("address", "one two")]),
        ("<footer></footer><footer> </footer>x", [("footer", ""), ("footer", "")]),
    ],
)
def test_trees(markup, expected):
    assert sections(markup) == expected


HOSTILE = {
    "open paragraphs, stray ends": "<p>" * 20_000 + "</b>" * 20_000,
    "open list items": "".join(f'<li class="phone">item {k} of a list' for k in range(3000)),
    "nested sections": ('<div class="contact">' + "word " * 68) * 900,
    "open formatting": "<b>" * 20_000 + "<p>x</b>" * 20_000,
    "ends that reach nothing": "<div>" * 20_000 + "</span>" * 20_000,
    "open tables": "<table><tr><td>" * 8000 + "</td>" * 8000,
    "open links": "<p><a href=/x>t" * 8_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages(name):
    page = HOSTILE[name]
    began = time.process_time()
    found = html.read_page(page, "https://a.com/")
    assert time.process_time() - began < 2.5  # well under 1 s on an idle machine
    size = len(found["text"]) + len(found["lines"]) + len(found["buffer"]) + sum(sum(len(k) + len(v) for k, v in e["attributes"]) + len(e["url"] or "") for e in found["elements"])
    assert size < 10 * len(page)


def test_order_number_of_the_next_paragraph(spark):
    pages = [("https://a.com/", "<title>A</title><p class=contact>Call us 010 1234 5678<p>Order number 87654321"), ("https://b.com/", HOSTILE["nested sections"] + "<p>tel 010 1234 5678"), ("https://c.com/", None)]
    df = spark.createDataFrame(pages, "url string, html string")
    found = {r["hostname"]: [(p["raw"], p["context"]) for p in r["phones"]] for r in extract.captured(df, "2026-01-01T00:00:00Z").collect()}
    assert found == {"a.com": [("010 1234 5678", "Call us")], "b.com": [("010 1234 5678", "tel")], "c.com": []}


#: The words of ids and pages, with what may stand before and behind them.
CUES = [
    ("page #5", True), ("Page #", False), ("page # 5", False), ("page#5", True), ("page ##5", False), ("profile #x", True), ("homepage #5", False), ("page id", True), ("page ids", False), ("page number 5", True), ("facebook #_", True), ("fb #٣", False), ("page 5", False),
    ("order", True), ("order #", True), ("order #5", True), ("order#", True), ("orders", False), ("order5", False), ("reorder", False), ("order id", True), ("orderid", True), ("order no", True), ("order nope", True), ("ordernope", False), ("user_", False),
    ("views", True), ("view count", True), ("viewcounts", False), ("review", False), ("followers number", True), ("follower", True),
    ("timestamp", True), ("unix  epoch", True), ("postal", True), ("post", False), ("post code", True), ("postcode", True), ("zip", True), ("zipper", False), ("zip codes", True), ("call me", False),
]


def test_cues_that_speak_of_no_phone(spark):
    rows = spark.createDataFrame(CUES, "text string, wanted boolean").withColumn("found", phones.non_phone_cue(F.col("text"))).collect()
    assert [(r["text"], r["found"]) for r in rows] == [(r["text"], r["wanted"]) for r in rows]
