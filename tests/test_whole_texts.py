"""Contact sections longer than any fixed number of characters."""

from contactloom.functions import html
from contactloom.operators import extract

FILLER = "<p>plain words only</p>" * 400
SPLIT = "<p>Phone: 010 <b>1234</b> <i>5678</i></p>"


def test_number_behind_a_long_section(spark):
    inside = FILLER + SPLIT + FILLER
    pages = [("https://a.com/", f"<html><body class='contact-page'>{inside}</body>"), ("https://b.com/", f"<div><footer><div>{inside}</div></footer></div>")]
    # a number across the old mark of 4,000 characters, which would end there as another number
    pages += [("https://c.com/", "<footer>" + "x" * 3987 + " +20 100 <b>123</b> 4567</footer>")]
    df = spark.createDataFrame(pages, "url string, html string")
    found = {r["hostname"]: {p["normalized"] for p in r["phones"]} for r in extract.normalize_leads(extract.captured(df, "2026-01-01T00:00:00Z")).collect()}
    assert found == {"a.com": {"+201012345678"}, "b.com": {"+201012345678"}, "c.com": {"+201001234567"}}


def test_texts_of_nested_elements():
    page = html.read_page("<div id=contact>a<a href=x>b<b>c</b></a>d<script>no</script><footer>e", "https://a.com/")
    assert [" ".join(page["buffer"][e["start"] : e["end"]].split()) for e in page["elements"]] == ["abc d e", "bc", "e"]
