"""JSON documents: every text is escaped, and in one place of the expression."""

import json
import re

from pyspark.sql import functions as F

from contactloom.operators import export

TEXTS = ["plain", "", 'a "quote" and a \\ backslash', "tab\tand\nlines\r\x01\x1f", "del\x7f", "سعر é   \U0001f600", "[{,:}]", None, "null"]
NUMBER = "array<struct<raw:string,normalized:string,context:string,source:string>>"
SCHEMA = f"seq long, id string, page_title string, source_url string, hostname string, captured_at string, last_updated_at string, phones {NUMBER}, whatsapp {NUMBER}, emails array<string>, social_links array<struct<platform:string,url:string>>, external_links array<struct<url:string,text:string,type:string>>"


def _leads(spark):
    rows = [(k, t, t, t, t, t, t, [(t, t, t, t)], None if k % 2 else [], [t, t], [(t, t)], [(t, t, t)] * k) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def test_texts_are_read_back(spark):
    lines = _leads(spark).select("seq", export.json_lead().alias("line")).collect()
    for k, line in lines:
        t, found = TEXTS[k], json.loads(line)
        number = {n: t for n in ("raw", "normalized", "context", "source") if t is not None or n in ("raw", "normalized")}
        wanted = {"id": t, "pageTitle": t, "sourceUrl": t, "hostname": t, "capturedAt": t, "phones": [number], "whatsapp": [], "emails": [t, t], "socialLinks": [{"platform": t, "url": t}], "externalLinks": [{"url": t, "text": t, "type": t}] * k, "lastUpdatedAt": t}
        assert found == {n: v for n, v in wanted.items() if n != "lastUpdatedAt" or t is not None}


def test_bytes_are_those_of_a_json_writer(spark):
    shown = F.to_json(F.array("id"))
    assert _leads(spark).where("id IS NOT NULL").where(F.concat(F.lit("["), export._json_quoted(F.col("id")), F.lit("]")) != shown).count() == 0


def test_no_text_or_list_is_written_twice(spark):
    plan = _leads(spark).select(export.json_lead().alias("line"))._jdf.queryExecution().analyzed().toString()
    # six texts, twice four of a number, an address, two of a profile, three of a link
    assert len(re.findall(r"to_json\(", plan)) == 20
    assert len(re.findall(r"transform\((?:phones|whatsapp|emails|social_links|external_links)#", plan)) == 5
