"""Rules that are easily got nearly right, in tables of examples; numbers of documents against a plain loop."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from contactloom.functions import emails, html, links, phones, urls
from contactloom.operators import export, extract, store
from contactloom.plans import catalog


def values(spark, cases, rule):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string")
    return [r["v"] for r in df.select("k", rule(F.col("x")).alias("v")).orderBy("k").collect()]


def test_cues(spark):
    judge = lambda contexts: values(spark, contexts, lambda x: phones.is_likely_phone(F.lit("123456789"), x, F.lit(False)))
    assert judge(["Phone", "Whats App", "whats--app", "واتساب", "واتس اب", "واتس   اب", "mob", "call"]) == [True] * 8
    # a cue against it counts, whatever else stands there
    assert judge(["Phone / Order no", "Call, page id", "هاتف رقمالطلب", "هاتف رقم   الطلب", "tel views", "phone zip  code"]) == [False] * 6
    assert judge(["page", "ordering", "telephony", ""]) == [False] * 4
    assert judge(["my page, call", "ordering by phone"]) == [True] * 2


def test_candidates_begin_with_a_digit_or_plus(spark):
    found = values(spark, ["x ( 02) 2345 6789 y", "a - +20 100 123 4567.", "00 20 100 123 4567"], lambda x: F.regexp_extract_all(x, F.lit(phones.CANDIDATE), F.lit(0)))
    assert found == [["02) 2345 6789"], ["+20 100 123 4567"], ["00 20 100 123 4567"]]
    assert values(spark, ["(02) 2345-6789)", "tel:%2B20100;x", "+20\u200e100\u00a0 5 x", None], phones.cleaned_phone) == ["02) 2345-6789)", "+20100", "+20100 5", ""]
    assert values(spark, [". a, b –", "x" * 200], phones.cleaned_context) == [". a, b", "x" * 179 + "…"]


def test_context_holds_neighbours(spark):
    line = "A 01000000001 or 01000000002 or 01000000003, ask " + "z" * 120
    found = values(spark, [line + "\nnext 01000000004"], lambda x: F.transform(phones.candidates_in(x, "visible-text"), lambda c: c["context"]))[0]
    assert found[1].startswith("A 01000000001 or or 01000000003, ask zzz") and found[3] == "next"


def test_likely_numbers_of_documents(spark, sf_dir):
    """Every document, by a loop that knows nothing of the expressions."""
    digits = lambda x: re.sub(r"[^0-9]", "", x)

    def day(y, m, d):
        try:
            return 1900 <= y <= 2100 and bool(datetime.date(y, m, d))
        except ValueError:
            return False

    def dated(v):
        g = [int(x) for x in re.findall(r"[0-9]+", v)]
        if any(day(a, b, c) or day(c, b, a) or day(c, a, b) for a, b, c in zip(g, g[1:], g[2:])):
            return True
        d = re.sub("^00", "", digits(v))
        eight = len(d) == 8 and (day(int(d[:4]), int(d[4:6]), int(d[6:])) or day(int(d[4:]), int(d[2:4]), int(d[:2])) or day(int(d[4:]), int(d[:2]), int(d[2:4])))
        return eight or bool(re.fullmatch(r"(?:19|20)[0-9]{2}[ \t.-]+(?:19|20)[0-9]{2}", v.strip()))

    def likely(v, context):
        d = re.sub("^00", "", digits(v))
        if not 8 <= len(d) <= 15 or len(set(d)) == 1 or dated(v):
            return False
        if re.search(r"[$€£¥]|(?<!\w)(?:aed|egp|eur|gbp|price|sar|usd)(?!\w)", context, re.I | re.A):
            return False
        if re.search(r"\b(?:(?:account|customer|invoice|item|order|product|reference|ref|sku|tracking|user)\s*(?:id|no|number|#)?|(?:facebook|fb|page|profile)\s*(?:id|number|#)|(?:views?|watch(?:es)?|followers?)\s*(?:count|number)?|(?:unix\s*)?(?:timestamp|epoch)|postal|post\s*code|zip)\b", context, re.I | re.A):
            return False
        if re.fullmatch(r"01[0125]\d{8}|201[0125]\d{8}|0[2-9]\d{7,8}|20[2-9]\d{7,8}", d) or v.startswith(("+", "00")):
            return True
        return bool(re.search(r"\b(?:call|contact|mobile|mob|phone|tel|telephone|whats[\s-]*app|wa)\b", context, re.I | re.A) or re.search("[ ()-]", v))

    extra = [(9000, "Ref 4111-1111-1111\nphone 12345678 and 2345 6789, 2024-01-05 10\n(02) 2345-6789 at 12:00\r0020 100 123 4567"), (9001, None), (9002, "")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = docs.withColumn("raws", F.transform(phones.candidates_in(F.col("text"), "visible-text"), lambda c: c["raw"])).collect()
    total = 0
    for r in rows:
        text, want = r["text"] or "", []
        for m in re.finditer(r"(?:\+|00)?[0-9](?:[ \t\xa0().-]*[0-9]){6,18}", text, re.A):
            before = re.split(r"[\n\r]", text[: m.start()])[-1][-90:]
            after = re.split(r"[\n\r]", text[m.end() :])[0][:90]
            v = re.sub(r"[ \t\xa0]+", " ", m[0])
            if likely(v, " ".join(f"{before} {after}".split())):
                want.append(v)
        assert r["raws"] == want, (r["doc_id"], r["raws"], want)
        total += len(want)
    assert total >= 5


@pytest.mark.parametrize(
    "written, region, number",
    [
        ("tel:+1 202 555 0143", "EG", ("+12025550143", "US")), ("+1 416 555 0143", "EG", ("+14165550143", "CA")), ("+7 495 123 45 67", "", ("+74951234567", "RU")), ("+7 701 123 4567", "EG", ("+77011234567", "KZ")),
        ("+380 44 123 4567", "EG", ("+380441234567", "UA")), ("+999 1234 5678", "EG", None), ("01001234567", "EG", ("+201001234567", "EG")), ("201001234567", "EG", ("+201001234567", "EG")),
        ("00966 50 123 4567", "EG", ("+966501234567", "SA")), ("966501234567", "EG", None), ("0501234567", "SA", ("+966501234567", "SA")), ("01001234567", "", None), ("+20 999", "EG", None), ("+0 123456789", "EG", None), ("202 555 0143", "US", ("+12025550143", "US")), (None, "EG", None),
    ],
)
def test_numbers_of_all_countries(spark, written, region, number):
    found = values(spark, [written], lambda x: phones.valid_number(x, region))[0]
    assert (found and tuple(found)) == number


def test_running_text(spark):
    text = "a+12025550143b +12025550143, EUR 0223456789, €0223456789 x 0223456789% id0223456789 (02) 2345 6789. 2024-01-05 01001234568 02 2345 6780 +966 50 123 4567, 2019 - 2020, ٠١٠٠١٢٣٤٥٦٧"
    pages = spark.createDataFrame([(1, "https://x.com/", f"<p>{text}</p><p>or 010 <b>0123</b> 4569</p><p>+4420794609{58}</p>")], "page_id int, url string, html string")
    lead = extract.crawled(pages, as_of="x").first()
    found = [lead["phone"], *lead["notes"].removeprefix("other phones: ").split(" | ")]
    assert found == ["+12025550143", "+20223456789", "+201001234568", "+966501234567", "+201001234567", "+201001234569", "+442079460958"]


def test_addresses(spark):
    found = lambda x: values(spark, [x], lambda t: emails.captured_emails(F.array(t)))[0]
    assert found("a [at] b.co (dot) uk; c(at)d dot org; me at home dot net! bat at") == ["a@b.co.uk", "c@d.org", "me@home.net"]
    assert found("A@X.com a@x.COM <b@y.de>, x..y@z.org .c@d.org e@f.xn--p1ai") == ["A@x.com", "b@y.de", "e@f.xn"]
    assert found("x" * 200_000 + " a@b.org " + "y@" * 1000) == ["a@b.org"]
    crawl = values(spark, ["Mail Über@Größe.de. or A.B@c.org;"], lambda t: emails.crawled_emails(t, F.array(F.lit("mailto:not-an-address"), F.lit("mailto:a@b.com,c@d.com?x=e@f.org"), F.lit("MAILTO:no@no.org"))))[0]
    assert crawl == ["a@b.com", "c@d.com", "über@größe.de", "a.b@c.org"]
    assert values(spark, ["a b@C.de", "a@b", "@b.de"], emails.normalized_email) == ["a b@c.de", "", ""]


def test_link_rules(spark):
    page = "https://shop.com/a"
    out = lambda xs: values(spark, xs, lambda u: links.is_excluded(u, F.lit(page)))
    assert out(["https://facebook.com/l.php/?u=x", "https://x.org/out/?URL=1", "https://x.org/out/?url=1", "https://chat.whatsapp.com/abc", "https://wa.me/", "https://wa.me/qr/AB", "https://api.whatsapp.com/send/?text=x", "https://facebook.com/sharer/sharer.php?u=1", "https://shop.com/a/?utm_source=x#y", "https://wa.me/201001234567"]) == [True, False, True, False, True, True, True, True, True, False]
    assert values(spark, ["https://x.com//", "https://x.com/a/?q=b/", "https://x.com/?q=b/", "https://x.com"], urls.normalized_url) == ["https://x.com", "https://x.com/a?q=b", "https://x.com?q=b/", "https://x.com"]
    assert values(spark, ["https://www.facebook.com/pages/profile.php?id=a b&x=1", "https://facebook.com/DIALOG/x"], links.clean_social_url) == ["https://www.facebook.com/pages/profile.php?id=a+b", None]
    assert [urls.canonical("https://X.com/a/b/", x) for x in ("../c/./d?x=/../y", "https://MÜNCHEN.de/..", "//[bad", "mailto:a@b.c", "?q")] == ["https://x.com/a/c/d?x=/../y", "https://xn--mnchen-3ya.de/", None, "mailto:a@b.c", "https://x.com/a/b/?q"]
    line = lambda t, u: spark.range(1).select(links.external_line(F.struct(F.lit(t).alias("text"), F.lit(u).alias("url")))).first()[0]
    assert [line("https://a", "https://a"), line("A", "https://a"), line("", "https://a")] == ["https://a", "A: https://a", "https://a"]


def test_whatsapp_page(spark):
    page = """<a href="https://wa.me/201001234567" class="share">s</a><a href="https://chat.whatsapp.com/XYZ">Group</a><a href="https://wa.me/201001234568"><b></b></a>
<div data-settings='{"phone": ["20 100 000 0001", {"n": 1}], "x": "https:\\/\\/wa.me\\/201000000002", "whatsapp": true}'>d</div>
<button data-phone="01000000009">no role</button><i role="button" data-phone="01000000003" title="Ring">r</i><span id="joinchat" data-config="telephone: '+20 100 000 0004', other 123">c</span>
<p>WhatsApp us: order 90012345678</p><p>WhatsApp 010 0000 0005</p>"""
    rows = spark.createDataFrame([("https://shop.com/", page)], "url string, html string")
    lead = extract.captured(rows, "2026-01-01T00:00:00Z").first()
    found = {phones_key(p["raw"]): p for p in lead["whatsapp"]}
    assert set(found) == {"201001234568", "01000000005", "201000000002", "01000000003", "201000000004", "201000000001"}
    assert found["201001234568"]["context"] == "WhatsApp contact link" and found["01000000003"]["context"] == "r Ring"
    assert found["01000000005"]["source"] == "visible-text"
    judged = extract.parse_pages(rows).select(links.whatsapp_links(links.judged(extract.anchors(F.col("page")), F.col("url"))).alias("l")).first()["l"]
    assert judged == ["https://chat.whatsapp.com/XYZ", "https://wa.me/201001234568"]
    assert html.settings_of("[1, {\"a\": [2.50, null]}]") == [{"key": "", "value": "1"}, {"key": "a", "value": "2.50"}] and html.settings_of("{") is None


def phones_key(x):
    return re.sub("^00", "", re.sub("[^0-9]", "", x))


def test_social_url_of_crawled_lead(spark):
    pages = spark.createDataFrame([(1, "https://shop.com/", "<a href='https://facebook.com/shop'>f</a><a href='https://wa.me/01001234567'>w</a>")], "page_id int, url string, html string")
    lead = extract.crawled(pages, as_of="2026-01-01").first()
    assert (lead["company_name"], lead["social_url"], lead["phone"], lead["country"], lead["notes"]) == ("shop.com", "", "+201001234567", "EG", "other socials: facebook: https://facebook.com/shop")
    assert extract.crawled(pages.withColumn("html", F.lit("")), as_of="x", default_country="ae").first()["country"] == "AE"


def test_documents_are_written_in_order(spark, sf_dir, tmp_path):
    leads = catalog.leads(spark, sf_dir).where("seq < 12").withColumn("seq", F.col("seq") * (1 << 33) + 5).withColumn("page_title", F.when(F.col("seq") > (1 << 33), F.col("page_title")).otherwise('a "b"\n\\\u0001é')).repartition(3)
    read = lambda p: "".join(x.read_text(newline="") for x in sorted((tmp_path / p).glob("part-*")))
    for kind in export.KINDS:
        assert export.exported(leads, kind, str(tmp_path / kind), "2026-01-01T00:00:00.123Z", clear=kind == "csv").count() == (0 if kind == "csv" else 12)
    document = read("json")
    told = json.loads(document)
    assert document == json.dumps(told, indent=2, ensure_ascii=False) + "\n" and (told["exportedAt"], told["totalLeads"], len(told["leads"])) == ("2026-01-01T00:00:00Z", 12, 12)
    assert list(told["leads"][0])[:5] == ["id", "pageTitle", "sourceUrl", "hostname", "capturedAt"] and told["leads"][0]["pageTitle"] == 'a "b"\n\\\x01é'
    text = read("txt")
    assert text.startswith("\ufeffLEAD COLLECTION\nExported At: 2026-01-01T00:00:00Z\nTotal Leads: 12\n\n" + "=" * 50 + "\nLEAD 1\n") and text.endswith("END LEAD\n" + "=" * 50 + "\n")
    assert re.findall(r"\nLEAD (\d+)\n", text) == [str(k) for k in range(1, 13)]
    table = read("csv")
    assert table.startswith("\ufeffname,company_name,") and table.endswith("\r\n") and table.count("\r\n") == 13
    with pytest.raises(export.NothingToExport):
        export.exported(leads.limit(0), "txt", str(tmp_path / "none"), "2026-01-01T00:00:00Z")
    assert not (tmp_path / "none").exists()
    empty = export.json_document(leads.limit(0), "2026-01-01T00:00:00Z").orderBy("seq").collect()
    assert json.loads("\n".join(r["line"] for r in empty)) == {"exportedAt": "2026-01-01T00:00:00Z", "totalLeads": 0, "leads": []}
    name = spark.range(1).select(export.file_name("csv", F.lit("2026-01-02 03:04:05").cast("timestamp")), export.file_name("txt", F.lit("2026-01-02 03:04:05").cast("timestamp"), "shop")).first()
    assert tuple(name) == ("leads-2026-01-02-0304.csv", "shop-2026-01-02-0304.txt")


def test_captured_flags_and_numbering(spark, sf_dir):
    leads = catalog.leads(spark, sf_dir)
    one = leads.first()["source_url"]
    pages = spark.createDataFrame([(one,), (one,), ("",), (None,), ("https://nowhere/",)], "url string")
    assert [r["captured"] for r in store.captured_flags(pages, leads).collect()].count(True) == 2
    jumps = spark.createDataFrame([(k * 700_001,) for k in range(50)], "seq long").repartition(7)
    assert sorted(tuple(r) for r in store.numbered(jumps).collect()) == [(k * 700_001, k + 1) for k in range(50)]
    assert [store_oldest(spark, a, b) for a, b in (("bad", "2025-01-01T00:00:00Z"), ("2025-01-02T00:00:00Z", "2025-01-01T00:00:00Z"), ("", "x"), ("2025-01-01T00:00:00Z", "bad"))] == ["bad", "2025-01-01T00:00:00Z", "x", "2025-01-01T00:00:00Z"]


def store_oldest(spark, a, b):
    return spark.range(1).select(store.oldest(F.lit(a), F.lit(b))).first()[0]
