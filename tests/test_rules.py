"""The rules of phones, addresses and links, in tables of examples."""

import pytest
from pyspark.sql import functions as F

from contactloom.functions import emails, folds, links, phones, urls
from contactloom.operators import export


def values(spark, cases, rule):
    """The rule's value of each case, in order."""
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string")
    return [r["v"] for r in df.select("k", rule(F.col("x")).alias("v")).orderBy("k").collect()]


def test_likely_phones(spark):
    good = ["+20 100 123 4567", "0020 100 123 4567", "01001234567", "(02) 2345-6789", "٠١٠٠١٢٣٤٥٦٧", "+966 55 123 4567"]
    bad = ["2026-01-05", "05/01/2026 12", "20260105", "2024-2025", "11111111", "1234567", "123456789012345678", "123456789"]
    rule = lambda x: phones.is_likely_phone(x, F.lit(""), F.lit(False))
    assert values(spark, good, rule) == [True] * len(good)
    assert values(spark, bad, rule) == [False] * len(bad)


def test_context_decides(spark):
    judge = lambda context, explicit=False: values(spark, ["123456789"], lambda x: phones.is_likely_phone(x, F.lit(context), F.lit(explicit)))[0]
    assert judge("Phone") and judge("هاتف") and judge("", True)
    assert not judge("Order ID") and not judge("Price 5 EGP", True) and not judge("رقم الطلب")


def test_numbers_in_text(spark):
    text = "Call: 010 1234 5678\nOrder ID 9012345678\nPrice 2345 6789 EGP\nDate 2026-01-05\nواتساب ٠١١٢٣٤٥٦٧٨٩\n"
    found = values(spark, [text], lambda x: F.transform(phones.candidates_in(x, "visible-text"), lambda c: phones.normalized_number(c["raw"])))[0]
    assert found == ["+201012345678", "+201123456789"]


@pytest.mark.parametrize("written, normalized", [("01012345678", "+201012345678"), ("+20 10 1234 5678", "+201012345678"), ("0020-10-12345678", "+201012345678"), ("tel:01012345678;ext=1", "+201012345678"), ("020 7946 0958", "02079460958"), ("03 1234567", "+2031234567"), ("", ""), (None, "")])
def test_normalized(spark, written, normalized):
    assert values(spark, [written], phones.normalized_number) == [normalized]


def test_weaker_source_with_context_replaces_stronger_without(spark):
    one = lambda c, s: F.struct(F.lit("01012345678").alias("raw"), F.lit(c).alias("context"), F.lit(s).alias("source"))
    found = spark.range(1).select(phones.distinct_candidates(F.array(one("", "tel-link"), one("c", "visible-text"), one("d", "anchor-text"))).alias("v")).first()["v"]
    assert [(x["context"], x["source"]) for x in found] == [("d", "anchor-text")]


def test_store_fold_fills_what_is_missing(spark):
    one = lambda c, s: F.struct(F.lit("1").alias("raw"), F.lit("+1").alias("normalized"), F.lit(c).alias("context"), F.lit(s).alias("source"))
    found = spark.range(1).select(folds.fold_by(F.array(one("here", "visible-text"), one(None, "tel-link")), lambda p: p["normalized"], folds.backfilled).alias("v")).first()["v"]
    assert [(x["context"], x["source"]) for x in found] == [("here", "tel-link")]


def test_emails(spark):
    assert values(spark, ["a.B@X.Com, <c@d.org>. e [at] f.co [dot] uk A.b@x.com"], lambda x: emails.captured_emails(F.concat(F.array(x), emails.mailto_texts(F.array(F.lit("mailto:q@r.io;s@t.io?subject=1"), F.lit("mailto:not-an-address"))))))[0] == ["a.B@x.com", "c@d.org", "e@f.co.uk", "q@r.io", "s@t.io"]
    assert values(spark, [" A@B.Com ", "a@b", "a..b@c.de", None], emails.normalized_email) == ["A@b.com", "", "", None]


def test_urls(spark):
    assert values(spark, ["https://www.X.com./a", "x", None, "http://[::1"], urls.host_for_url) == ["x.com", "", "", ""]
    assert values(spark, ["HTTPS://X.com:443/a/?utm_Source=1&b=2#f", "mailto:a@b.c"], urls.normalized_url) == ["https://x.com/a?b=2", ""]
    assert values(spark, ["https://x.com/a//?b=2&a=1&fbclid=9"], urls.comparable_url) == ["https://x.com/a?a=1&b=2"]


def test_links(spark):
    assert values(spark, ["https://m.facebook.com/a", "https://notfacebook.com/a", "whatsapp://send?phone=1", "https://discord.gg/x"], links.platform) == ["facebook", None, "whatsapp", "other"]
    assert values(spark, ["https://instagram.com//", "https://facebook.com/profile.php?x=1", "https://youtube.com/c/x/?a=1"], links.clean_social_url) == [None, None, "https://youtube.com/c/x"]


def test_csv_value(spark):
    assert values(spark, ["a", 'a"b', "a,b", "a\nb", None], export.csv_value) == ["a", '"a""b"', '"a,b"', '"a\nb"', ""]
