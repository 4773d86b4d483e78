"""Hosts and stored pages with very many rows: results as one by one, and nothing gathered but distinct values."""

from pyspark.sql import functions as F

from contactloom.operators import extract, store
from contactloom.schemas import LEAD


def test_host_of_many_pages(spark):
    footer = "<footer>+20 100 000 0003 <a href='mailto:i@shop.com'>m</a><a href='https://instagram.com/shop'>i</a></footer>"
    rows = [(k, f"https://shop.com/p{k}", footer + (f"<a href='mailto:x{k}@shop.com'>m</a><a href='https://wa.me/2010012345{k}'>w</a>" if k in (11, 25) else ""), "timeout" if k > 5 else None) for k in range(60)]
    rows += [(1, "https://quiet.com/", "<p>none", None)]
    found = extract.crawled(spark.createDataFrame(rows, "page_id int, url string, html string, error string").repartition(4), as_of="2026-01-01", default_country="EG", error_col="error")
    leads = {r["name"]: r.asDict() for r in found.collect()}
    lead = leads["shop.com"]
    assert (lead["phone"], lead["email"], lead["website"], lead["social_url"]) == ("+201001234511", "i@shop.com", "https://shop.com/p0", "https://instagram.com/shop")
    assert lead["notes"] == "other phones: +201001234525 | +201000000003; other emails: x11@shop.com | x25@shop.com; crawl_error: timeout"
    assert leads["quiet.com"]["website"] == "https://quiet.com/" and leads["quiet.com"]["notes"] == ""


def lead(k, seq, title, time, phones, emails, social, external):
    return (f"id{seq}", title, f"https://p{k}.com/", "", time, None, phones, [], emails, social, external, seq)


def batch_rows():
    texts, sources = ["", "ctx", None, "other"], ["visible-text", "tel-link", "", "anchor-text", None]
    for seq in range(1, 15):
        numbers = [(f"0{(seq * j) % 4}", f"+{(seq * j) % 4}", texts[(seq + j) % 4], sources[(seq * 3 + j) % 5]) for j in range(3)]
        social = [("other" if (seq + j) % 3 else "instagram", f"https://s/{(seq + j) % 4}") for j in range(2)]
        external = [(f"https://{'s' if j else 'e'}/{(seq + j) % 5}", "" if seq % 2 else f"t{seq}", "x") for j in range(2)]
        yield lead(seq % 2, seq, "" if seq % 4 == 0 else f"T{seq}", ["bad", f"2025-01-{20 - seq:02d}T00:00:00Z", "2025-01-03T00:00:00Z"][seq % 3], numbers, [f"A{seq % 3}@x.com", f"a{seq % 3}@x.com"], social, external)


def test_upsert_as_one_by_one(spark):
    schema = f"{LEAD}, seq long"
    rows = list(batch_rows())
    key = lambda df: sorted(map(str, df.select(*[c for c in df.columns if c not in ("status", "seq")]).collect()))
    batch = spark.createDataFrame(rows, schema).repartition(3)
    current = spark.createDataFrame([lead(0, 1, "old", "2025-01-05T00:00:00Z", [("0", "+1", None, "anchor-text")], ["a1@x.com"], [("other", "https://s/1")], [])], schema)
    for rule in store.ON_DUPLICATE:
        at_once = store.upsert(current, batch, rule, "now")
        assert "collect_list(struct(seq" not in at_once._jdf.queryExecution().toString()
        one = current
        for r in rows:
            one = spark.createDataFrame(store.upsert(one, spark.createDataFrame([r], schema), rule, "now").drop("status").collect(), schema)
        assert key(at_once) == key(one), rule
    alone = store.upsert(current.limit(0), batch.where("seq = 3"), "merge", "now")
    assert key(alone) == key(batch.where("seq = 3")) and alone.where(F.col("status") == "added").count() == 1
