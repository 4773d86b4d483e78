"""Rows are dealt out before the costly rules, and pages are handed back in slices."""

import pyarrow as pa

from contactloom.functions import html
from contactloom.operators import extract
from contactloom.plans import catalog


def test_one_row_group_is_work_of_many_tasks(spark, sf_dir):
    for name in ("customer", "pages"):
        rows = catalog._table(spark, sf_dir, name)
        assert rows.selectExpr("spark_partition_id() AS p").distinct().count() == 4
        assert rows.count() == spark.read.parquet(f"{sf_dir}/{name}.parquet").count()


def test_filters_stay_behind_the_dealing(spark, sf_dir):
    for rows in (catalog.lead_search(spark, sf_dir), catalog.leads(spark, sf_dir).where("trim(source_url) <> ''")):
        below = rows._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[1]
        assert "Filter" not in below


def test_pages_come_back_in_slices():
    pages = [f"<title>{k}</title>" + "<p>x</p>" * 10_000 for k in range(12)] + [None, ""]
    slices = list(html.parsed.func(iter([(pa.array(pages), pa.array(["https://a.com/"] * len(pages)))])))
    assert len(slices) > 3
    assert [t.as_py() for x in slices for t in x.field("title")] == [*map(str, range(12)), "", ""]


def test_title_as_it_is_written(spark, tmp_path):
    written = ["a &amp; b &quot;c", "cut &amp", " x  y\nz ", "T&uuml;r"]
    pages = [(k, "https://a.com/", f"<html>\n<head>\n\n<title>{t}</title><title>other</title><p>&lt;") for k, t in enumerate(written)] + [(9, "https://a.com/", "<title>open"), (10, "https://a.com/", "<p>none")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r["title"] for r in catalog.page_title(spark, str(tmp_path)).collect()}
    assert found == {0: "a & b &quot;c", 1: "cut &amp", 2: "x  y\nz", 3: "T&uuml;r", 9: "", 10: ""}
    assert html.read_page(pages[3][2], "https://a.com/")["title"].startswith("T\u00fcr")


def test_number_before_one_without_a_sign(spark):
    texts = ["Call +1 (683) 555-5442 55.95.145.182 now", "+1 (689) 555-1019 4472194062177086 12", "+1 (689) 555-1019"]
    pages = spark.createDataFrame([(k, f"https://h{k}.example.com/", f"<p>{t}</p>") for k, t in enumerate(texts)], "page_id long, url string, html string")
    found = {r["name"]: r["phone"] for r in extract.crawled(pages, as_of="2026-01-01").collect()}
    assert found == {"h0.example.com": "+16835555442", "h1.example.com": "+16895551019", "h2.example.com": "+16895551019"}


def test_a_second_batch_evaluates_its_leads_once(spark, sf_dir):
    plan = catalog._second_batch(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    found = catalog._second_batch(spark, sf_dir).selectExpr("count(*) AS n", "count_if(id LIKE 'nid%') AS fresh", "count_if(source_url LIKE '%#new') AS marked").first()
    assert found["n"] == 2 * found["fresh"] == 2 * found["marked"] > 0


def test_a_search_makes_its_text_once(spark, sf_dir):
    plan = catalog.lead_search(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("concat_ws" in line for line in plan.splitlines() if "Filter" in line)


def test_served_copy_evaluates_its_leads_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from contactloom.operators import serving

    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        met.add(1)
        return title

    rows = catalog.leads(spark, "/root/testdata/sf0.001")
    n = rows.count()
    serving.build(rows.withColumn("page_title", counted("page_title")), str(tmp_path), part_rows=40)
    assert met.value == n


def test_posting_lists_in_numpy():
    from contactloom.operators import serving

    batch = pa.record_batch([pa.array([0, 0, 0, 1], pa.int32()), pa.array([5, 3, 9, 5], pa.int64()), pa.array(["abab\U0001f600", "ab", "xaba", "aba"])], ["part", "seq", "text"])
    found = {(g, p): s for x in serving._posting_lists(iter([batch])) for g, p, s in zip(*(x.column(k).to_pylist() for k in range(3)))}
    assert found == {("aba", 0): [5, 9], ("bab", 0): [5], ("ab\U0001f600", 0): [5], ("xab", 0): [9], ("aba", 1): [5]}


def test_blanks_and_addresses_as_the_patterns_have_them(spark):
    from pyspark.sql import functions as F

    from contactloom.functions import emails, text

    odd = ["", " ", "a", " a ", "﻿ x y　\n", "a  b\t\tc d", "x   y", "᠎a᠎", "\x1ca\x1f", "a@b@c.d", "@b.c", "a@", ".a@b.c", "a.@b.c", "a..b@c.d", "A.b@C.D", None, "٣۴x", "a+b%20c", "%zz+"]
    rows = spark.createDataFrame([(x,) for x in odd], "v string")
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    part = lambda k: F.regexp_extract(trimmed(F.col("v")), "(?s)^(.*)@([^@]*)$", k)
    split = emails._split(trimmed(F.col("v")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = {
        "trim": (text.utrim("v"), trimmed("v")),
        "blanks": (text.collapse_blanks(F.col("v")), trimmed(F.regexp_replace("v", r"(?U)\s+", " "))),
        "digits": (text.ascii_digits(F.col("v")), F.translate("v", text.EASTERN_DIGITS, "0123456789" * 2)),
        "decoded": (text.percent_decoded(F.col("v")), F.coalesce(F.try_url_decode(F.replace("v", F.lit("+"), F.lit("%2B"))), F.col("v"))),
        "local": (split["a"], part(1)),
        "domain": (split["b"], part(2)),
    }
    for name, (now, pattern) in both.items():
        for r in rows.select("v", now.alias("a"), pattern.alias("b")).collect():
            assert r["a"] == r["b"], (name, r)
