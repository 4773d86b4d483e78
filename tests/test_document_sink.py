"""Documents appear at once, in order, with the layout of the plain writer; what fails leaves nothing."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from contactloom import sql
from contactloom.operators import export
from contactloom.plans import catalog
from contactloom.sources.document_sink import write_document

AT = "2026-01-01T00:00:00Z"


def whole(path):
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.mark.parametrize("kind", export.KINDS)
def test_layout(spark, sf_dir, tmp_path, kind):
    leads = catalog.leads(spark, sf_dir)
    lines = {"csv": lambda: export.csv_lines(export.flat_rows(leads)), "txt": lambda: export.text_document(leads, AT), "json": lambda: export.json_document(leads, AT)}[kind]()
    end, bom = export.KINDS[kind]
    path = str(tmp_path / f"leads.{kind}")
    write_document(lines, path, parts=7, line_end=end, bom=bom)
    expected = (export.BOM.encode() if bom else b"") + b"".join(f"{r['line']}{end}".encode() for r in lines.orderBy("seq").collect())
    assert whole(path) == expected and len(os.listdir(path)) <= 8
    assert os.listdir(tmp_path) == [f"leads.{kind}"]
    with pytest.raises(Exception, match="FileExistsError"):
        write_document(lines, path, line_end=end, bom=bom)
    assert whole(path) == expected
    write_document(lines.where("seq < 5"), path, line_end=end, bom=bom, overwrite=True)
    assert expected.startswith(whole(path)) and os.listdir(tmp_path) == [f"leads.{kind}"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="broken"):
        write_document(rows, str(tmp_path / "x.txt"), parts=4)
    assert os.listdir(tmp_path) == []
    write_document(rows.where("seq < 0"), str(tmp_path / "none.txt"), bom=True)
    assert whole(str(tmp_path / "none.txt")) == b"\xef\xbb\xbf"


def test_page_elements_in_sql(spark):
    assert "html_elements" in sql.register(spark)
    spark.createDataFrame([(1, "https://a.com/x", "<a href='/b'>B <b>c</b></a><p id=q>d<p>e"), (2, "https://b.com/", None)], "page_id int, url string, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("SELECT page_id, place, tag, text, link, attributes['id'] AS id FROM some_pages, LATERAL html_elements(html, url) ORDER BY page_id, place").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a", "B c", "https://a.com/b", None), (1, 1, "p", "", None, "q")]
    assert spark.sql("SELECT html_page(html, url).title AS t FROM some_pages").count() == 2
    frame = spark.createDataFrame([("00201001234567",)], "x string")
    for name in sql.RULES:
        made = sql.apply(frame, name, "x", "y")
        assert made.count() == 1 and "Python" not in made._jdf.queryExecution().executedPlan().toString()
    assert sql.apply(frame, "phone_key", "x", "y").first()["y"] == "201001234567"
