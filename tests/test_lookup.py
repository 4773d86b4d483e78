"""Longest prefixes and suffixes from tables, against plain loops, with large tables."""

from pyspark.sql import functions as F

from contactloom import dims
from contactloom.functions import phones
from contactloom.operators import lookup


def test_prefixes(spark):
    table = spark.createDataFrame([("1", "a"), ("12", "b"), ("123456", "c"), ("9", None), (None, "d"), ("", "e"), ("12", "z")], "prefix string, name string")
    values = ["1", "12", "123", "1234567", "2", "", None, "99", "12"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, digits string")
    found = {r["id"]: (r["plan"] and (r["plan"]["prefix"], r["plan"]["name"])) for r in lookup.by_prefix(rows, "digits", table).collect()}
    assert found == {0: ("1", "a"), 1: ("12", "b"), 2: ("12", "b"), 3: ("123456", "c"), 4: None, 5: None, 6: None, 7: ("9", None), 8: ("12", "b")}
    assert lookup.by_prefix(rows, "digits", table.limit(0)).where("plan IS NULL").count() == len(values)


def test_suffixes_of_a_large_table(spark):
    table = spark.range(100_000).select(F.concat(F.lit("d"), "id", F.lit(".example.org")).alias("domain"), "id").unionByName(spark.createDataFrame([("org", -1), ("example.org", -2), ("a.b.d7.example.org", -3)], "domain string, id long"))
    hosts = ["d5.example.org", "www.D5.example.org.", "x.a.b.d7.example.org", "b.d7.example.org", "xd5.example.org", "other.org", "none.com", "", None, "org", "..", "d99999.example.org"]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, host string")
    found = lookup.by_suffix(rows, "host", table)
    ids = {r["k"]: r["owner"] and r["owner"]["id"] for r in found.collect()}
    assert ids == {0: 5, 1: 5, 2: -3, 3: 7, 4: -2, 5: -1, 6: None, 7: None, 8: None, 9: -1, 10: None, 11: 99999}
    # the table is joined, it is no part of an expression
    assert len(found._jdf.queryExecution().analyzed().toString()) < 20_000


def test_plans(spark):
    numbers = ["201001234567", "2010012345", "9991234567", "14165550100", "12025550143", "120255501", "18765550100", "2469", "2469123456", "9715012345678", "", None]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(numbers)], "k int, digits string")
    found = {r["k"]: (r["region"], r["valid"]) for r in lookup.planned(rows, "digits", lookup.plans(spark)).collect()}
    assert found[2] == (None, False) and found[3] == ("CA", True) and found[4] == ("US", True) and found[5] == ("US", False) and found[6] == ("JM", True)
    assert found[7] == ("IO", False) and found[8] == ("IO", True) and found[9] == ("AE", False) and found[10] == (None, False) and found[11] == (None, False)
    # no calling code begins another
    codes = list(dims.CALLING_CODES) + list(dims.MORE_CALLING_CODES)
    assert not [(a, b) for a in codes for b in codes if a != b and b.startswith(a)]


def test_numbers_of_unassigned_codes_are_none(spark):
    values = ["+999 123 4567", "+210 123 4567", "+20 100 123 4567", "+966 50 123 4567", "00999 123 4567 8", "+800 1234 5678"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", phones.valid_number(F.col("v"), "EG").alias("n")).collect()
    assert {r["v"]: r["n"] and r["n"]["e164"] for r in rows} == {"+999 123 4567": None, "+210 123 4567": None, "+20 100 123 4567": "+201001234567", "+966 50 123 4567": "+966501234567", "00999 123 4567 8": None, "+800 1234 5678": "+80012345678"}
