"""Look-ups by longest prefix and longest suffix, as joins with tables of any size.

A number is joined by each prefix that has a length of the table's, a host by itself and each of its parents: a few rows for each distinct number or
host, on keys that only equality joins, and the longest one found stays. No pattern or expression grows with the table. Rows are matched by
their distinct values, so a value that many rows share is looked up once.

Defined cases: nulls and empty values match nothing; a table that names a key twice gives the row that is first in order; matching a host ignores case and a
full stop at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom import dims
from contactloom.functions import phones

#: (prefix, code_digits, region, shortest, longest): the first digits of a number, how many of them are the calling code, and the lengths of national numbers.
PLAN = "prefix string, code_digits int, region string, shortest int, longest int"


def _longest(rows: DataFrame, value: str, keys: Column, table: DataFrame, key: str, to: str) -> DataFrame:
    """The rows with ``to``, the table's row under the longest of the keys, or null."""
    names = [c for c in table.columns if c != key]
    known = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*names)).alias("_found"))
    asked = rows.select(F.col(value).alias("_value")).where("_value IS NOT NULL").distinct().select("_value", F.explode(keys).alias("_key"))
    best = asked.join(known, "_key").groupBy("_value").agg(F.max_by(F.struct(F.col("_key").alias(key), "_found"), F.length("_key")).alias("_best"))
    whole = F.when(F.col("_best").isNotNull(), F.struct(F.col(f"_best.{key}").alias(key), *(F.col(f"_best._found.{c}").alias(c) for c in names)))
    return rows.join(best, F.col(value) == F.col("_value"), "left").select(*rows.columns, whole.alias(to))


def by_prefix(rows: DataFrame, digits_col: str, table: DataFrame, to: str = "plan", key: str = "prefix") -> DataFrame:
    """The rows with the table's row of the longest prefix of their digits."""
    # a handful of lengths: prefixes have at most fifteen digits
    lengths = sorted(r["n"] for r in table.select(F.length(key).alias("n")).distinct().collect() if r["n"])
    keys = F.filter(F.array(*(F.left("_value", F.lit(n)) for n in lengths)), lambda k: k != "") if lengths else F.array().cast("array<string>")
    return _longest(rows, digits_col, F.array_distinct(keys), table, key, to)


def by_suffix(rows: DataFrame, host_col: str, table: DataFrame, to: str = "owner", key: str = "domain") -> DataFrame:
    """The rows with the table's row of the longest domain that their host is, or lies in."""
    host = F.regexp_replace(F.lower("_value"), r"\.$", "")
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    return _longest(rows, host_col, F.filter(parents, lambda p: p != ""), table, key, to)


def plans(spark: SparkSession) -> DataFrame:
    """The numbering plans that the engine knows; another table of this shape can take their place."""
    rows = []
    for code, region in (dims.CALLING_CODES | dims.MORE_CALLING_CODES).items():
        shortest, longest = (10, 10) if region == "US" else phones.NATIONAL_LENGTHS.get(region, (max(1, 7 - len(code)), 15 - len(code)))
        rows.append((code, len(code), region, shortest, longest))
    rows += [("1" + area, 1, region, 10, 10) for area, region in (dict.fromkeys(dims.CANADA_AREA_CODES, "CA") | dims.ISLAND_AREA_CODES).items()]
    return spark.createDataFrame(rows, PLAN)


def networks(spark: SparkSession) -> DataFrame:
    """(domain, platform) of the social networks that the engine knows."""
    return spark.createDataFrame([(d, p) for p, domains in (dims.PLATFORM_DOMAINS | {"other": dims.OTHER_NETWORKS}).items() for d in domains], "domain string, platform string")


def planned(numbers: DataFrame, digits_col: str, table: DataFrame) -> DataFrame:
    """The numbers with ``region`` and ``valid``: a plan is known for them, and the national number has one of its lengths."""
    found = by_prefix(numbers, digits_col, table, "_plan")
    national = F.length(digits_col) - F.col("_plan.code_digits")
    return found.select(*numbers.columns, F.col("_plan.region").alias("region"), F.coalesce(national.between(F.col("_plan.shortest"), F.col("_plan.longest")), F.lit(False)).alias("valid"))
