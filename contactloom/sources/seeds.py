"""Seed lists: a text file with one URL a line, checked as a whole before anything is read from the network.

The file is read as lines, in as many tasks as it has blocks; only the blocks' line counts meet in one task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.functions import urls
from contactloom.functions.text import utrim
from contactloom.operators.store import first_per_host

#: Line ends besides those that Spark's reader knows.
_LINE_ENDS = r"[\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


class SeedError(ValueError):
    """A seed list that can't be used, with all that is wrong with it."""


def seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw, url, problem, host) of the lines that are not blank; ``line_no`` counts from 1."""
    try:
        read = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise SeedError(f"{path}: there is no such seed list") from e
        raise
    if read.where(~F.is_valid_utf8("value")).limit(1).count():
        raise SeedError(f"{path}: the seed list must be UTF-8 text")
    text = F.when((F.col("block") == 0), F.regexp_replace("value", r"\A\x{FEFF}", "")).otherwise(F.col("value"))
    lines = read.select("block", "at", F.posexplode(F.split(text, _LINE_ENDS, -1)).alias("part", "raw"))
    counts = lines.groupBy("block").agg(F.count("*").alias("n"))
    before = counts.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = lines.withColumn("own", F.row_number().over(Window.partitionBy("block").orderBy("at", "part")))
    url = utrim(F.col("raw"))
    numbered = own.join(before, "block").where(url != "")
    return numbered.select((F.col("before") + F.col("own")).cast("long").alias("line_no"), "raw", url.alias("url"), urls.url_problem(url).alias("problem"), urls.host_for_url(url).alias("host"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, url, host): the first URL of each host, as it was written. An error names every line that is wrong."""
    if not path.lower().endswith(".txt"):
        raise SeedError(f"{path}: the seed list must be a .txt file")
    lines = seed_lines(spark, path)
    bad = [f"line {r['line_no']} {r['problem']}: {r['raw'].strip()}" for r in lines.where("problem IS NOT NULL").orderBy("line_no").toLocalIterator()]
    if bad:
        raise SeedError(f"{path}: " + "; ".join(bad))
    if lines.limit(1).count() == 0:
        raise SeedError(f"{path} contains no URLs")
    return first_per_host(lines).select("line_no", "url", "host").orderBy("line_no")
