"""Robots rules as a table: each origin is asked once, its parsed rules are kept with their age and joined to what is to be fetched.

An origin's rules are those of the group for our agent, in the order of its file: the first one that a path begins with decides, and a path
that none speaks of is allowed. An origin that doesn't answer, or says that there are none, allows everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.sources import folders

RULES = T.ArrayType(T.StructType().add("path", T.StringType()).add("allow", T.BooleanType()))
_TABLE = f"origin string, status int, rules {RULES.simpleString()}"
_ARROW_RULES = pa.list_(pa.struct([("path", pa.string()), ("allow", pa.bool_())]))


def origin_of(url: Column) -> Column:
    """Scheme and authority; null for what is no web address."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)), F.lit(""))


def origin(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}".lower()


def parsed(text: str, agent: str) -> list[tuple[str, bool]]:
    """The rules for an agent as (path, allow), in order."""
    from urllib.robotparser import RobotFileParser

    parser = RobotFileParser()
    parser.parse(text.splitlines())
    own = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
    return [("/" if line.path == "*" else line.path, line.allowance) for line in own.rulelines] if own else []


def path_of(url: str) -> str:
    """What rules are held against: the quoted path with its query."""
    parts = urlsplit(unquote(url))
    return quote(urlunsplit(("", "", parts.path, parts.query, parts.fragment))) or "/"


def allowed(rules: list[tuple[str, bool]], url: str) -> bool:
    path = path_of(url)
    return next((allow for begin, allow in rules if path.startswith(begin)), True)


def allows(rules: Column, path: Column) -> Column:
    """``allowed`` as an expression, of a path as in ``path_of``."""
    return F.coalesce(F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))["allow"], F.lit(True))


def ask(where: str, config, transport: Callable) -> tuple[int | None, list[tuple[str, bool]]]:
    try:
        _, status, _, body = transport(f"{where}/robots.txt", config)
    except OSError:
        return None, []
    return status, parsed(body.decode("utf-8", "replace"), config.user_agent) if status < 400 else []


def asked(origins: DataFrame, config, transport: Callable) -> DataFrame:
    """(origin, status, rules) of each of the origins; several are asked at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(config.slots) as pool:
            for batch in batches:
                names = batch.column("origin").to_pylist()
                found = list(pool.map(lambda x: ask(x, config, transport), names))
                rules = [[{"path": p, "allow": a} for p, a in r] for _, r in found]
                yield pa.record_batch([batch.column("origin"), pa.array([s for s, _ in found], pa.int32()), pa.array(rules, _ARROW_RULES)], ["origin", "status", "rules"])

    return origins.select("origin").where("origin IS NOT NULL").distinct().repartition(config.partitions, "origin").mapInArrow(run, _TABLE)


class RobotsTable:
    """The rules that were asked for, at ``path``: each refresh adds a folder, and the latest row of an origin counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, max_age_seconds: int | None = None) -> DataFrame:
        """(origin, status, rules, fetched_at), one row an origin, none older than that."""
        done = [x for x in folders.names(self.spark, self.path) if "_SUCCESS" in folders.names(self.spark, f"{self.path}/{x}")]
        kind = f"{_TABLE}, fetched_at timestamp"
        if not done:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).parquet(*(f"{self.path}/{x}" for x in done))
        if max_age_seconds is not None:
            rows = rows.where(F.unix_seconds("fetched_at") > F.unix_seconds(F.current_timestamp()) - max_age_seconds)
        return rows.groupBy("origin").agg(F.max(F.struct("fetched_at", "status", "rules")).alias("x")).select("origin", "x.status", "x.rules", "x.fetched_at")

    def refresh(self, urls: DataFrame, config, transport: Callable, *, url_col: str = "url", max_age_seconds: int = 86_400) -> DataFrame:
        """Asks the origins of these URLs that the table doesn't know, or not freshly enough; gives the table's rows."""
        wanted = urls.select(origin_of(F.col(url_col)).alias("origin")).distinct()
        new = wanted.join(self.read(max_age_seconds).select("origin"), "origin", "left_anti")
        asked(new, config, transport).withColumn("fetched_at", F.current_timestamp()).write.parquet(f"{self.path}/asked-{uuid.uuid4().hex}")
        return self.read(max_age_seconds)
