"""Pages as a data source: ``spark.read.format("contact_pages")`` over a plan of targets.

    page_source.plan(targets, folder, groups=64)              # (host, url) or (host, url, rules), a file a group of hosts
    spark.dataSource.register(page_source.PageSource)
    spark.read.format("contact_pages").option("targets", folder).load()

A partition is a group of hosts, of which several are asked in turn; its rows are those of ``web.crawl``. Options are the fields of ``CrawlConfig``; ``transport``
names a function as ``module:function`` in place of the network. The plan is read where it is fetched, through pyarrow's file systems: a local or mounted
folder, HDFS or an object store. A partition that runs again asks its hosts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import fields
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from contactloom.sources import robots
from contactloom.sources.web import PAGES, CrawlConfig, fetch, page_batch, visits


def plan(targets: DataFrame, folder: str, groups: int = 64) -> None:
    """Deals targets by host into at most ``groups`` files."""
    rules = F.col("rules") if "rules" in targets.columns else F.lit(None).cast(robots.RULES)
    targets.select("host", "url", rules.alias("rules")).repartition(groups, "host").write.mode("errorifexists").parquet(folder)


def _files(folder: str):
    from pyarrow import fs

    # Spark names local folders file:/a as well as file:///a
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


class _Group(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        if "targets" not in given:
            raise ValueError("option targets: the folder of a plan")
        self.folder = given["targets"]
        kinds = {"int": int, "float": float, "str": str, "bool": lambda x: x.lower() == "true"}
        # options come in lower case
        names = {f.name.replace("_", ""): f for f in fields(CrawlConfig)} | {f.name: f for f in fields(CrawlConfig)}
        self.config = CrawlConfig(**{names[k].name: kinds[str(names[k].type)](v) for k, v in given.items() if k in names})
        self.transport = given.get("transport")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, path = _files(self.folder)
        found = sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet") and x.size)
        return [_Group(x) for x in found] or [_Group("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if not partition.path:
            return
        transport: Callable = fetch
        if self.transport:
            module, _, name = self.transport.partition(":")
            transport = getattr(import_module(module), name)
        files, _ = _files(self.folder)

        def targets():
            with files.open_input_file(partition.path) as raw:
                for batch in pq.ParquetFile(raw).iter_batches(256, columns=["host", "url", "rules"]):
                    for row in batch.to_pylist():
                        yield row["host"], row["url"], None if row["rules"] is None else [(r["path"], r["allow"]) for r in row["rules"]]

        for rows in visits(targets(), self.config, transport):
            yield page_batch(rows)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contact_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
