"""A document as a data sink: parts in order under one name, which appears at once or not at all.

    write_document(export.csv_lines(rows), "/shared/leads.csv", line_end="\\r\\n", bom=True)

Rows (``seq``, ``line``) are dealt by ranges of ``seq``; each task writes one part, and no task has to hold or sort them all. The commit puts the parts in order,
a byte-order mark in front as a part of its own, and renames the folder; the parts, one after another, are the document. A task that fails or runs
twice leaves nothing: only parts that the commit names are moved, and the rest goes with the folder they were written in. An existing document is refused, or with
``overwrite`` replaced.

Files are written through pyarrow's file systems: local or mounted folders, HDFS, object stores (where a rename is a copy).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BOM = b"\xef\xbb\xbf"


def _files(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class _Part(WriterCommitMessage):
    file: str
    first: int | None
    last: int | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        given = {k.lower(): v for k, v in options.items()}
        if "path" not in given:
            raise ValueError("the document's path is missing")
        self.path, self.overwrite = given["path"].rstrip("/"), overwrite
        self.line_end, self.bom = given.get("lineend", "\n"), given.get("bom", "false").lower() == "true"
        self.staging = f"{self.path}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        files, folder = _files(self.staging)
        files.create_dir(folder, recursive=True)
        name, first, last = f"{folder}/{uuid.uuid4().hex}", None, None
        end = self.line_end
        with files.open_output_stream(name) as out:
            for batch in iterator:
                for seq, line in zip(batch.column("seq").to_pylist(), batch.column("line").to_pylist()):
                    if last is not None and seq < last:
                        raise ValueError("rows are not in the order of seq")
                    first, last = seq if first is None else first, seq
                    out.write(f"{line or ''}{end}".encode())
        return _Part(name, first, last)

    def commit(self, messages: list[_Part | None]) -> None:
        from pyarrow import fs

        files, folder = _files(self.staging)
        parts = sorted((m for m in messages if m and m.first is not None), key=lambda m: m.first)
        if any(a.last >= b.first for a, b in zip(parts, parts[1:])):
            raise ValueError("parts overlap: deal the rows by ranges of seq")
        whole = f"{folder}/whole"
        files.create_dir(whole, recursive=True)
        if self.bom:
            with files.open_output_stream(f"{whole}/part-000000") as out:
                out.write(BOM)
        for k, part in enumerate(parts, 1):
            files.move(part.file, f"{whole}/part-{k:06d}")
        _, to = _files(self.path)
        if files.get_file_info(to).type != fs.FileType.NotFound:
            if not self.overwrite:
                raise FileExistsError(self.path)
            files.delete_dir(to)
        files.move(whole, to)
        files.delete_dir(folder)

    def abort(self, messages: list[_Part | None]) -> None:
        files, folder = _files(self.staging)
        files.delete_dir_contents(folder, missing_dir_ok=True)
        files.create_dir(folder, recursive=True)
        files.delete_dir(folder)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contact_document"

    def schema(self) -> str:
        return "seq long, line string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def write_document(lines: DataFrame, path: str, *, parts: int = 64, line_end: str = "\n", bom: bool = False, overwrite: bool = False) -> None:
    """Writes (seq, line) as a document of at most so many parts."""
    spark = lines.sparkSession
    spark.dataSource.register(DocumentSink)
    dealt = lines.select(F.col("seq").cast("long").alias("seq"), "line").repartitionByRange(parts, "seq").sortWithinPartitions("seq")
    dealt.write.format("contact_document").option("lineEnd", line_end).option("bom", bom).mode("overwrite" if overwrite else "append").save(path)
