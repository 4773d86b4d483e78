r"""WARC derivatives: from each response one metadata and one plain-text conversion record.

``responses`` makes response records of a table of pages; ``derive`` turns response records,
from there or elsewhere, into records that refer to them: ``WARC-Refers-To`` and its target
and date, the source's block and payload digests, and in the metadata its HTTP headers, title,
language and links. Record ids follow from the response's id, so a task that runs again makes
the same ones. ``write`` stores whole records as WARC text files, ``read`` gives them back.

Defined cases: a null or empty body gives empty conversion text; a block without a blank line
after its HTTP header is all body; bytes that are not UTF-8 become U+FFFD; line ends inside
header values become blanks, and conversion text has only \n; a null record id gives no
derivatives; repeated responses give repeated records; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_DERIVED = "response_id string, record_type string, record_id string, refers_to string, target_uri string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, record string"
_NAMES = [x.split()[0] for x in _DERIVED.split(", ")]

# Elements without text, and elements that stand on lines of their own.
_SILENT = "script|style|noscript|template"
_BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"

_DROPPED = re.compile(rf"<!--.*?(?:-->|\Z)|<({_SILENT})\b[^>]*(?:>.*?(?:</\1\b[^>]*(?:>|\Z)|\Z)|\Z)", re.S | re.I)
_BLOCK = re.compile(rf"</?(?:{_BLOCKS})\b[^<>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def one_line(text: str) -> str:
    return " ".join(text.split())


def plain_text(page: str) -> str:
    """The text of a page: a line for each block, blanks collapsed, no empty lines."""
    text = _TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub("", page)))
    return _LINES.sub("\n", _SPACE.sub(" ", html.unescape(text).replace("\r", "\n"))).strip()


def links(page: str, base: str) -> list[str]:
    """The page's link targets, absolute where possible, each once, in order."""
    found = {}
    for groups in _LINK.findall(page):
        href = one_line(html.unescape(next((x for x in groups if x), "")))
        if not href or href.startswith("#"):
            continue
        try:
            found[urljoin(base, href)] = None
        except ValueError:
            found[href] = None
    return list(found)


def _record(kind: str, own: str, source: dict, content_type: str, block: str) -> tuple[int, str, str]:
    """Length, digest and whole text of a record."""
    data = block.encode("utf-8", "replace")
    checked = digest(data)
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": own,
        "WARC-Date": source["date"],
        "WARC-Target-URI": source["uri"],
        "WARC-Refers-To": source["id"],
        "WARC-Refers-To-Target-URI": source["uri"],
        "WARC-Refers-To-Date": source["date"],
        "WARC-Block-Digest": checked,
        "Content-Type": content_type,
        "Content-Length": str(len(data)),
    }
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields.items() if v)
    return len(data), checked, f"{VERSION}\r\n{head}\r\n{block}"


def derived(response_id: str, uri: str, date: str, block: bytes) -> Iterator[tuple]:
    """The rows of a response's two derivatives."""
    head, gap, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    if head and not gap:
        head, body = b"", block
    source = {"id": response_id, "uri": uri, "date": date}
    block_digest, payload_digest = digest(block), digest(body)
    page = body.decode("utf-8", "replace")
    lines = head.decode("latin-1").split("\r\n")
    title, lang = _TITLE.search(page), _LANG.search(page)
    facts = [("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-length", str(len(block))), ("http-status", lines[0])]
    facts += [("http-header", x) for x in lines[1:]]
    facts += [("title", html.unescape(title[1]) if title else ""), ("language", lang[1] if lang else "")]
    facts += [("outlink", x) for x in links(page, uri)]
    for kind, content_type, text in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in facts if one_line(v))),
        ("conversion", "text/plain; charset=utf-8", plain_text(page)),
    ):
        own = record_id(response_id, kind)
        size, checked, record = _record(kind, own, source, content_type, text)
        yield response_id, kind, own, response_id, uri, size, checked, block_digest, payload_digest, record


#: Rows that go out together.
_ROWS = 256


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            rows = [x for row in zip(*(part.column(c) for c in ("record_id", "target_uri", "warc_date", "block"))) for x in derived(*(y.as_py() or z for y, z in zip(row, ("", "", "", b""))))]
            keys = part.column("key").take(pa.array([k // 2 for k in range(2 * part.num_rows)]))
            columns = [pa.array(x, pa.int64() if n == "content_length" else pa.string()) for n, x in zip(_NAMES, zip(*rows))]
            yield pa.record_batch([keys, *columns], ["key", *_NAMES])


def _uuid_of(*columns) -> F.Column:
    """An id from a digest of the columns, in the form of a UUID."""
    hexes = F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    part = lambda a, n: F.substr(hexes, F.lit(a), F.lit(n))
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records (the page's id, record_id, target_uri, warc_date, block) of a table of pages."""
    body = F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col), _uuid_of(id_col, url_col).alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def derive(found: DataFrame, key: str = "record_id") -> DataFrame:
    """Two rows for each response record (record_id, target_uri, warc_date, block), with its column ``key``; ``record`` is the whole record. No row is shuffled."""
    rows = found.where("record_id IS NOT NULL").select(F.col(key).alias("key"), "record_id", "target_uri", "warc_date", "block")
    made = rows.mapInArrow(_derive, f"key {rows.schema['key'].dataType.simpleString()}, {_DERIVED}")
    return made.drop("key") if key == "record_id" else made.withColumnRenamed("key", key)


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files: records with the two line ends that close each."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(fields, block) of the records in ``write``'s files. Conversion text has no carriage return, so the version line is found nowhere else."""
    rows = spark.read.option("lineSep", VERSION + "\r\n").text(path).where("value <> ''")
    head = F.substring_index("value", "\r\n\r\n", 1)
    fields = F.map_from_entries(F.transform(F.split(head, "\r\n"), lambda x: F.struct(F.substring_index(x, ": ", 1), F.regexp_replace(x, r"^[^:]*: ?", ""))))
    rest = F.expr("substr(value, length(substring_index(value, '\\r\\n\\r\\n', 1)) + 5)")
    return rows.select(fields.alias("fields"), F.regexp_replace(rest, r"(?:\r\n\r\n)\z", "").alias("block"))


QUERY = "op5_warc_derivatives"


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return derive(responses(pages), "page_id")
