"""Pages from the network: targets dealt by host over Spark's tasks, with robots rules, a delay and a size cap.

A failed target is a row with its error, never a failed task. ``transport`` fetches one URL and
can be replaced: (url, config) -> (final url, status, content type, bytes).
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom import dims
from contactloom.sources import robots

PAGES = "host string, seed_url string, page_no int, page_url string, html string, error string"


@dataclass(frozen=True)
class CrawlConfig:
    partitions: int = 6
    timeout: float = 20.0
    delay: float = 0.25
    max_pages: int = 3
    max_bytes: int = 2_000_000
    obey_robots: bool = True
    strict_limit: bool = True
    user_agent: str = "contactloom/1.0"
    languages: str = "ar,en;q=0.8"
    #: Requests that run at a time in a task, and hosts that are open in it.
    slots: int = 6
    hosts: int = 64


def fetch(url: str, config: CrawlConfig) -> tuple[str, int, str, bytes]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    asked = Request(url, headers={"User-Agent": config.user_agent, "Accept": "text/html,application/xhtml+xml", "Accept-Language": config.languages})
    try:
        with urlopen(asked, timeout=config.timeout) as r:
            return r.geturl(), r.status, r.headers.get("Content-Type", ""), r.read(config.max_bytes)
    except HTTPError as e:
        return url, e.code, "", b""


def _page(url: str, config: CrawlConfig, transport: Callable) -> tuple[str, str]:
    final, status, kind, body = transport(url, config)
    if status >= 400:
        raise ValueError(f"status {status}")
    if kind and "html" not in kind.lower():
        raise ValueError(f"not HTML: {kind}")
    charset = kind.lower().partition("charset=")[2].split(";")[0].strip() or "utf-8"
    try:
        return final, body[: config.max_bytes].decode(charset, "replace")
    except LookupError:
        return final, body[: config.max_bytes].decode("utf-8", "replace")


class _Robots:
    """The rules of a host's origins: those of the seed's come with it, any other origin is asked once."""

    def __init__(self, config: CrawlConfig, transport: Callable, known: dict[str, list[tuple[str, bool]]]):
        self.config, self.transport, self.rules = config, transport, known

    def allow(self, url: str) -> bool:
        if not self.config.obey_robots:
            return True
        where = robots.origin(url)
        if where not in self.rules:
            self.rules[where] = robots.ask(where, self.config, self.transport)[1]
        return robots.allowed(self.rules[where], url)


def contact_urls(page: str, url: str, config: CrawlConfig, own: str | None = None) -> list[str]:
    """The next pages that speak of contact, of the seed's host ``own``; by default, of the page's."""
    from contactloom.functions.html import read_page

    host = lambda u: (urlsplit(u).hostname or "").rstrip(".").removeprefix("www.")
    most = config.max_pages - 1 if config.strict_limit else max(config.max_pages - 1, 1)
    found: dict[str, None] = {}
    read = read_page(page, url)
    for e in read["elements"]:
        target = e["url"] if e["tag"] == "a" else None
        if not target or urlsplit(target).scheme not in ("http", "https") or host(target) != (host(url) if own is None else own):
            continue
        shown = f"{urlsplit(target).path.lower()} {read['buffer'][e['start'] : e['end']].lower()}"
        plain = target.split("#")[0].split("?")[0]
        if any(t in shown for t in dims.CONTACT_TERMS) and plain != url:
            found[plain] = None
    return list(found)[:most]


class _Visit:
    """A host's pages, fetched one after another; ``step`` does the next one and says whether there is another."""

    def __init__(self, host: str, url: str, rules: list | None, config: CrawlConfig, transport: Callable):
        self.host, self.seed, self.config, self.transport = host, url, config, transport
        self.robots = _Robots(config, transport, {} if rules is None else {robots.origin(url): rules})
        self.rows: list[tuple] = []
        self.left: list[tuple[int, str]] = [(0, url)]

    def step(self) -> bool:
        number, url = self.left.pop(0)
        try:
            if self.robots.allow(url):
                final, page = _page(url, self.config, self.transport)
                self.rows.append((self.host, self.seed, number, final, page, None))
                if number == 0:
                    self.left = list(enumerate(contact_urls(page, final, self.config, self.host), 1))
            elif number == 0:
                raise PermissionError("disallowed by robots.txt")
        except Exception as e:  # whatever a site does is a row; when the main page is there, a further one may fail
            if number == 0:
                self.rows.append((self.host, self.seed, 0, url, None, " ".join(f"{type(e).__name__}: {e}".split())[:300]))
        return bool(self.left)


def visits(targets: Iterator[tuple[str, str, list | None]], config: CrawlConfig, transport: Callable) -> Iterator[list[tuple]]:
    """The rows of each host, as hosts are done. Up to ``hosts`` of them are open and ``slots`` requests run; a host waits ``delay`` before each of its
    pages, and others go on meanwhile, so a slow host holds one slot and nobody else."""
    from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

    ready: list[tuple[float, int, _Visit]] = []
    running: dict = {}
    opened = 0
    with ThreadPoolExecutor(config.slots) as pool:
        while True:
            while len(ready) + len(running) < config.hosts and (target := next(targets, None)) is not None:
                opened += 1
                heapq.heappush(ready, (time.monotonic() + config.delay, opened, _Visit(*target, config, transport)))
            if not ready and not running:
                return
            while ready and len(running) < config.slots and ready[0][0] <= time.monotonic():
                _, n, visit = heapq.heappop(ready)
                running[pool.submit(visit.step)] = (n, visit)
            pause = max(0.0, ready[0][0] - time.monotonic()) if ready and len(running) < config.slots else None
            if not running:
                time.sleep(pause or 0)
                continue
            for done in wait(running, pause, FIRST_COMPLETED).done:
                n, visit = running.pop(done)
                if done.result():
                    heapq.heappush(ready, (time.monotonic() + config.delay, n, visit))
                else:
                    yield visit.rows


_KINDS = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())


def page_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), _KINDS)], [x.split()[0] for x in PAGES.split(", ")])


def _crawl(config: CrawlConfig, transport: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def targets():
            for batch in batches:
                for row in batch.to_pylist():
                    yield row["host"], row["url"], None if row["rules"] is None else [(r["path"], r["allow"]) for r in row["rules"]]

        for rows in visits(targets(), config, transport):
            yield page_batch(rows)

    return run


def crawl(targets: DataFrame, config: CrawlConfig = CrawlConfig(), transport: Callable = fetch, rules: DataFrame | None = None) -> DataFrame:
    """(host, seed_url, page_no, page_url, html, error) of targets (host, url). A host is asked by one task; write the result before using it twice.

    ``rules``: a robots table (origin, rules). Origins that it doesn't have are asked by their host's task.
    """
    wanted = targets.select("host", "url")
    if rules is None:
        known = wanted.withColumn("rules", F.lit(None).cast(robots.RULES))
    else:
        known = wanted.withColumn("origin", robots.origin_of(F.col("url"))).join(rules.select("origin", "rules"), "origin", "left").select("host", "url", "rules")
    return known.repartition(config.partitions, F.col("host")).mapInArrow(_crawl(config, transport), PAGES)
