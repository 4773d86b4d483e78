"""``python -m contactloom seeds.txt -o out``: crawl a seed list into flat leads, and resume.

The seeds are asked in rounds, in the order of the list, and each round's leads are saved before the next one
begins: a run that is stopped has lost one round at the most, and the next run asks only for the rest.
"""

from __future__ import annotations

import argparse
import datetime
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators import extract, store
from contactloom.schemas import FLAT_LEAD
from contactloom.sources.seeds import SeedError, read_seeds
from contactloom.sources.robots import RobotsTable
from contactloom.sources.web import CrawlConfig, crawl, fetch


def _positive(value: str) -> int:
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="contactloom", description="Public contacts of the sites of a seed list.")
    p.add_argument("seeds", help="a .txt file with one URL a line")
    p.add_argument("-o", "--output", default="leads", help="folder of the leads' CSV files")
    p.add_argument("--concurrency", type=_positive, default=6, help="hosts that are asked at the same time")
    p.add_argument("--timeout", type=float, default=20.0)
    p.add_argument("--delay", type=float, default=0.25)
    p.add_argument("--max-pages", type=_positive, default=3)
    p.add_argument("--max-bytes", type=_positive, default=2_000_000)
    p.add_argument("--limit", type=_positive)
    p.add_argument("--source", default="google dorks")
    p.add_argument("--default-country", default="EG")
    p.add_argument("--round", type=_positive, default=600, help="hosts that are asked before their leads are saved")
    p.add_argument("--user-agent", default=CrawlConfig.user_agent)
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--refresh", action="store_true", help="ask every host again")
    p.add_argument("--retry-errors", action="store_true", help="ask those again that failed")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--date", default=None, help="the date column's text; today by default")
    return p


def _csv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The leads of earlier runs; none where there is no folder yet. Empty fields are empty text."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], FLAT_LEAD)
    return spark.read.schema(FLAT_LEAD).option("header", True).option("multiLine", True).option("escape", '"').csv(path).fillna("")


def run(spark: SparkSession, args: argparse.Namespace, **options) -> int:
    seeds = read_seeds(spark, args.seeds)
    if args.limit:
        seeds = store.limited(seeds, args.limit)
    if args.dry_run:
        for r in seeds.orderBy("line_no").toLocalIterator():
            print(f"{r['host']}\t{r['url']}")
        print(f"\n{seeds.count()} unique domains")
        return 0
    history = read_history(spark, args.output)
    if args.refresh:
        todo = seeds
    else:
        todo = store.retry_pending(seeds, history) if args.retry_errors else store.pending(seeds, history)
    if todo.limit(1).count() == 0:
        print("Nothing to crawl; all selected domains are in the output.")
        return 0
    config = CrawlConfig(args.concurrency, args.timeout, args.delay, args.max_pages, args.max_bytes, not args.ignore_robots, user_agent=args.user_agent)
    base = args.output.rstrip("/")
    # what this run asks for stays the same while its output grows
    plan = f"{base}.run-{uuid.uuid4().hex}"
    store.numbered(todo.select("line_no", "url", "host"), "line_no", "index").withColumn("round", F.floor((F.col("index") - 1) / args.round).cast("int")).write.parquet(f"{plan}/targets")
    targets = spark.read.parquet(f"{plan}/targets")
    rounds = (targets.agg(F.max("round").alias("last")).first()["last"] or 0) + 1
    # leads that replace others go to a folder of their own until all are there; the old ones stay as they are until then
    replaces = args.refresh or args.retry_errors
    out = f"{plan}/leads" if replaces else args.output
    robots = RobotsTable(spark, f"{base}.robots")
    for k in range(rounds):
        own = targets.where(F.col("round") == k)
        rules = robots.refresh(own, config, options.get("transport") or fetch) if config.obey_robots else None
        crawl(own, config, rules=rules, **options).write.parquet(f"{plan}/pages-{k:06d}")
        pages = spark.read.parquet(f"{plan}/pages-{k:06d}")
        leads = extract.crawled(pages, as_of=args.date or datetime.date.today().isoformat(), source=args.source, default_country=args.default_country, order_col="page_no", url_col="page_url", host_col="host", website_col="seed_url", error_col="error")
        _csv(leads, out, "append")
        print(f"[{min((k + 1) * args.round, targets.count())}/{targets.count()}] saved", file=sys.stderr)
    if args.refresh:
        _csv(read_history(spark, out), args.output, "overwrite")
    elif args.retry_errors:
        _csv(store.replaced(history, read_history(spark, out)), f"{plan}/all", "overwrite")
        _csv(read_history(spark, f"{plan}/all"), args.output, "overwrite")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("contactloom").config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    try:
        return run(spark, args)
    except SeedError as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
