"""The keyed store of leads: upserts, merges, look-ups, and the anti and semi joins of resumed runs.

A store is a table of leads with a number ``seq``. Incoming rows of one key are folded in the
order of ``seq`` before the join, so a batch does what its rows would have done one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.functions import emails, links
from contactloom.functions.folds import backfilled, distinct_by, fold_by, nonempty_text, specific_platform
from contactloom.functions.phones import number_identity
from contactloom.functions.text import first_nonempty, text_or_empty, utrim
from contactloom.schemas import LEAD, LEAD_FIELDS

ON_DUPLICATE = ("reject", "replace", "merge")


def _time(value: Column) -> Column:
    return F.try_to_timestamp(value)


def oldest(a: Column, b: Column) -> Column:
    """The text of the older time; of times that can't both be read, the first one that there is."""
    return F.when(_time(b) < _time(a), b).when(_time(a).isNotNull() & _time(b).isNotNull(), a).otherwise(first_nonempty(a, b))


def merged_phones(a: Column, b: Column) -> Column:
    return fold_by(F.filter(F.concat(a, b), lambda p: number_identity(p) != ""), number_identity, backfilled)


def merged_lead(old: Column, new: Column, now: Column) -> Column:
    """A lead of two of the same page; ``old`` and ``new`` are structs of a lead's fields."""
    social = fold_by(F.concat(old["social_links"], new["social_links"]), lambda s: s["url"], specific_platform)
    external = fold_by(F.concat(old["external_links"], new["external_links"]), lambda e: e["url"], nonempty_text)
    fields = {
        "id": old["id"],
        "page_title": first_nonempty(text_or_empty(new["page_title"]), text_or_empty(old["page_title"])),
        "source_url": first_nonempty(text_or_empty(old["source_url"]), text_or_empty(new["source_url"])),
        "hostname": first_nonempty(text_or_empty(new["hostname"]), text_or_empty(old["hostname"])),
        "captured_at": oldest(old["captured_at"], new["captured_at"]),
        "last_updated_at": now,
        "phones": merged_phones(old["phones"], new["phones"]),
        "whatsapp": merged_phones(old["whatsapp"], new["whatsapp"]),
        "emails": distinct_by(F.concat(old["emails"], new["emails"]), emails.email_key),
        "social_links": social,
        "external_links": links.external_without_social(external, social),
    }
    return F.struct(*(fields[f].alias(f) for f in LEAD_FIELDS))


#: The lists of a lead: what tells their elements apart in ``merged_lead``'s folds. Of elements alike in all of it, later ones change nothing.
_LISTS: dict[str, Callable[[Column], tuple[Column, ...]]] = {
    "phones": lambda p: (number_identity(p), p["source"], (text_or_empty(p["context"]) == "").cast("string")),
    "whatsapp": lambda p: (number_identity(p), p["source"], (text_or_empty(p["context"]) == "").cast("string")),
    "emails": lambda e: (emails.email_key(e),),
    "social_links": lambda s: (s["url"], (s["platform"] == "other").cast("string")),
    "external_links": lambda e: (e["url"], (text_or_empty(e["text"]) == "").cast("string")),
}


def _combined(batch: DataFrame, kind: str) -> DataFrame:
    """(source_url, n, first, all, earliest) of each key: ``all`` does in one merge what its rows would do in turn; no key's rows are gathered.

    ``earliest``: the earliest of its times that can be read; it counts for a lead whose own can be read too.
    """
    types = dict(batch.dtypes)
    nothing = {f: F.lit(None).cast(types[f].removeprefix("array<").removesuffix(">")) for f in _LISTS}

    def entries(f: str) -> Column:
        def one(x: Column, at: Column) -> Column:
            keys = [k.cast("string") for k in _LISTS[f](x)] + [F.lit(None).cast("string")] * 2
            return F.struct(F.lit(f).alias("list"), *(k.alias(f"k{j}") for j, k in enumerate(keys[:3])), at.alias("at"), F.struct(*((x if g == f else nothing[g]).alias(g) for g in _LISTS)).alias("value"))

        return F.transform(F.coalesce(f, F.array().cast(types[f])), one)

    exploded = batch.select("source_url", "seq", F.explode(F.concat(*map(entries, _LISTS))).alias("v")).select("source_url", "seq", "v.*")
    firsts = exploded.groupBy("source_url", "list", "k0", "k1", "k2").agg(F.min(F.struct("seq", "at", "value")).alias("x"))
    gathered = firsts.groupBy("source_url").agg(F.sort_array(F.collect_list(F.struct("list", "x"))).alias("found"))
    last = lambda c: F.max(F.when(text_or_empty(F.col(c)) != "", F.struct("seq", c)))[c]
    time = _time(F.col("captured_at"))
    earliest = F.min(F.when(time.isNotNull(), F.struct(time.alias("t"), "seq", "captured_at")))["captured_at"]
    named = F.min(F.when(text_or_empty(F.col("captured_at")) != "", F.struct("seq", "captured_at")))["captured_at"]
    lead = F.struct(*LEAD_FIELDS).cast(kind).alias("lead")
    whole = batch.groupBy("source_url").agg(F.count("*").alias("n"), F.min(F.struct("seq", lead)).alias("first"), last("page_title").alias("title"), last("hostname").alias("host"), earliest.alias("earliest"), F.when(_time(named).isNull(), named).otherwise(earliest).alias("captured"))
    of = lambda f: F.coalesce(F.transform(F.filter("found", lambda x: x["list"] == f), lambda x: x["x"]["value"][f]), F.array().cast(types[f]))
    fields = {"page_title": F.col("title"), "hostname": F.col("host"), "captured_at": F.col("captured"), **{f: of(f) for f in _LISTS}}
    both = whole.join(gathered, "source_url", "left")
    return both.select("source_url", "n", "first", "earliest", F.struct(*(fields.get(f, F.col(f"first.lead.{f}")).alias(f) for f in LEAD_FIELDS)).cast(kind).alias("all"))


def upsert(current: DataFrame, incoming: DataFrame, on_duplicate: str, now: str, top: int | None = None) -> DataFrame:
    """The store after a batch (both with ``seq``), with ``status``: kept, added, duplicate, replaced or merged.

    Keys that a batch repeats are folded in its order by the same rule. ``top``: the highest number so far, if ``current`` is a part of the store.
    """
    if on_duplicate not in ON_DUPLICATE:
        raise ValueError(f"on_duplicate is one of {ON_DUPLICATE}, not {on_duplicate!r}")
    lead = lambda: F.struct(*LEAD_FIELDS)
    kind = "struct<" + LEAD.replace(", ", ",").replace(" ", ":") + ">"
    batch = incoming.where(utrim("source_url") != "").withColumn("source_url", utrim("source_url"))
    # one row a key before the join, whatever the batch repeats
    row = F.struct("seq", lead().cast(kind).alias("lead"))
    first = F.min(row).alias("first")
    if on_duplicate == "reject":
        grouped = batch.groupBy("source_url").agg(first)
        alone, onto = F.col("first.lead"), F.col("old")
    elif on_duplicate == "replace":
        grouped = batch.groupBy("source_url").agg(first, F.max(row).alias("last"))
        alone, onto = (F.col("last.lead").withField("id", kept["id"]) for kept in (F.col("first.lead"), F.col("old")))
    else:
        grouped = _combined(batch, kind)
        start = F.col("first.lead")
        for f in _LISTS:
            start = start.withField(f, F.array().cast(dict(batch.dtypes)[f]))
    new = grouped.withColumnRenamed("source_url", "key").withColumn("first_seq", F.col("first.seq"))
    old = current.select(F.col("source_url").alias("old_key"), F.col("seq").alias("old_seq"), lead().cast(kind).alias("old"))
    both = old.join(new, F.col("old_key") == F.col("key"), "full_outer")
    if on_duplicate == "merge":
        # one merge for both: onto the stored lead, or onto the batch's first with empty lists
        both = both.withColumn("base", F.coalesce("old", start))
        named = F.col("all.captured_at")
        time = F.when(_time(F.col("base.captured_at")).isNotNull(), F.coalesce("earliest", named)).otherwise(named)
        merged = merged_lead(F.col("base"), F.col("all").withField("captured_at", time), F.lit(now)).cast(kind)
        result = F.when(F.col("key").isNull(), F.col("old")).when(F.col("old").isNull() & (F.col("n") == 1), F.col("first.lead")).otherwise(merged)
    else:
        result = F.when(F.col("key").isNull(), F.col("old")).when(F.col("old").isNull(), alone).otherwise(onto)
    status = F.when(F.col("key").isNull(), "kept").when(F.col("old").isNull(), "added").otherwise({"reject": "duplicate", "replace": "replaced", "merge": "merged"}[on_duplicate])
    if top is None:
        both = both.crossJoin(F.broadcast(current.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top"))))  # one number
    else:
        both = both.withColumn("top", F.lit(top))
    placed = both.select(result.alias("lead"), F.coalesce("old_seq", F.col("top") + 1 + F.col("first_seq")).alias("seq"), status.alias("status"))
    return placed.select("lead.*", "seq", "status")


def migrated(records: DataFrame) -> DataFrame:
    """Stored records with their links normalized again, and no profile among the external links."""
    social = links.normalized_social(F.col("social_links"))
    external = F.col("external_links")
    if dict(records.dtypes)["external_links"] == "array<string>":
        external = links.external_of_strings(external)
    rows = records.withColumn("social_links", social).withColumn("external_links", links.normalized_external(external))
    return rows.withColumn("external_links", links.external_without_social(F.col("external_links"), F.col("social_links")))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return migrated(spark.read.schema(f"{LEAD}, seq long").parquet(path))


def write_store(leads: DataFrame, path: str) -> None:
    """A new snapshot; a store is never overwritten while it is read."""
    leads.select(*LEAD_FIELDS, "seq").write.mode("errorifexists").parquet(path)


def delete(leads: DataFrame, lead_id: str) -> DataFrame:
    return leads.where(~F.col("id").eqNullSafe(F.lit(lead_id)))


def cleared(leads: DataFrame) -> DataFrame:
    return leads.limit(0)


def by_source_url(leads: DataFrame, url: str) -> DataFrame:
    """The first lead of exactly this page; none for a blank one."""
    return leads.where((F.col("source_url") == F.lit(url.strip())) & F.lit(bool(url.strip()))).orderBy("seq").limit(1)


def captured_flags(pages: DataFrame, leads: DataFrame, url_col: str = "url") -> DataFrame:
    """The pages with ``captured``: whether the store has a lead of exactly this URL; a blank one has none."""
    known = leads.select(F.col("source_url").alias("_known")).where("_known <> ''").distinct()
    return pages.join(known, utrim(F.col(url_col)) == F.col("_known"), "left").withColumn("captured", F.col("_known").isNotNull()).drop("_known")


def pending(seeds: DataFrame, history: DataFrame) -> DataFrame:
    """Seeds (host) whose host is not in the history (name)."""
    return seeds.join(history.select(F.col("name").alias("host")).distinct(), "host", "left_anti")


def failed(history: DataFrame) -> DataFrame:
    return history.where(F.contains(text_or_empty(F.col("notes")), F.lit("crawl_error:")))


def retry_pending(seeds: DataFrame, history: DataFrame) -> DataFrame:
    """Seeds whose last run failed."""
    return seeds.join(failed(history).select(F.col("name").alias("host")).distinct(), "host", "left_semi")


def replaced(history: DataFrame, recrawled: DataFrame) -> DataFrame:
    """The history with the recrawled hosts' rows in place of their old ones."""
    return history.join(recrawled.select("name").distinct(), "name", "left_anti").select(*recrawled.columns).unionByName(recrawled)


def limited(seeds: DataFrame, n: int) -> DataFrame:
    """The first n seeds of the list, before any of them is left out as done."""
    return seeds.orderBy("line_no").limit(n)


def first_per_host(seeds: DataFrame) -> DataFrame:
    """The first line of each host."""
    first = seeds.groupBy("host").agg(F.min_by(F.struct(*seeds.columns), F.col("line_no")).alias("row"))
    return first.select("row.*")


#: Rows that one task numbers.
_NUMBERED = 1 << 20


def numbered(rows: DataFrame, order: str = "seq", to: str = "index") -> DataFrame:
    """The rows with their place from 1 in the order of a whole number that tells them apart, gaps and jumps or not.

    They are numbered within blocks of that number, so no task has more than a block; only the blocks' counts meet in one task.
    """
    block = F.floor(F.col(order) / _NUMBERED)
    counts = rows.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    before = counts.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = rows.withColumn("_block", block).withColumn("_own", F.row_number().over(Window.partitionBy("_block").orderBy(order)))
    return own.join(before, "_block").withColumn(to, F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")
