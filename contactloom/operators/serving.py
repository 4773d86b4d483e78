"""A served copy of the store: leads in parts by time, for pages that seek, and posting lists of character trigrams, for searches that skip.

    leads/part=<k>/     leads from the newest to the oldest; the parts follow each other in that order
    parts               of each part: its number of leads, and its first lead's time and number
    postings            of each trigram and part: the numbers of the part's leads that hold it, sorted by trigram, so that a filter on it skips row groups
    grams               of each trigram: how many leads hold it

A page reads the one or two parts that its rows lie in, whichever page it is. A search takes the rarest trigrams of its terms, intersects their lists part
by part, reads the parts that are left, and lets ``views.search`` decide on their leads, so its rows are those of a full scan. What comes to the driver is
one row a part.

Defined cases: no terms find all leads; a search whose terms are all shorter than three characters reads every part; an empty store has no parts; a time that can't
be read counts as the oldest, as in ``views``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators import views
from contactloom.schemas import LEAD, LEAD_FIELDS
from contactloom.sources import folders

PART_ROWS = 100_000
#: Trigrams of a search that are looked up.
LOOKED_UP = 8
_KEPT = f"{LEAD}, seq long, ms long"
#: Characters of a part's texts whose trigrams are listed at once.
LISTED = 1 << 19
_LISTS = "gram string, part int, seqs array<long>"


def _listed(part: int, texts: list[str], seqs: list[int]) -> pa.RecordBatch:
    """Each trigram of the texts, once, with the numbers of those that hold it."""
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    codes = signs[:-2] << 42 | signs[1:-1] << 21 | signs[2:]
    whole = owner[:-2] == owner[2:]
    codes, owner = codes[whole], owner[:-2][whole]
    order = np.argsort(codes, kind="stable")  # a trigram's texts stay in order, so those alike are neighbours
    codes, owner = codes[order], owner[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    once = new.copy()
    once[1:] |= owner[1:] != owner[:-1]
    codes, owner, starts = codes[once], owner[once], np.flatnonzero(new[once])
    shown = np.stack([codes[starts] >> 42, codes[starts] >> 21 & 0x1FFFFF, codes[starts] & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), pa.array(np.array(seqs, np.int64)[owner]))
    return pa.record_batch([pa.array([shown[k : k + 3] for k in range(0, len(shown), 3)], pa.string()), pa.array([part] * len(starts), pa.int32()), lists], ["gram", "part", "seqs"])


def _posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, seq, text) to lists of neighbouring leads; those of one part and trigram are put together afterwards."""
    for batch in batches:
        own, texts, seqs, size = None, [], [], 0
        for part, seq, text in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "text"))):
            if texts and (part != own or size >= LISTED):
                yield _listed(own, texts, seqs)
                texts, seqs, size = [], [], 0
            own = part
            if len(text) >= 3:
                texts.append(text), seqs.append(seq)
                size += len(text)
        if texts:
            yield _listed(own, texts, seqs)


def build(leads: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Writes the copy of leads (with ``seq``)."""
    spark = leads.sparkSession
    # written once before they are ordered: finding the ranges reads all rows as well
    leads.select(*LEAD_FIELDS, "seq", views.captured_ms(F.col("captured_at")).alias("ms")).write.parquet(f"{path}/staged")
    rows = spark.read.schema(_KEPT).parquet(f"{path}/staged")
    parts = max(1, -(-rows.count() // part_rows))
    order = [F.desc("ms"), F.asc("seq")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("part").parquet(f"{path}/leads")
    kept = spark.read.schema(f"{_KEPT}, part int").parquet(f"{path}/leads")
    first = F.min(F.struct((-F.col("ms")).alias("older"), "seq"))
    kept.groupBy("part").agg(F.count("*").alias("n"), first.alias("first")).select("part", "n", (-F.col("first.older")).alias("ms"), F.col("first.seq").alias("seq")).coalesce(1).write.parquet(f"{path}/parts")
    # a part's leads are neighbours, so lists are shuffled, not trigrams
    held = kept.select("part", "seq", views.search_text().alias("text")).mapInArrow(_posting_lists, _LISTS)
    lists = held.groupBy("gram", "part").agg(F.sort_array(F.flatten(F.collect_list("seqs"))).alias("seqs"))  # at most part_rows numbers
    lists.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("seqs")).alias("n")).sort("gram").write.parquet(f"{path}/grams")
    folders.remove(spark, f"{path}/staged")


class Served:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.parts = [tuple(r) for r in spark.read.schema("part int, n long, ms long, seq long").parquet(f"{path}/parts").orderBy("part").collect()]

    def _read(self, parts: list[int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], f"{_KEPT}, part int")
        # folders by name: the others are not even listed
        return self.spark.read.schema(_KEPT).option("basePath", f"{self.path}/leads").parquet(*(f"{self.path}/leads/part={k}" for k in parts))

    def page(self, size: int = views.PAGE, number: int = 0) -> DataFrame:
        """The same rows as ``views.page``."""
        begin, end, at, some, skipped = size * number, size * (number + 1), 0, [], 0
        for part, n, _, _ in self.parts:
            if at + n <= begin:
                skipped = at + n
            elif at < end:
                some.append(part)
            at += n
        return self._read(some).orderBy(F.desc("ms"), F.asc("seq")).offset(max(0, begin - skipped)).limit(size).select(*LEAD_FIELDS, "seq")

    def after(self, ms: int, seq: int, size: int = views.PAGE) -> DataFrame:
        """The next leads behind one of this time and number, whatever has been added before it since."""
        behind = [k for k, (_, _, m, s) in enumerate(self.parts) if (-m, s) > (-ms, seq)]
        first = max(0, (behind[0] if behind else len(self.parts)) - 1)
        some, n = [], 0
        for k, (part, rows, _, _) in enumerate(self.parts[first:]):
            some.append(part)
            n += rows if k else 0  # the first one may end at that lead
            if n >= size:
                break
        rows = self._read(some).where((F.col("ms") < ms) | (F.col("ms") == ms) & (F.col("seq") > seq))
        return rows.orderBy(F.desc("ms"), F.asc("seq")).limit(size).select(*LEAD_FIELDS, "seq")

    def candidates(self, terms: str) -> DataFrame | None:
        """(part, seqs) of the leads that hold the terms' rarest trigrams; None if no term has one."""
        words = {w[k : k + 3] for w in terms.lower().split() for k in range(len(w) - 2)}
        if not words:
            return None
        known = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(sorted(words))).collect()
        if len(known) < len(words):  # one of them is nowhere
            return self.spark.createDataFrame([], "part int, seqs array<long>")
        chosen = [r["gram"] for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[:LOOKED_UP]]
        lists = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(chosen))
        both = lists.groupBy("part").agg(F.collect_list("seqs").alias("lists")).where(F.size("lists") == len(chosen))
        common = F.aggregate(F.slice("lists", 2, len(chosen)), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        return both.select("part", common.alias("seqs")).where(F.size("seqs") > 0)

    def search(self, terms: str) -> DataFrame:
        """The same rows as ``views.search``."""
        found = self.candidates(terms)
        if found is None:
            rows = self._read([x[0] for x in self.parts])
        else:
            parts = [r["part"] for r in found.select("part").collect()]
            rows = self._read(parts).join(found.select(F.explode("seqs").alias("seq")), "seq", "left_semi")
        return views.search(rows, terms).select(*LEAD_FIELDS, "seq")
