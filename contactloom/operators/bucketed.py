"""A store of leads in buckets, with numbered versions: a batch rewrites the buckets that it touches and no other.

    base/data/<batch>/bucket=<k>/     leads of the bucket, by a hash of their URL
    base/manifest/version=<n>/        one small file: for each bucket, the batch whose files are its content

A batch writes its buckets first, in a folder of its own, and its manifest last. The manifest is one file, which appears by a rename: until then
readers see the version before, and a batch that is killed leaves nothing but a folder that no manifest names. A batch whose
version another one has committed meanwhile fails; one writer at a time is meant. What a batch reads and writes grows with the buckets that it touches, so ``buckets`` should be so many that one holds some thousands of
leads; the driver holds a manifest, a row a bucket.

Defined cases: rows without URL are left out, as in ``store.upsert``; an empty batch makes a version like the one before; a bucket without leads has no files;
any version that is not vacuumed can be read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions.text import utrim
from contactloom.operators import store
from contactloom.schemas import LEAD, LEAD_FIELDS
from contactloom.sources import folders

BUCKETS = 1024
_MANIFEST = "bucket int, batch string, leads long, top long"
#: The row of a manifest that is of no bucket: ``leads`` has the number of buckets, ``top`` the highest number that a lead ever had.
_HEAD = -1


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    top: int
    batches: dict[int, str]
    leads: dict[int, int]


class BucketedStore:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        """The store at ``base``; a new one if there is none yet. An old one keeps its number of buckets."""
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets
        if not self.versions():
            self._commit(Manifest(0, buckets, -1, {}, {}))
        self.buckets = self.manifest().buckets

    # --- versions ---

    def versions(self) -> list[int]:
        """Committed ones: those whose folder holds its file."""
        found = [x for x in folders.names(self.spark, f"{self.base}/manifest") if x.startswith("version=")]
        return sorted(int(x.split("=")[1]) for x in found if any(y.startswith("part-") for y in folders.names(self.spark, f"{self.base}/manifest/{x}")))

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.base}/manifest/version={version:012d}").collect()
        head = next(r for r in rows if r["bucket"] == _HEAD)
        own = [r for r in rows if r["bucket"] != _HEAD]
        return Manifest(version, head["leads"], head["top"], {r["bucket"]: r["batch"] for r in own}, {r["bucket"]: r["leads"] for r in own})

    def _commit(self, new: Manifest) -> int:
        rows = [(_HEAD, "", new.buckets, new.top)] + [(k, batch, new.leads[k], 0) for k, batch in sorted(new.batches.items())]
        path = f"{self.base}/manifest/version={new.version:012d}"
        if new.version in self.versions():
            raise FileExistsError(f"version {new.version} was committed by another batch")
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(path)
        return new.version

    # --- reading ---

    def _load(self, manifest: Manifest, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.base}/data/{batch}/bucket={k}" for k, batch in manifest.batches.items() if only is None or k in only]
        if not paths:
            return self.spark.createDataFrame([], f"{LEAD}, seq long")
        return self.spark.read.schema(f"{LEAD}, seq long").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self._load(self.manifest(version))

    def by_source_url(self, url: str) -> DataFrame:
        """The lead of exactly this page, from its bucket alone."""
        own = self.spark.range(1).select(self.bucket_of(F.lit(url.strip())).alias("k")).first()["k"]
        return store.by_source_url(self._load(self.manifest(), {own}), url)

    def bucket_of(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """(source_url, old, new) of the leads that differ between two versions; ``old`` is null for an added one, ``new`` for a deleted one."""
        before, after = self.manifest(since), self.manifest(until)
        other = {k for k in before.batches.keys() | after.batches.keys() if before.batches.get(k) != after.batches.get(k)}
        side = lambda manifest, name: self._load(manifest, other).select(F.col("source_url").alias(f"{name}_url"), F.struct(*LEAD_FIELDS).alias(name))
        both = side(before, "old").join(side(after, "new"), F.col("old_url") == F.col("new_url"), "full_outer")
        return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.coalesce("new_url", "old_url").alias("source_url"), "old", "new")

    # --- writing ---

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, set[int]]:
        """The batch's rows that have a URL, written once, and the buckets that they touch: as many numbers as there are buckets, at the most."""
        path = f"{self.base}/staged/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket_of(F.col("source_url"))).write.parquet(path)
        # a filter before the writing would evaluate the rules that give a URL once more
        staged = self.spark.read.parquet(path).where("source_url <> ''")
        return staged.drop("_bucket"), {r["_bucket"] for r in staged.select("_bucket").distinct().collect()}

    def _rewritten(self, old: Manifest, touched: set[int], rows: DataFrame, version: int) -> int:
        batch = uuid.uuid4().hex
        path = f"{self.base}/data/{batch}"
        if touched:
            dealt = rows.select(*LEAD_FIELDS, "seq", self.bucket_of(F.col("source_url")).alias("bucket")).repartition(F.col("bucket"))
            dealt.write.partitionBy("bucket").parquet(path)
            written = self.spark.read.schema(f"{LEAD}, seq long, bucket int").parquet(path)
            found = written.groupBy("bucket").agg(F.count("*").alias("n"), F.max("seq").alias("top")).collect()
        else:
            found = []
        kept = {k: x for k, x in old.batches.items() if k not in touched}
        leads = {k: old.leads[k] for k in kept} | {r["bucket"]: r["n"] for r in found}
        top = max([old.top, *(r["top"] for r in found)])
        return self._commit(Manifest(version, self.buckets, top, kept | {r["bucket"]: batch for r in found}, leads))

    def upsert(self, incoming: DataFrame, on_duplicate: str, now: str, version: int | None = None) -> int:
        """The version after a batch (with ``seq``, its own order). With ``version``, a batch that has been committed as that one before isn't done again."""
        old = self.manifest()
        if version is not None and version <= old.version:
            return version
        batch, touched = self._staged(incoming.withColumn("source_url", utrim("source_url")).select(*LEAD_FIELDS, "seq"))
        rows = store.upsert(self._load(old, touched), batch, on_duplicate, now, top=old.top)
        return self._rewritten(old, touched, rows, old.version + 1 if version is None else version)

    def delete(self, urls: DataFrame) -> int:
        """The version without the leads of these pages (``source_url``)."""
        old = self.manifest()
        gone, touched = self._staged(urls.select("source_url").where("source_url IS NOT NULL").distinct())
        touched &= set(old.batches)
        return self._rewritten(old, touched, self._load(old, touched).join(gone, "source_url", "left_anti"), old.version + 1)

    def clear(self) -> int:
        old = self.manifest()
        return self._commit(Manifest(old.version + 1, self.buckets, old.top, {}, {}))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the last ``keep`` versions and what none of these names; run it while no batch runs. Gives the removed folders."""
        versions = self.versions()
        named = {batch for v in versions[-keep:] for batch in self.manifest(v).batches.values()}
        gone = [f"{self.base}/manifest/version={v:012d}" for v in versions[:-keep]] + [f"{self.base}/data/{x}" for x in folders.names(self.spark, f"{self.base}/data") if x not in named]
        gone += [f"{self.base}/staged/{x}" for x in folders.names(self.spark, f"{self.base}/staged")]
        for path in gone:
            folders.remove(self.spark, path)
        return gone
