"""Benchmark decontamination: windows of test words, looked up in every training text.

``ngram_set`` turns the benchmark into windows. If the set's measured size is under
``max_broadcast_bytes`` each task gets it as a hash table, looks every window of its
documents up, verifies each hit word for word, and no row is shuffled. Of a larger set each
task gets a bit table of the windows' hashes, of a bounded size; the few windows that pass it
are joined with the set on their very words, and the hits are joined back to the documents'
rows, which are written with row tags first. Both ways give the same results.

Defined cases: a null or empty text has no words and is never contaminated; a null
item id or an item without words counts for nothing; repeated items count once; repeated
documents are judged row by row; other columns are ignored by ``scan`` and kept by
``remove``; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.bits import bit_table, bits_for, passes
from contactloom.llm.shared import materialized, unused
from contactloom.llm.textblocks import ALNUM, Words, slices

WINDOW = 13
#: Up to this size the window set is broadcast.
MAX_BROADCAST_BYTES = 32 << 20
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Tasks that a window, however many documents hold it, is dealt over in the join.
SALT = 16

_REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _item_windows(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"), ALNUM)
            out: list[tuple] = []
            for row, item in enumerate(part.column("item_id").to_pylist()):
                a, b = int(words.first[row]), int(words.first[row + 1])
                length = min(size, b - a)
                if length:
                    out += [(str(item), length, words.lowered(k, k + length)) for k in range(a, b - length + 1)]
            if out:
                item, length, text = zip(*dict.fromkeys(out))
                yield pa.record_batch([pa.array(item), pa.array(length, pa.int32()), pa.array(text, pa.binary())], ["item_id", "length", "words"])

    return make


def ngram_set(benchmark: DataFrame, size: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, words) of each distinct window of each item; ``words`` are lower-cased bytes with a blank between."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return items.where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_item_windows(size), "item_id string, length int, words binary").distinct()


class _Lookup:
    """The window set of one task: for each length, sorted hashes behind a bit table, the words to verify, the items."""

    BITS = 22

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        by: dict[int, dict[bytes, set[str]]] = {}
        for item, length, words in rows:
            by.setdefault(length, {}).setdefault(words, set()).add(item)
        self.tables = []
        for length, windows in sorted(by.items()):
            texts = list(windows)
            hashes = Words(pa.array([x.decode() for x in texts]), ALNUM).windows(length)[::length]  # a text has ``length`` words
            order = np.argsort(hashes)
            bits = np.zeros(1 << self.BITS, bool)
            bits[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.tables.append((length, bits, hashes[order], [texts[k] for k in order], [windows[texts[k]] for k in order]))

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str]]]:
        """First word, length and items of each window that occurs."""
        for length, bits, hashes, texts, items in self.tables:
            found = words.windows(length)
            at = np.flatnonzero(bits[(found >> np.uint64(64 - self.BITS)).astype(np.int64)])
            at = at[words.doc[at] == words.doc[at + length - 1]]
            k = np.searchsorted(hashes, found[at])
            k[k == len(hashes)] = 0
            same = hashes[k] == found[at]
            for w, x in zip(at[same].tolist(), k[same].tolist()):
                text = words.lowered(w, w + length)
                while x < len(hashes) and hashes[x] == found[w]:
                    if texts[x] == text:
                        yield w, length, items[x]
                        break
                    x += 1


class _Judged:
    """The hit words of some texts, and what is counted of them."""

    def __init__(self, lookup: _Lookup, texts: pa.Array):
        self.words = words = Words(texts, ALNUM)
        covered = np.zeros(len(words.hash) + 1, np.int64)
        self.items: dict[int, set[str]] = {}
        for w, length, which in lookup.hits(words):
            covered[w] += 1
            covered[w + length] -= 1
            self.items.setdefault(int(words.doc[w]), set()).update(which)
        self.hit = np.cumsum(covered[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(self.hit)])
        self.n_words, self.n_hit = words.counts(), sums[words.first[1:]] - sums[words.first[:-1]]
        self.contaminated = (self.n_hit > 0) & (ONE_IN * self.n_hit >= self.n_words)


def _without(words: Words, hit: np.ndarray, text: str, row: int) -> str:
    """The text without its hit words and what stands between them."""
    raw, base = text.encode(), int(words.offsets[row])
    out, at, inside = [], 0, False
    for k in range(int(words.first[row]), int(words.first[row + 1])):
        if hit[k] and not inside:
            out.append(raw[at : int(words.start[k]) - base])
        if not hit[k] and inside:
            at = int(words.start[k]) - base
        inside = bool(hit[k])
    return (b"".join(out) + (b"" if inside else raw[at:])).decode()


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(shared.value)
        for part in slices(batches, "text"):
            found = _Judged(lookup, part.column("text"))
            named = [sorted(found.items.get(k, ())) for k in range(part.num_rows)]
            columns = [pa.array(found.n_words, pa.int64()), pa.array(found.n_hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]), pa.array(found.contaminated)]
            yield pa.record_batch([part.column("doc_id"), *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def _window_set(benchmark: DataFrame, size: int, item_col: str, text_col: str, most: int):
    """The windows, and their broadcast rows if their measured size is at most ``most``."""
    grams = ngram_set(benchmark, size, item_col, text_col)
    measured = grams.agg(F.sum(F.octet_length("words") + F.octet_length("item_id") + 64).alias("n")).first()["n"] or 0
    if measured > most:
        return grams, None
    return grams, benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["length"], bytes(r["words"])) for r in grams.collect()])


def scan(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One report row a document."""
    grams, shared = _window_set(benchmark, size, item_col, item_text_col, max_broadcast_bytes)
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {_REPORT}"
    if shared:
        return texts.mapInArrow(_scan(shared), kind)
    tagged = _tagged(texts, "_row")
    found = tagged.select(F.col("_row").alias("row"), "doc_id").join(_joined(tagged.select(F.col("_row").alias("row"), "text"), grams), "row")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for length in sorted(set(batch.column("length").to_pylist())):
            part = batch.filter(pa.compute.equal(batch.column("length"), length))
            words = Words(part.column("words").cast(pa.string()), ALNUM)
            yield pa.record_batch([pa.array(words.windows(length)[::length].view(np.int64))], ["key"])


def _possible(lengths: list[int], shared):
    """The windows that pass the bit table, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"), ALNUM)
            for length in lengths:
                found = words.windows(length)
                at = np.flatnonzero(passes(shared.value, found.view(np.int64)))
                at = at[words.doc[at] == words.doc[at + length - 1]]
                doc = words.doc[at]
                yield pa.record_batch([part.column("row").take(pa.array(doc)), pa.array(at - words.first[doc]), pa.array(np.full(len(at), length, np.int32)), pa.array([words.lowered(k, k + length) for k in at.tolist()], pa.binary())], ["row", "at", "length", "words"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        yield pa.record_batch([part.column("row"), pa.array(Words(part.column("text"), ALNUM).counts(), pa.int64())], ["row", "n_words"])


def _joined(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """(row, n_words, n_hit, items, hits) of texts (row, text), by a join; ``hits``: (at, length) of the windows that occur, in order.

    ``texts`` must give the same rows whenever it is read.
    """
    n, lengths = grams.count(), sorted(r["length"] for r in grams.select("length").distinct().collect())
    table = texts.sparkSession.sparkContext.broadcast(bit_table(grams.select("length", "words").mapInArrow(_hashes, "key long"), bits_for(n)))
    possible = texts.mapInArrow(_possible(lengths, table), "row long, at long, length int, words binary")
    # the words decide, not their hash; only windows that occur are dealt over SALT tasks each
    occurs = possible.select("words").distinct().join(grams, "words").select("words", "item_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    found = possible.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(occurs, ["words", "salt"])
    places = found.groupBy("row", "at", "length").agg(F.lit(1).alias("one")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "length"))).alias("hits"))
    items = found.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    end = lambda x: x["at"] + x["length"]
    covered = F.aggregate("hits", start, lambda s, x: F.struct(F.greatest(s["end"], end(x)).alias("end"), (s["n"] + F.greatest(F.lit(0), end(x) - F.greatest(s["end"], x["at"]))).alias("n")), lambda s: s["n"])
    counted = texts.mapInArrow(_counted, "row long, n_words long")
    whole = counted.join(places.join(items, "row"), "row", "left")
    return whole.select("row", "n_words", F.coalesce(covered, F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "hits")


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))


def _tagged(docs: DataFrame, tag: str) -> DataFrame:
    """The rows with a number, written: a task that runs again reads the same numbers."""
    return materialized(docs.withColumn(tag, F.monotonically_increasing_id()), "tagged")


def remove(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", size: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The documents with all their columns: without the contaminated ones, or (``mode='spans'``) with the hit words cut out of every text."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    grams, shared = _window_set(benchmark, size, item_col, item_text_col, max_broadcast_bytes)
    text = F.col(f"`{text_col}`")
    if shared is None:
        tag, own = unused(docs, "_row"), unused(docs, "_hits")
        tagged = _tagged(docs, tag)
        found = _joined(tagged.select(F.col(tag).alias("row"), text.alias("text")), grams)
        if mode == "documents":
            return tagged.join(found.where(_contaminated()).select(F.col("row").alias(tag)), tag, "left_anti").select(*docs.columns)

        @F.arrow_udf("string")
        def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, hits in columns:
                out = []
                for one, places in zip(texts.to_pylist(), hits.to_pylist()):
                    words = Words(pa.array([one]), ALNUM)
                    hit = np.zeros(len(words.hash), bool)
                    for place in places:
                        hit[place["at"] : place["at"] + place["length"]] = True
                    out.append(_without(words, hit, one, 0))
                yield pa.array(out, pa.string())

        # only texts with hits go to Python
        hits = found.where("n_hit > 0").select(F.col("row").alias(tag), F.col("hits").alias(own))
        both = tagged.join(hits, tag, "left")
        bare = both.where(F.col(own).isNull()).select(*docs.columns)
        return bare.unionByName(both.where(F.col(own).isNotNull()).withColumn(text_col, cut(text, F.col(own))).select(*docs.columns))

    def judged(texts: Iterator[pa.Array], give) -> Iterator[pa.Array]:
        lookup = _Lookup(shared.value)
        for some in texts:
            yield pa.concat_arrays([give(_Judged(lookup, part.column("text")), part.column("text")) for part in slices([pa.record_batch([some], ["text"])], "text")] or [give(_Judged(lookup, some), some)])

    @F.arrow_udf("boolean")
    def contaminated(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from judged(texts, lambda found, _: pa.array(found.contaminated, pa.bool_()))

    @F.arrow_udf("string")
    def cleaned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from judged(texts, lambda found, own: pa.array([_without(found.words, found.hit, x, k) if found.n_hit[k] else x for k, x in enumerate(own.to_pylist())], pa.string()))

    return docs.where(~contaminated(text)) if mode == "documents" else docs.withColumn(text_col, cleaned(text))


QUERY = "op2_benchmark_decontamination"


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, k, k + least(13, len(w)) - 1) AS g
  FROM items, LATERAL unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS t(k) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM grams),
occurs AS (
  SELECT d.doc_id, k, s.n, list_slice(w, k, k + s.n - 1) AS g
  FROM lowered d, sizes s, LATERAL unnest(generate_series(1, len(w) - s.n + 1)) AS t(k)
), hits AS (SELECT o.doc_id, o.k, o.n, grams.item_id FROM occurs o JOIN grams ON o.n = grams.n AND o.g = grams.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL unnest(generate_series(k, k + n - 1)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
