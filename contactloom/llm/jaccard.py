"""Exact similarity join of documents on their sets of word shingles.

Two documents link when 100 * |x & y| >= 80 * |x | y|; the result has each document's
connected component. The steps, none of which makes all pairs of a group:

1. *Sets.* Lower-cased words, distinct shingles of five, as 64-bit hashes. Equal sets are
   one from here on: their 64-bit fingerprint is the set's id, so copies cost nothing.
2. *Filter.* The first l elements that similar sets have in common, in any fixed order,
   lie in each one's first |x| - ceil(0.8 |x|) + l elements. Those, by hash order and with
   l = |x| / 10, are counted; a set of which fewer than l (of the smallest possible
   partner) occur in another set has no partner. Bit tables, whose size follows the counts up
   to 32 MiB, keep most shingles from being shuffled; what passes them is joined exactly.
3. *Index.* The remaining sets' shingles are ordered from rare to frequent. Shingles of one
   set only match nothing and come first; the prefix of the others is the index: lists of
   (set, size, position).
4. *Answers of a list's pivot.* Each list's most shared set is its pivot, and all sets of
   the list are compared with it. The links found make first components.
5. *Skipping.* A list falls into blocks by component, size and position. Pairs of sizes, and then of
   blocks, are skipped as a whole if they are of one component, if their sizes differ too much, or
   if what stands after their positions cannot reach the overlap. What remains gets its
   answers from the pivot's: with |x & p| and |y & p| known, |x & y| is at most the lesser
   of both plus the lesser of what x and y share outside p, which skips most pairs. Of those
   above that bound, a set that is highly similar to the pivot derives its answers from the
   pivot's by their short differences alone; only the others are compared whole.

Defined cases: null and empty texts have no shingles and link with nothing; fewer than five
words are one shingle; repeated rows each get their component; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.bits import bit_table, bits_for, passes
from contactloom.llm.components import components
from contactloom.llm.shared import materialized, unused
from contactloom.llm.textblocks import NONSPACE, Words, mix, slices

SHINGLE = 5
#: Two sets are similar from so many hundredths of their union on.
PERCENT = 80
#: Blocks of a list by size, between one size and the largest that can be similar to it.
FINE = 8


def _sets(part: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, ascending as signed numbers."""
    words = Words(part.column("text"), NONSPACE)
    hashes = words.windows(size).view(np.int64)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(hashes[a : b - size + 1])
        elif b > a:
            short = words.hash[a:b] * np.arange(3, 3 + b - a, dtype=np.uint64)
            yield mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)])).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _fingerprint(found: np.ndarray) -> int:
    once = mix(found.view(np.uint64) + np.uint64(len(found)))
    return int(mix(np.array([once.sum(dtype=np.uint64)])).view(np.int64)[0])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _slim(size: int, keys: tuple[str, ...] = ("doc_id",)):
    def run(batches):
        for part in slices(batches, "text"):
            sets = list(_sets(part, size))
            yield pa.record_batch([*map(part.column, keys), pa.array([len(x) for x in sets], pa.int64()), pa.array([_fingerprint(x) for x in sets], pa.int64())], [*keys, "n", "sid"])

    return run


def _least(n: int, percent: int) -> int:
    """The least number of elements that a set of n shares with a similar one."""
    return -(-percent * n // 100)


def _first_shared(n: int) -> int:
    return max(1, n // 10)


def _distinct(size: int, most: int, choose):
    """Rows of ``choose(set, id)`` for the sets that the task hasn't met yet; it remembers ``most`` of them."""

    def run(batches):
        met: set[int] = set()
        for part in slices(batches, "text"):
            ids, kept, counts = [], [], []
            for found in _sets(part, size):
                sid = _fingerprint(found)
                if not len(found) or sid in met:
                    continue
                if len(met) < most:
                    met.add(sid)
                chosen = choose(found, sid)
                if chosen is not None and len(chosen):
                    ids.append(sid), kept.append(chosen), counts.append(len(found))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), _lists(kept)], ["sid", "n", "tokens"])

    return run


def _probe(percent: int, shared=None):
    def choose(found: np.ndarray, sid: int) -> np.ndarray:
        probe = found[: len(found) - _least(len(found), percent) + _first_shared(len(found))]
        return probe if shared is None else probe[passes(shared.value, probe)]

    return choose


def _alive(shared):
    def choose(found: np.ndarray, sid: int) -> np.ndarray | None:
        return found if passes(shared.value, np.array([sid]))[0] else None

    return choose


def _similar(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n + m - overlap)


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with their sizes and the exact size of their intersection."""
    left = sets.select(F.col("sid").alias("x"), F.col("n").alias("n_x"), F.col("tokens").alias("t_x"))
    right = sets.select(F.col("sid").alias("y"), F.col("n").alias("n_y"), F.col("tokens").alias("t_y"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "n_x", "n_y", F.size(F.array_intersect("t_x", "t_y")).cast("long").alias("overlap"))


def _derived(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The same for pairs (x, y, pivot, o_y) whose x is similar to the pivot, from ``o_y``, the answer of pivot and y.

    |x & y| = |p & y| + |(x less p) & y| - |(p less x) & y|, and the differences of similar sets are short.
    """
    own = sets.select(F.col("sid").alias("x"), F.col("n").alias("n_x"), F.col("tokens").alias("t_x"))
    pivot = sets.select(F.col("sid").alias("pivot"), F.col("tokens").alias("t_p"))
    steps = pairs.select("x", "pivot").distinct().join(own, "x").join(pivot, "pivot").select("x", "pivot", "n_x", F.array_except("t_x", "t_p").alias("more"), F.array_except("t_p", "t_x").alias("less"))
    other = sets.select(F.col("sid").alias("y"), F.col("n").alias("n_y"), F.col("tokens").alias("t_y"))
    of_y = lambda c: F.size(F.array_intersect(c, "t_y"))
    return pairs.join(steps, ["x", "pivot"]).join(other, "y").select("x", "y", "n_x", "n_y", (F.col("o_y") + of_y("more") - of_y("less")).cast("long").alias("overlap"))


def links(texts: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the ids of different sets; enough of them to connect all that are similar."""
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    kind = "sid long, n long, tokens array<long>"
    met = 1 << 20
    probes = texts.mapInArrow(_distinct(size, met, _probe(percent)), kind).select("sid", F.explode("tokens").alias("token"))
    shared = materialized(probes.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("token"), "shared")
    table = share(bit_table(shared.select(F.col("token").alias("key")), bits_for(shared.count())))
    again = texts.mapInArrow(_distinct(size, met, _probe(percent, table)), kind).select("sid", "n", F.explode("tokens").alias("token"))
    partner = F.greatest(F.lit(1), F.floor(F.ceil(percent * F.col("n") / 100) / 10))  # _first_shared of the smallest partner
    # tasks may have met the same set: count its shingles once. Dealt by set first, so that a token in very many sets is a join that can be split
    alive = again.join(shared, "token").repartition("sid").groupBy("sid", "token").agg(F.max("n").alias("n")).groupBy("sid").agg(F.count("*").alias("found"), F.max("n").alias("n")).where(F.col("found") >= partner).select("sid")
    alive = materialized(alive, "alive")
    near = share(bit_table(alive.select(F.col("sid").alias("key")), bits_for(alive.count())))
    sets = texts.mapInArrow(_distinct(size, met, _alive(near)), kind).join(alive, "sid", "left_semi")
    sets = materialized(sets.groupBy("sid", "n").agg(F.first("tokens").alias("tokens")), "sets")

    # rare first: frequencies among the sets that remain
    tokens = sets.select("sid", "n", F.explode("tokens").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(frequent, "token").groupBy("sid").agg(F.max("n").alias("n"), F.count("*").alias("s"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    ordered = ordered.where(100 * F.col("s") >= percent * F.col("n"))
    room = F.col("s") - F.ceil(percent * F.col("n") / 100) + 1  # the prefix, less the shingles that no other set has
    index = ordered.select("sid", "n", "s", F.posexplode(F.slice("tokens", F.lit(1), room.cast("int"))).alias("k", "entry"))
    index = materialized(index.select(F.col("entry.token").alias("token"), "sid", "n", "s", (F.col("n") - F.col("s") + F.col("k") + 1).alias("pos")), "index")

    pivots = index.groupBy("token").agg(F.count("*").alias("c"), F.max(F.struct((F.col("s") * 1000000 / F.col("n")).cast("long").alias("r"), "sid", "n")).alias("p")).where("c > 1").select("token", F.col("p.sid").alias("pivot"), F.col("p.n").alias("n_p"))
    to_pivot = index.join(pivots, "token").where((F.col("sid") != F.col("pivot")) & _sizes_fit(F.col("n"), F.col("n_p"), percent)).select(F.col("pivot").alias("x"), F.col("sid").alias("y")).distinct()
    known = materialized(_overlaps(to_pivot, sets), "known")
    linked = _similar(F.col("overlap"), F.col("n_x"), F.col("n_y"), percent)
    first = known.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = materialized(components(first), "first")

    seen = known.select(F.col("x").alias("pivot"), F.col("y").alias("sid"), "overlap", linked.alias("near"))
    entries = index.join(pivots.select("token", "pivot"), "token").where("sid <> pivot").join(seen, ["pivot", "sid"], "left")
    entries = entries.join(found.select(F.col("node").alias("sid"), "root"), "sid", "left").select("token", "sid", "n", "s", (F.col("n") - F.col("pos")).alias("rest"), "pivot", "overlap", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("root", "sid").alias("comp"))
    entries = entries.withColumn("fine", F.floor(F.log("n") / F.log(F.lit(100 / percent)) * FINE)).withColumn("rest_block", F.floor(F.log2(F.col("rest") + 1)))
    mixed = entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    entries = materialized(entries.join(mixed, "token", "left_semi"), "entries")
    blocks = entries.groupBy("token", "comp", "fine", "rest_block").agg(F.max("rest").alias("rest"), F.max("s").alias("s"), F.min("n").alias("n"))
    l, r = ({c: F.col(f"{side}.{c}") for c in entries.columns} for side in "lr")

    def reach(most: Column) -> Column:
        return (100 + percent) * most >= percent * (l["n"] + r["n"])

    possible = reach(1 + F.least(l["rest"], r["rest"])) & reach(F.least(l["s"], r["s"]))
    # first whole sizes of a list are skipped, a few dozen of them however many sets there are; then blocks meet by token and both sizes, keys that a join can split on
    whole = blocks.groupBy("token", "fine").agg(F.max("rest").alias("rest"), F.max("s").alias("s"), F.min("n").alias("n"))
    sizes = whole.alias("l").join(whole.alias("r"), (l["token"] == r["token"]) & (F.abs(l["fine"] - r["fine"]) <= FINE + 1) & possible).select(l["token"].alias("token"), l["fine"].alias("fine"), r["fine"].alias("fine_r"))
    left, right = blocks.join(sizes, ["token", "fine"]).alias("l"), blocks.alias("r")
    kept = left.join(right, (l["token"] == r["token"]) & (F.col("l.fine_r") == r["fine"]) & (l["comp"] < r["comp"]) & possible)
    kept = kept.select(l["token"].alias("token"), *(x[c].alias(f"{c}_{side}") for side, x in (("l", l), ("r", r)) for c in ("comp", "fine", "rest_block")))
    ours = entries.join(kept.withColumnsRenamed({f"{c}_l": c for c in ("comp", "fine", "rest_block")}), ["token", "comp", "fine", "rest_block"])
    through = F.coalesce(F.least(l["overlap"], r["overlap"]) + F.least(l["s"] - l["overlap"], r["s"] - r["overlap"]), l["s"])
    meets = (l["token"] == r["token"]) & (F.col("l.comp_r") == r["comp"]) & (F.col("l.fine_r") == r["fine"]) & (F.col("l.rest_block_r") == r["rest_block"])
    # of each pair, x is the one that is similar to the pivot, if one is: its answers then follow from the pivot's
    turned = F.when(l["near"], F.struct(l["sid"].alias("x"), r["sid"].alias("y"), r["overlap"].alias("o_y"))).otherwise(F.struct(r["sid"].alias("x"), l["sid"].alias("y"), l["overlap"].alias("o_y")))
    met_pairs = ours.alias("l").join(entries.alias("r"), meets & _sizes_fit(l["n"], r["n"], percent) & possible & reach(through)).select((l["near"] | r["near"]).alias("near"), l["pivot"].alias("pivot"), turned.alias("p")).select((F.col("near") & F.col("p.o_y").isNotNull()).alias("derived"), "pivot", "p.*")
    pairs = met_pairs.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.max(F.struct("derived", "x", "y", "pivot", "o_y")).alias("p")).select("p.*")
    pairs = materialized(pairs, "pairs")
    overlaps = _derived(pairs.where("derived"), sets).unionByName(_overlaps(pairs.where("NOT derived").select("x", "y"), sets))
    second = overlaps.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return materialized(first.unionByName(second), "links")


def similar_groups(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim = materialized(texts.mapInArrow(_slim(size), "doc_id long, n long, sid long"), "slim")
    known = texts.where("text IS NOT NULL").select("text")
    edges = links(known, size=size, percent=percent)
    least = slim.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    roots = components(edges).select(F.col("node").alias("sid"), "root")
    member = least.join(roots, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.join(lowest, "root").select("sid", "component_id")
    none = slim.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return slim.where("n > 0").join(of, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(none)


def one_of_each(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one row of each component: that of the least doc_id, null ids last.

    Of rows with that id in one component, any texts, one stays. Rows without shingles link with
    nothing and stay, but of those that repeat both id (null too) and text one stays.
    """
    tag = unused(docs, "_row")
    tagged = materialized(docs.withColumn(tag, F.monotonically_increasing_id()), "tagged")
    texts = tagged.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(tag).alias("row"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    slim = materialized(texts.mapInArrow(_slim(size, ("doc_id", "row", "digest")), "doc_id long, row long, digest long, n long, sid long"), "slim")
    roots = components(links(texts.where("text IS NOT NULL").select("text"), size=size, percent=percent))
    least = slim.where("n > 0").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest", "row")).alias("first"))
    chosen = least.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first"))
    none = slim.where("n = 0").groupBy("doc_id", "digest").agg(F.min("row").alias(tag))
    kept = chosen.select(F.col("first.row").alias(tag)).unionByName(none.select(tag))
    return tagged.join(kept, tag, "left_semi").select(*docs.columns)


QUERY = "op4_jaccard_join"


def query(spark, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda k: array_to_string(list_slice(w, k, k + 4), ' '))) END AS s FROM words
), elements AS (SELECT doc_id, unnest(s) AS e FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * o >= 80 * (len(p.s) + len(q.s) - o)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION
  SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM sets JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) ON x = doc_id
"""
