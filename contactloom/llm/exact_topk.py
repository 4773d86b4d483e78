"""Exact top-k search: tiled products of queries and shards, lists merged in a tree.

Vectors become integers, floor(``SCALE`` * x). Queries go to all tasks in rounds of at most
``max_query_bytes``; a task goes over its shard of the candidates in tiles, multiplies each
block of queries with each tile, selects each query's best of the tile by a partial sort, and
merges them into its running lists. The tasks' lists then meet in a tree, ``FAN`` at a time,
until each query has one.

Scores equal the exact integers: products run in 32-bit floats where their sums stay under
2 ** 24, in 64-bit floats under 2 ** 53, else in Python integers, and a score beyond 64 bits
is held at that bound.

Defined cases: a vector that is null, or has a null or non-finite component, takes no part, nor
does a null id; vectors of other lengths than the query's are no candidates; an id that stands
in several rows is one query, with its least vector, and each of its rows is a candidate of
the others; ties go to the smaller id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.shared import materialized

SCALE, K = 256, 5
#: Bytes of query vectors (64-bit) that a round sends to each task.
MAX_QUERY_BYTES = 16 << 20
QUERY_BLOCK, TILE = 512, 2048
#: Lists of one query that are merged at a time.
FAN = 64
#: Levels of the tree; with as many tasks as FAN ** LEVELS, 262,144, no step holds more than FAN lists of a query.
LEVELS = 3


def integers(vectors: pa.Array, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of the usable vectors, by length: row numbers and a matrix of whole numbers as doubles."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    size = np.diff(ends)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = ~np.asarray(vectors.is_null()) & (bad[ends[1:]] == bad[ends[:-1]])
    out = []
    for n in np.unique(size[usable]):
        rows = np.flatnonzero(usable & (size == n))
        with np.errstate(over="ignore"):
            out.append((rows, np.floor(scale * flat[ends[rows][:, None] + np.arange(n)])))
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products, as 64-bit integers."""
    most = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) if np.isfinite(x) else (1 << 1100) * (1 if x > 0 else -1) for x in r] for r in m], object).reshape(m.shape)
    exact = whole(q) @ whole(c).T if q.shape[1] else np.zeros((len(q), len(c)), object)
    bound = (1 << 63) - 1
    return np.array([[min(max(int(x), -bound - 1), bound) for x in r] for r in exact], np.int64).reshape(exact.shape)


class TopLists:
    """The running lists of one group of queries of equal length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(ids), QUERY_BLOCK):
            n = len(ids[at : at + QUERY_BLOCK])
            self.lists.append((np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64), np.zeros((n, 0), bool)))

    def tile(self, ids: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, c = ids[order], c[order]
        k = self.k
        for b, at in enumerate(range(0, len(self.ids), QUERY_BLOCK)):
            own = self.ids[at : at + QUERY_BLOCK]
            scores = _products(self.q[at : at + QUERY_BLOCK], c)
            valid = ids[None, :] != own[:, None]
            n = len(ids)
            if n > k and np.abs(scores, dtype=np.float64).max(initial=0) < 1 << 50:
                # one number for score and place, so that a partial selection settles ties
                key = np.where(valid, scores * n + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
                some = np.argpartition(~key, k - 1, axis=1)[:, :k]
            else:
                some = np.broadcast_to(np.arange(n), scores.shape)
            s, i, v = np.take_along_axis(scores, some, 1), ids[some], np.take_along_axis(valid, some, 1)
            old_s, old_i, old_v = self.lists[b]
            s, i, v = (np.concatenate(x, 1) for x in ((old_s, s), (old_i, i), (old_v, v)))
            order_ = np.lexsort((i, ~s, ~v), axis=-1)[:, :k]  # ~s falls as s grows, for every 64-bit number
            self.lists[b] = tuple(np.take_along_axis(x, order_, 1) for x in (s, i, v))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, candidate and score of all lists."""
        out = []
        for b, at in enumerate(range(0, len(self.ids), QUERY_BLOCK)):
            s, i, v = self.lists[b]
            q = np.broadcast_to(self.ids[at : at + QUERY_BLOCK][:, None], s.shape)
            out.append((q[v], i[v], s[v]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _search(shared, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lists = {n: TopLists(ids, q, k) for n, (ids, q) in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                ids = part.column("vec_id").to_numpy()
                for rows, c in integers(part.column("vector"), scale):
                    if c.shape[1] in lists:
                        lists[c.shape[1]].tile(ids[rows], c)
        for found in lists.values():
            q, i, s = found.rows()
            yield pa.record_batch([pa.array(q), pa.array(i), pa.array(s), pa.array(np.full(len(q), TaskContext.get().partitionId() // FAN, np.int32))], ["query_id", "vec_id", "score", "branch"])

    return run


def _merged(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Each key's k best rows."""
    best = F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("order"), "vec_id", "score"))), 1, k)
    return rows.groupBy(*keys).agg(best.alias("best"))


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates of other ids."""
    spark = queries.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked, shards = pick(queries).where(whole).groupBy("vec_id").agg(F.min("vector").alias("vector")), pick(candidates)
    size = asked.agg(F.sum(F.size("vector") * 8 + 64).alias("n")).first()["n"] or 0
    rounds = -(-size // max_query_bytes)
    if not rounds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    done = []
    for r in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r).toArrow()
        ids = block.column("vec_id").to_numpy()
        groups = {m.shape[1]: (ids[rows], m) for rows, m in integers(block.column("vector").combine_chunks(), scale)} if block.num_rows else {}
        found = shards.mapInArrow(_search(spark.sparkContext.broadcast(groups), k, scale), "query_id long, vec_id long, score long, branch int")
        for _ in range(LEVELS - 1):
            found = _merged(found, ["query_id", "branch"], k).select("query_id", F.floor(F.col("branch") / FAN).cast("int").alias("branch"), F.inline("best"))
        merged = _merged(found, ["query_id"], k).select("query_id", F.posexplode("best").alias("at", "one"))
        result = merged.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "one.vec_id", "one.score")
        done.append(result if rounds == 1 else materialized(result, "topk"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def every(ids: Column, n: int) -> Column:
    """Whether an id is divisible by n."""
    return F.pmod(ids, F.lit(n)) == 0


QUERY = "op8_exact_topk"


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.where(every(F.col("vec_id"), 50)), vectors)


ORACLE = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
