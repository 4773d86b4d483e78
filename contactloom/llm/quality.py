"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words' counts in ``BUCKETS`` hash buckets (as a vector of length
one), statistics of its structure, standardised, and what ``metadata`` names: numeric columns
(their logarithm, standardised, and whether they are missing) and others (column and value,
hashed into the same buckets). The score adds to a linear model the interactions of all pairs
of features, through rank-``RANK`` factors V:

    sum over i < j of <V_i, V_j> x_i x_j = ((sum_i V_i x_i)^2 - sum_i (V_i x_i)^2) / 2, summed over the factors

which is linear in the number of features present. It is trained on the driver from a
bounded sample of labelled rows (``most`` of each class, about, each with at most ``BUCKETS``
numbers however long its text) and broadcast, with a size that no table changes.

Defined cases: a null or empty text is scored like a text without words; null, infinite or
not-a-number metadata is missing metadata; a table without usable labels gives every text the
score 0.5; repeated rows are scored alike, and count once in training; other columns are kept
by ``keep_good`` and left out by ``score``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.llm.learning import held_out, labelled_sample
from contactloom.llm.textblocks import NONSPACE, Words, slices

BUCKETS, RANK = 4096, 8
#: Rows of each class that training sees at the most, about.
SAMPLE = 2000
#: Texts that score less are rejected.
THRESHOLD = 0.3
#: Columns besides the text that the query and the pipeline look at.
METADATA = ("n_chars",)
#: The value of a metadata field that a row has.
_FIELD = 0.3

_CLASSES = [
    range(65, 91),  # upper case
    range(97, 123),  # lower case
    range(48, 58),  # digits
    range(128, 256),
    b" \t",
    b"\n",
    b"!",
    b"?",
    b".",
    b",;:",
    b"|",
    b"#$%&*",
    b"<>{}[]=/\\_",
    b"()\"'-",
]
_KIND = np.full(256, len(_CLASSES), np.int64)
for _k, _c in enumerate(_CLASSES):
    _KIND[list(_c)] = _k
_KINDS = len(_CLASSES) + 1
STATISTICS = _KINDS + 9


def statistics(words: Words) -> np.ndarray:
    """A row of structure statistics for each text."""
    n = len(words.offsets) - 1
    size = np.diff(words.offsets)
    out = np.zeros((n, STATISTICS))
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * _KINDS + _KIND[words.raw], minlength=n * _KINDS).reshape(n, _KINDS)
    out[:, :_KINDS] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    n_words = words.counts()
    length = words.end - words.start
    mean = lambda x: np.bincount(words.doc, x, minlength=n) / np.maximum(n_words, 1)
    stats = out[:, _KINDS:]
    stats[:, 0] = np.log1p(size)
    stats[:, 1] = np.log1p(n_words)
    stats[:, 2] = mean(length.astype(float))
    stats[:, 3] = mean((length > 20).astype(float))
    stats[:, 4] = mean((length == 1).astype(float))
    if len(words.hash):
        # each word's and each line's first copy in its text
        order = np.lexsort((words.hash, words.doc))
        h, d = words.hash[order], words.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        stats[:, 5] = np.bincount(d[new], minlength=n) / np.maximum(n_words, 1)
        four = words.windows(4)
        whole = words.doc[: len(four)] == words.doc[3:][: len(four)]
        order = np.lexsort((four[whole], words.doc[: len(four)][whole]))
        h, d = four[whole][order], words.doc[: len(four)][whole][order]
        new = np.ones(len(h), bool)
        if len(h):
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        stats[:, 6] = np.bincount(d[~new], minlength=n) / np.maximum(n_words, 1)
        last = words.raw[words.end - 1]
        stats[:, 7] = mean((_KIND[last] > 5).astype(float))
        first = words.raw[words.start]
        stats[:, 8] = mean((_KIND[first] == 0).astype(float))
    return out


def features(texts: pa.Array, numbers: pa.Array, fields: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: statistics, those of metadata last; and its words' and fields' buckets and values, with n + 1 offsets.

    ``numbers``: lists of equal length; ``fields``: lists of texts.
    """
    words = Words(texts, NONSPACE)
    n = len(words.offsets) - 1
    bucket = (words.hash % np.uint64(BUCKETS)).astype(np.int64)
    key, count = np.unique(words.doc * BUCKETS + bucket, return_counts=True)
    row, value = key // BUCKETS, np.log1p(count)
    value /= np.sqrt(np.maximum(np.bincount(row, value**2, minlength=n), 1e-9))[row]
    given = np.asarray(fields.value_lengths().fill_null(0)).astype(np.int64)
    if given.any():
        named = [xxhash.xxh64_intdigest(x or "") % BUCKETS for x in fields.flatten().to_pylist()]
        order = np.argsort(np.concatenate([row, np.repeat(np.arange(n), given)]), kind="stable")
        row = np.concatenate([row, np.repeat(np.arange(n), given)])[order]
        key = np.concatenate([key % BUCKETS, np.array(named, np.int64)])[order]
        value = np.concatenate([value, np.full(len(named), _FIELD)])[order]
    known = np.array(numbers.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)
    missing = ~np.isfinite(known)
    known = np.where(missing, 0.0, known)
    stats = np.concatenate([statistics(words), np.sign(known) * np.log1p(np.abs(known)), missing.astype(float)], 1)
    return stats, key % BUCKETS, value, np.searchsorted(row, np.arange(n + 1))


def _metadata(docs: DataFrame, names: tuple[str, ...]) -> tuple[Column, Column]:
    """The columns as lists of numbers, and of ``name=value`` of the others."""
    numeric = [c for c in names if isinstance(docs.schema[c].dataType, T.NumericType)]
    numbers = F.array(*(F.col(f"`{c}`").cast("double") for c in numeric)) if numeric else F.array().cast("array<double>")
    others = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in names if c not in numeric]
    return numbers, F.array(*others) if others else F.array().cast("array<string>")


class FactorisationMachine:
    def __init__(self, statistics: int = STATISTICS, seed: int = 1):
        rng = np.random.default_rng(seed)
        size = BUCKETS + statistics
        self.bias, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK))
        self.mean, self.scale = np.zeros(statistics), np.ones(statistics)

    def join(self, stats: np.ndarray, bucket: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, features and values of all texts' features."""
        n, m = stats.shape
        x = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        row = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.repeat(np.arange(n), m)])
        return row, np.concatenate([bucket, np.tile(BUCKETS + np.arange(m), n)]), np.concatenate([value, x.ravel()])

    def _sums(self, n: int, row, feature, value) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[feature] * value[:, None]
        s = np.stack([np.bincount(row, vx[:, k], minlength=n) for k in range(RANK)], 1)
        squares = np.bincount(row, (vx**2).sum(1), minlength=n)
        return self.bias + np.bincount(row, self.w[feature] * value, minlength=n) + ((s**2).sum(1) - squares) / 2, s, vx

    def score(self, n: int, row, feature, value) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._sums(n, row, feature, value)[0], -30, 30)))

    def fit(self, stats, bucket, value, first, label, weight, epochs: int = 25, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 2) -> FactorisationMachine:
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        rng = np.random.default_rng(seed)
        squares_w, squares_v = np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                size = np.diff(first)[some]
                place = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                row, feature, x = self.join(stats[some], bucket[place], value[place], np.concatenate([[0], np.cumsum(size)]))
                z, s, vx = self._sums(len(some), row, feature, x)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]) * weight[some] / weight[some].mean()
                self.bias -= rate * 0.1 * g.mean()
                gx = g[row] * x / len(some)
                grad_w = np.bincount(feature, gx, minlength=len(self.w)) + decay * self.w
                squares_w += grad_w**2
                self.w -= rate * grad_w / np.sqrt(squares_w)
                pull = gx[:, None] * (s[row] - vx)
                grad_v = np.stack([np.bincount(feature, pull[:, k], minlength=len(self.w)) for k in range(RANK)], 1) + decay * self.v
                squares_v += grad_v**2
                self.v -= rate * 0.2 * grad_v / np.sqrt(squares_v)
        return self


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        stats, bucket, value, first = features(*map(part.column, ("text", "numbers", "fields")))
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(kind)))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), stats.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.record_batch([part.column("key"), part.column("label"), part.column("weight"), rows, lists(bucket, np.int32), lists(value, np.float32)], ["key", "label", "weight", "stats", "bucket", "value"])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = SAMPLE, metadata: tuple[str, ...] = (), **columns) -> FactorisationMachine | None:
    """A machine, or None if one of the classes has no row to learn from. ``metadata``: columns of ``docs`` that it looks at as well."""
    numbers, fields = _metadata(docs, metadata)
    sample = labelled_sample(docs, labels, label, most, **columns, numbers=numbers, fields=fields)
    found = sample.mapInArrow(_featurize, "key long, label int, weight double, stats array<double>, bucket array<int>, value array<float>").toArrow()
    found = found.take(pa.array(np.argsort(found.column("key").to_numpy(), kind="stable")))  # Spark's order may change from run to run
    y = found.column("label").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    stats = found.column("stats").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    buckets = found.column("bucket").combine_chunks()
    first = np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy())])
    value = found.column("value").combine_chunks().flatten().to_numpy().astype(float)
    return FactorisationMachine(stats.shape[1]).fit(stats, buckets.flatten().to_numpy().astype(np.int64), value, first, y, found.column("weight").to_numpy())


def _scores(machine: FactorisationMachine | None, *columns: pa.Array) -> np.ndarray:
    return machine.score(len(columns[0]), *machine.join(*features(*columns))) if machine else np.full(len(columns[0]), 0.5)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.record_batch([part.column("doc_id"), pa.array(_scores(shared.value, *map(part.column, ("text", "numbers", "fields"))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, machine: FactorisationMachine | None, *, metadata: tuple[str, ...] = (), doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; no row is shuffled. ``metadata``: as in training."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    numbers, fields = _metadata(docs, metadata)
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"), numbers.alias("numbers"), fields.alias("fields"))
    return texts.mapInArrow(_score(shared), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, metadata: tuple[str, ...] = (), text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that score ``threshold`` or more; only texts and metadata go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, metadata=metadata, text_col=text_col, **options))

    @F.arrow_udf("double")
    def scored(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for some in columns:
            rows = pa.record_batch(list(some), ["text", "numbers", "fields"])
            yield pa.concat_arrays([pa.array(_scores(shared.value, *part.columns)) for part in slices([rows], "text")] or [pa.array([], pa.float64())])

    return docs.where(scored(F.col(f"`{text_col}`"), *_metadata(docs, metadata)) >= threshold)


QUERY = "op1_quality_classifier"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), metadata=METADATA), metadata=METADATA)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
