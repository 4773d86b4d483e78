"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability is a logistic function of the weights of its distinct features: its
words, and their beginnings of ``STEMS`` bytes, in ``BUCKETS`` hash buckets. A document's is
the noisy-or of its sentences, 1 - product of (1 - p), and the weights follow from the
documents' labels alone:

* a bucket counts if at least ``LEAST`` documents of label 1 hold it, one of ``LIFTS`` times as often
  as chance would have it, so that a model doesn't learn its training texts by heart;
* a share ``DOUBT`` of the labels may be wrong, so that no label is explained at any price;
* the lift, the shrinkage, and the probability from which on a document counts as toxic, are those of
  the best F1 over folds within the training rows. Scores are shifted (as log odds) so that
  this probability becomes ``THRESHOLD``.

The model is trained on the driver from a bounded sample of labelled rows (``SAMPLE`` rows of
each class, about, of at most ``ROW_BYTES`` bytes each: no more than 40 KB of features a row)
and broadcast, with a size that no table changes. Every text is scored whole. ``offending``
gives the sentences that carry a document's score.

Words are runs of letters and digits in lower case. Defined cases: a null or empty text has no
sentence and scores 0; a table without usable labels gives every text the score 0; repeated
rows are scored alike, and count once in training; other columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.learning import held_out, labelled_sample
from contactloom.llm.textblocks import ALNUM, LOWER, Words, mix, slices

BUCKETS = 1 << 17
#: Rows of each class that training sees at the most, about, and the longest text among them.
SAMPLE, ROW_BYTES = 4000, 1 << 14
THRESHOLD = 0.5
#: Bytes of a word's beginnings that are features besides the word.
STEMS = (4, 5, 6, 7)
LEAST, LIFTS, DOUBT = 3, (1.5, 3.0, 5.0), 0.02
#: Shrinkages that are tried, over so many folds.
SHRINK, INNER = (3e-5, 1e-4), 3
#: How much F1 a lower threshold, which finds more, may cost.
SLACK = 0.01
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True


class Sentences:
    """The sentences of all texts: ``doc`` of each, and each one's distinct feature buckets by ``row``.

    ``live``: the buckets that count; others are left out.
    """

    def __init__(self, texts: pa.Array, live: np.ndarray | None = None):
        words = Words(texts, ALNUM)
        # a sentence ends where a stop stands between two words, or the text ends
        stops = np.concatenate([[0], np.cumsum(_STOPS[words.raw])])
        begins = np.ones(len(words.hash), bool)
        if len(begins):
            begins[1:] = (stops[words.start[1:]] > stops[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1])
        self.words, self.first = words, np.flatnonzero(begins)
        self.doc = words.doc[self.first]
        sentence = np.cumsum(begins) - 1
        keys = []
        for at, hashed in self._features():
            bucket = (hashed % np.uint64(BUCKETS)).astype(np.int64)
            if live is not None:
                kept = live[bucket]
                at, bucket = at[kept], bucket[kept]
            keys.append(sentence[at] * BUCKETS + bucket)
        key = np.unique(np.concatenate(keys))
        self.row, self.bucket = key // BUCKETS, key % BUCKETS

    def _features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words, and a hash of each; first of the words, then of the beginnings of longer ones."""
        words = self.words
        at = np.arange(len(words.hash))
        yield at, words.hash
        length, hashed = words.end - words.start, np.zeros(len(at), np.uint64)
        for k in range(max(STEMS)):
            some = length[at] > k + 1
            at, hashed = at[some], hashed[some]
            hashed = (hashed + LOWER[words.raw[words.start[at] + k]] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            if k + 1 in STEMS:
                yield at, mix(hashed + np.uint64(k))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class NoisyOr:
    """``bias`` and weights ``w``; ``limit``: the probability that a score of ``THRESHOLD`` stands for."""

    def __init__(self):
        self.bias, self.w, self.limit = -6.0, np.zeros(BUCKETS), 0.5

    def sentences(self, n: int, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bias + np.bincount(row, self.w[bucket], minlength=n))

    @staticmethod
    def documents(n: int, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
        return -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)) + 0.0

    def scores(self, p: np.ndarray) -> np.ndarray:
        """Probabilities, shifted; 0 stays 0."""
        odds = p / np.maximum(1 - p, 1e-12) * ((1 - self.limit) / self.limit)
        return odds / (1 + odds)

    def fit(self, n: int, doc, row, bucket, label, weight, shrink: float, steps: int = 60, rate: float = 0.3) -> NoisyOr:
        """Full gradient steps, scaled by each weight's own history; small weights shrink to nothing."""
        squares, m = np.full(BUCKETS, 1e-8), len(doc)
        weight = weight / weight.sum()
        bias_squares, sure = 1e-8, 1 - DOUBT
        for _ in range(steps):
            p = self.sentences(m, row, bucket)
            whole = np.clip(self.documents(n, doc, p), 1e-9, 1 - 1e-9)
            rest = 1 - whole
            pull = np.where(label == 1, -sure * rest / (DOUBT + sure * whole), sure * rest / (DOUBT + sure * rest)) * weight
            g = pull[doc] * p
            grad = np.bincount(bucket, g[row], minlength=BUCKETS)
            squares += grad**2
            step = rate / np.sqrt(squares)
            moved = self.w - step * grad
            self.w = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
            bias_squares += g.sum() ** 2
            self.bias -= rate * 0.3 * g.sum() / np.sqrt(bias_squares)
        return self


def telling(of: np.ndarray, bucket: np.ndarray, label: np.ndarray, weight: np.ndarray, lift: float = LIFTS[0]) -> np.ndarray:
    """The buckets that count; (``of``, ``bucket``): the distinct buckets of documents. Documents of weight 0 take no part."""
    used = weight[of] > 0
    of, bucket = of[used], bucket[used]
    good = label[of] == 1
    seen = np.bincount(bucket, weight[of], minlength=BUCKETS)
    hits, weighed = np.bincount(bucket[good], minlength=BUCKETS), np.bincount(bucket[good], weight[of[good]], minlength=BUCKETS)
    return (hits >= LEAST) & (weighed > lift * (weight * label).sum() / weight.sum() * (seen + 1))


def best_limit(label: np.ndarray, weight: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """The best F1 that a limit gives, and the lowest limit that is as good but for ``SLACK``."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum((weight * label)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * label).sum())
    ends = np.flatnonzero(np.append(p[order][1:] < p[order][:-1], True))  # a limit lies between different values
    k = ends[np.flatnonzero(f1[ends] >= f1[ends].max() - SLACK).max()]
    after = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(f1[ends].max()), float(np.clip(np.sqrt(max(p[order][k], 1e-9) * max(after, 1e-9)), 1e-6, 1 - 1e-6))


def learnt(n: int, doc, row, bucket, label, weight) -> NoisyOr:
    """A model of labelled documents in a fixed order; see the module's description."""
    pairs = np.unique(doc[row] * BUCKETS + bucket)
    of, found = pairs // BUCKETS, pairs % BUCKETS

    def fitted(used: np.ndarray, lift: float, shrink: float) -> tuple[NoisyOr, np.ndarray]:
        kept = telling(of, found, label, used, lift)[bucket]
        model = NoisyOr().fit(n, doc, row[kept], bucket[kept], label, used, shrink)
        return model, model.documents(n, doc, model.sentences(len(doc), row[kept], bucket[kept]))

    # each class is dealt over the folds by itself
    fold = np.empty(n, np.int64)
    for c in (0, 1):
        own = np.flatnonzero(label == c)
        fold[own] = np.arange(len(own)) % INNER
    chosen = (-1.0, 0.5, LIFTS[0], SHRINK[-1])
    for lift, shrink in product(LIFTS, SHRINK):
        p = np.zeros(n)
        for k in range(INNER):
            out = fold == k
            if (label[~out] == 1).any() and (label[~out] == 0).any():
                p[out] = fitted(np.where(out, 0.0, weight), lift, shrink)[1][out]
        f1, limit = best_limit(label, weight, p)
        chosen = max(chosen, (f1, limit, lift, shrink))
    model = fitted(weight, *chosen[2:])[0]
    model.limit = chosen[1]
    return model


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        found = Sentences(part.column("text"))
        n, m = part.num_rows, len(found.doc)
        of = np.searchsorted(found.doc, np.arange(n + 1))
        size = np.bincount(found.row, minlength=m)
        at = np.concatenate([[0], np.cumsum(size)])[of]
        lists = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32)))
        yield pa.record_batch([part.column("key"), part.column("label"), part.column("weight"), lists(size, of), lists(found.bucket, at)], ["key", "label", "weight", "sizes", "buckets"])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", most: int = SAMPLE, row_bytes: int = ROW_BYTES, **columns) -> NoisyOr | None:
    """A model, or None if one of the classes has no row to learn from."""
    sample = labelled_sample(docs, labels, label, most, row_bytes=row_bytes, **columns)
    found = sample.mapInArrow(_featurize, "key long, label int, weight double, sizes array<int>, buckets array<int>").toArrow()
    found = found.take(pa.array(np.argsort(found.column("key").to_numpy(), kind="stable")))  # Spark's order may change from run to run
    y = found.column("label").to_numpy().astype(np.int64)
    if not 0 < y.sum() < len(y):
        return None
    sizes = found.column("sizes").combine_chunks()
    size = sizes.flatten().to_numpy()
    doc = np.repeat(np.arange(len(y)), sizes.value_lengths().to_numpy())
    return learnt(len(y), doc, np.repeat(np.arange(len(size)), size), found.column("buckets").combine_chunks().flatten().to_numpy().astype(np.int64), y, found.column("weight").to_numpy())


def _judged(model: NoisyOr | None, live: np.ndarray | None, texts: pa.Array) -> tuple[Sentences, np.ndarray, np.ndarray]:
    """The texts' sentences, and the scores of sentences and texts."""
    found = Sentences(texts, live)
    n, m = len(texts), len(found.doc)
    if model is None:
        return found, np.zeros(m), np.zeros(n)
    p = model.sentences(m, found.row, found.bucket)
    return found, model.scores(p), model.scores(model.documents(n, found.doc, p))


def _score(shared, located: bool, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        live = model.w != 0 if model else np.zeros(BUCKETS, bool)
        for part in slices(batches, "text"):
            found, p, whole = _judged(model, live, part.column("text"))
            if not located:
                yield pa.record_batch([part.column("doc_id"), pa.array(whole)], ["doc_id", "score"])
                continue
            # the sentences that score enough; where only all of them together do, the best one
            bad = (p >= least) & (model is not None)
            first = np.searchsorted(found.doc, np.arange(part.num_rows + 1))
            some = np.concatenate([[0], np.cumsum(bad)])
            for k in np.flatnonzero((whole >= least) & (some[first[1:]] == some[first[:-1]]) & (first[1:] > first[:-1]) & (model is not None)):
                bad[first[k] + np.argmax(p[first[k] : first[k + 1]])] = True
            bad = np.flatnonzero(bad)
            last = np.concatenate([found.first[1:], [len(found.words.hash)]])[bad] - 1
            doc = found.doc[bad]
            start, end = found.words.start[found.first[bad]], found.words.end[last]
            text = [bytes(found.words.raw[a:b]).decode() for a, b in zip(start, end)]
            yield pa.record_batch([part.column("doc_id").take(pa.array(doc)), pa.array(bad - first[doc]), pa.array(p[bad]), pa.array(text, pa.string())], ["doc_id", "sentence", "score", "text"])

    return run


def _texts(docs: DataFrame, doc_col: str, text_col: str) -> tuple[DataFrame, str]:
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts, texts.schema["doc_id"].dataType.simpleString()


def score(docs: DataFrame, model: NoisyOr | None, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; no row is shuffled."""
    texts, kind = _texts(docs, doc_col, text_col)
    return texts.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), False, 0), f"doc_id {kind}, score double")


def offending(docs: DataFrame, model: NoisyOr | None, *, least: float = THRESHOLD, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence, score, text) of each sentence that scores ``least`` or more; ``sentence`` counts from 0.

    Where a document scores ``least`` though none of its sentences does, its best one is given, the first of equals.
    """
    texts, kind = _texts(docs, doc_col, text_col)
    return texts.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), True, least), f"doc_id {kind}, sentence long, score double, text string")


QUERY = "op7_toxicity"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
