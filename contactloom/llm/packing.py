"""Packing documents into token sequences by order-preserving dynamic programming.

Documents stay in the order in which their task reads them. Windows may be cut after a
document (free), after a sentence (``SENTENCE`` tokens' worth) or, where a stretch without
sentence ends is long, anywhere on a grid (``WITHIN``). With c the place of a cut and W the
window, the least cost is

    f(j) = penalty(j) + min over c(j) - W <= c(i) < c(j) of f(i) + W - (c(j) - c(i))

and as W - c(j) is the same for all i, a queue of growing f(i) + c(i) gives each minimum
in constant time. A sequence whose length is a power of two needs no padding; near a
block's end, where the rest may be short, such lengths are tried as well, at ``SHORT``
tokens' worth each so that they stay few.

Each task packs blocks of about ``block_ids`` ids and holds one block at a time; a longer
document is a block of its own. Defined cases: a null or empty text is its end id alone;
repeated documents are packed again; other columns are left out; an empty table gives no
pieces. A task that runs again gives the same pieces under the same ids.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.dac import TEXT_SLICE
from contactloom.llm.textblocks import slices
from contactloom.llm.tokens import END_ID, encoder

WINDOW = 2048
SENTENCE, WITHIN, SHORT = 3, 10, 40
#: No stretch between two places for a cut is longer.
GRID = 32
BLOCK_IDS = 1 << 19


def places(total: int, documents: np.ndarray, sentences: np.ndarray, window: int = WINDOW, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Where a block of ``total`` ids may be cut, ascending, and what each cut costs; 0 and ``total`` are among them."""
    near_end = total - (1 << np.arange(max(1, (window - 1).bit_length())))
    # what each place costs; a byte a place, and none where no cut may be
    none = np.int8(-1)
    mark = np.full(total + 1, none, np.int8)
    mark[near_end[near_end > 0]] = WITHIN
    mark[sentences] = SENTENCE
    mark[documents] = 0
    mark[[0, total]] = 0
    at = np.flatnonzero(mark != none)
    more = (np.diff(at) - 1) // grid
    if more.any():
        long = np.flatnonzero(more)
        n = more[long]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        mark[np.repeat(at[long], n) + grid * step] = WITHIN
        at = np.flatnonzero(mark != none)
    return at, mark[at].astype(np.int64)


def cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """The best places to cut, from the first to the last."""
    places_, costs = at.tolist(), cost.tolist()
    n = len(places_)
    total = places_[-1]
    tail = total - 2 * window
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    index = {p: k for k, p in enumerate(places_) if p >= tail - window}
    best, chosen = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (f + place, place, index)
    for j in range(1, n):
        p = places_[j]
        least = p - window
        while queue[0][1] < least:
            queue.popleft()
        value, _, i = queue[0]
        value += window - p
        if p > tail:
            for power in powers:
                k = index.get(p - power)
                if k is not None and best[k] + SHORT < value:
                    value, i = best[k] + SHORT, k
        value += costs[j]
        best[j], chosen[j] = value, i
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    out, j = [n - 1], n - 1
    while j:
        j = chosen[j]
        out.append(j)
    return [places_[j] for j in reversed(out)]


def _pieces(names: list, offsets: np.ndarray, ids: np.ndarray, ends: np.ndarray, first_sequence: int, window: int) -> tuple[pa.RecordBatch, int]:
    at, cost = places(len(ids), offsets[1:-1], np.flatnonzero(ends[ids]) + 1, window)
    cut = np.asarray(cuts(at, cost, window))
    edges = np.unique(np.concatenate([cut, offsets]))
    start, end = edges[:-1], edges[1:]
    doc = np.searchsorted(offsets, start, "right") - 1
    sequence = np.searchsorted(cut, start, "right") - 1
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist())]
    columns = [names.take(pa.array(doc)), start - offsets[doc], end - start, crc, np.diff(offsets)[doc], sequence + first_sequence, start - cut[sequence]]
    return pa.record_batch([columns[0], *(pa.array(x, pa.int64()) for x in columns[1:])], COLUMNS), first_sequence + len(cut) - 1


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(path: str | None, end_id: int, window: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(path, end_id)
        ends = np.zeros(coder.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        ends[coder.sentence_ends()] = True
        sequence = TaskContext.get().partitionId() << 40
        names, held, sizes, n = [], [], [], 0
        for some in slices(batches, "text", TEXT_SLICE):
            ids, offsets = coder.encode(some.column("text"))
            at = 0
            while at < some.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_ids - n, "right")) - 1)
                names.append(some.column("doc_id").slice(at, to - at))
                held.append(ids[offsets[at] : offsets[to]])
                sizes.append(np.diff(offsets[at : to + 1]))
                n += len(held[-1])
                at = to
                if n >= block_ids or at < some.num_rows:
                    batch, sequence = _pieces(pa.concat_arrays(names), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(held), ends, sequence, window)
                    yield batch
                    names, held, sizes, n = [], [], [], 0
        if names:
            yield _pieces(pa.concat_arrays(names), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(held), ends, sequence, window)[0]

    return run


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW, block_ids: int = BLOCK_IDS, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: which ids of which document lie where in which sequence. No row is shuffled."""
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_pack(tokenizer, end_id, window, block_ids), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS[1:]))


QUERY = "op9_packing"


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
