"""Token files in directly addressable codes.

A block holds the ids of some documents: a directory of document ids and starts, and
the ids as levels of 8-bit chunks. Level 0 has the low chunk of every id; a bit for each
chunk says whether the id goes on in the next level, and a directory of ranks (set bits
before every 512th) finds its place there. Any id is read by one look at each of its
levels, without decoding its neighbours.

``write`` deals documents into ranges of doc_id, encodes each range in order, and writes
blocks as rows of a Parquet table (bytes in a column, the block's doc_ids in another), so that
any store that Spark writes to will do and a lost task is simply run again. ``read`` gives the
documents back, ``look_up`` single tokens.

Defined cases: a null or empty text has only the end id; a null doc_id comes first;
repeated doc_ids stand one after the other; other columns are left out; an empty table
gives a table without blocks. A document lies in one block: blocks close after
``block_ids`` ids, and only a longer document makes a larger one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.shared import folder, temporary
from contactloom.llm.textblocks import slices
from contactloom.llm.tokens import END_ID, encoder

MAGIC = b"DACTOK1\n"
RANK_EVERY = 512
BLOCK_IDS = 1 << 18
#: Bytes of text that are tokenized at a time.
TEXT_SLICE = 1 << 20
_HEAD = struct.Struct("<8sQQI")


def encode_block(doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """``offsets``: n + 1 places in ``ids``."""
    levels, left = [], ids.astype(np.uint32)
    while not levels or len(left):
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(left) // RANK_EVERY) * RANK_EVERY, np.int64)
        padded[: len(left)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_EVERY).sum(1))]).astype("<u4")
        levels.append((len(left), (left & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        left = left[more] >> 8
    known = np.packbits([x is not None for x in doc_ids], bitorder="little").tobytes()
    parts = [_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(levels)), known, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), offsets.astype("<u8").tobytes()]
    for n, chunks, bits, ranks in levels:
        parts += [struct.pack("<QI", n, len(ranks) // 4), chunks, bits, ranks]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """One block's bytes, opened for reading; ``whole``: their checksum is verified first, which reads all of them."""

    def __init__(self, data: bytes, whole: bool = True):
        if data[:8] != MAGIC or whole and zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole block of this format")
        _, self.n_docs, self.n_ids, n_levels = _HEAD.unpack_from(data)
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known = np.unpackbits(take("u1", -(-self.n_docs // 8)), bitorder="little")
        self.doc_ids = [int(x) if k else None for x, k in zip(take("<i8", self.n_docs), known)]
        self.offsets = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n, n_ranks = struct.unpack_from("<QI", data, at)
            at += 12
            self.levels.append((take("u1", n), take("u1", -(-n // 8)), take("<u4", n_ranks)))

    def _rank(self, level: int, at: int) -> int:
        """Set bits before ``at``."""
        _, bits, ranks = self.levels[level]
        whole = at // RANK_EVERY
        rest = bits[whole * RANK_EVERY // 8 : at // 8 + 1]
        return int(ranks[whole]) + int(np.unpackbits(rest, bitorder="little")[: at - whole * RANK_EVERY].sum())

    def __getitem__(self, at: int) -> int:
        """The id at any place, from one chunk of each of its levels."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        out = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[at]) << 8 * level
            if not bits[at >> 3] >> (at & 7) & 1:
                break
            at = self._rank(level, at)
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range, which takes a contiguous range of every level."""
        out, places = np.zeros(stop - start, np.uint32), np.arange(stop - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[start >> 3 : -(-stop // 8)], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            places = places[more]
            if not len(places):
                break
            start = self._rank(level, start)
            stop = start + len(places)
        return out


def _encode(path: str | None, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), encoder(path, end_id)
        docs: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        block, before, n = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, sizes, block, before, n
            data = encode_block(docs, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(held))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([n]), pa.array([docs], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["part", "block", "ids_before", "n_ids", "docs", "data"])
            docs, held, sizes, block, before, n = [], [], [], block + 1, before + n, 0
            return row

        for some in slices(batches, "text", TEXT_SLICE):
            ids, offsets = coder.encode(some.column("text"))
            names, at = some.column("doc_id").to_pylist(), 0
            while at < len(names):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_ids - n, "right")) - 1)
                docs += names[at:to]
                held.append(ids[offsets[at] : offsets[to]])
                sizes.append(np.diff(offsets[at : to + 1]))
                n += len(held[-1])
                at = to
                if n >= block_ids or at < len(names):
                    yield flush()
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, doc_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the table of blocks, in the order of doc_id from one part to the next."""
    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_encode(tokenizer, end_id, block_ids), "part int, block int, ids_before long, n_ids long, docs array<long>, data binary").write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column("base").to_pylist(), batch.column("data")):
            block = Block(data.as_py())
            starts, step = block.offsets, 4096
            for k in range(0, block.n_docs, step):
                to = min(k + step, block.n_docs)
                ids = block.ids(int(starts[k]), int(starts[to]))
                cuts = starts[k : to + 1] - starts[k]
                pieces = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.record_batch([pa.array(block.doc_ids[k:to], pa.int64()), pa.array(starts[k:to] + base), pa.array(np.diff(cuts)), pa.array(pieces, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _decode(batches):
        crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
        yield pa.record_batch([*batch.columns[:3], crc], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _blocks(spark, path: str) -> DataFrame:
    """The blocks with the number of ids before each; only the parts' sums, one number a part, pass the driver."""
    blocks = spark.read.schema("part int, block int, ids_before long, n_ids long, data binary").parquet(path)
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = [], 0
    for part, n in parts:
        bases.append((part, total))
        total += n
    at = spark.createDataFrame(bases, "part int, part_base long")
    # one row a part, and no more parts than spark.sql.shuffle.partitions: the blocks stay where they are
    return blocks.join(F.broadcast(at), "part").select((F.col("part_base") + F.col("ids_before")).alias("base"), "data")


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document; ``ids`` are little-endian 32-bit numbers."""
    return _blocks(spark, path).mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids binary")


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, block, places = None, None, {}
    for batch in batches:
        out: list[tuple] = []
        for part, number, doc, at, data in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "doc_id", "position", "data"))):
            if data is not None:
                now, block, places = (part, number), Block(data, whole=False), {}
                for k, d in enumerate(block.doc_ids):
                    places.setdefault(d, []).append(k)
                continue
            if (part, number) != now:
                raise ValueError(f"no block {number} of part {part}")
            for k in places.get(doc, ()):
                start, size = int(block.offsets[k]), int(block.offsets[k + 1] - block.offsets[k])
                if 0 <= at < size:
                    out.append((doc, at, block[start + at]))
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "position", "id"])


def look_up(spark, path: str, wanted: DataFrame, *, doc_col: str = "doc_id", position_col: str = "position") -> DataFrame:
    """(doc_id, position, id) of single tokens (doc_id, position from 0), without decoding what stands around them.

    A place that no document has gives no row; a doc_id that several documents share gives one row each. A task holds one block at a
    time and takes the requests for it one after the other.
    """
    blocks = spark.read.parquet(path)
    asked = wanted.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(position_col).cast("long").alias("position"))
    of = blocks.select("part", "block", F.explode("docs").alias("doc_id")).distinct().join(asked, "doc_id")
    requests = of.select("part", "block", "doc_id", "position", F.lit(None).cast("binary").alias("data"))
    held = blocks.join(of.select("part", "block").distinct(), ["part", "block"], "left_semi").select("part", "block", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("position"), "data")
    both = held.unionByName(requests).repartition("part", "block").sortWithinPartitions("part", "block", F.col("data").isNull())
    return both.mapInArrow(_look_up, "doc_id long, position long, id long")


QUERY = "op6_token_files"


def query(spark, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    temporary(spark, path)
    return _blocks(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
