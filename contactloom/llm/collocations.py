"""Phrase collocations of each language, counted in arrays behind a minimal perfect hash.

1. Mappers count all phrases of up to ``max_words`` words into hashed buckets, arrays that stop at the least count wanted. A block of buckets is summed
   in one task, and what is left of it is a bit a bucket: whether it can hold a frequent phrase.
2. A phrase is a candidate if its own bucket and those of all phrases within it pass. No frequent phrase can be missed, as all that lies
   in it is at least as frequent. Candidates are made distinct by their text.
3. A minimal perfect hash gives each candidate a slot and keeps its 128-bit key there. Mappers look up the phrases of whole texts, verify the
   stored key, and ``bincount`` the slots; the arrays are summed as a tree.
4. A phrase's count and those of both sides of each of its cuts are read by slot.

One hash holds ``shard_keys`` candidates at the most, and is then broadcast (9 bytes a key, and 8 for its count). If more buckets than that pass, candidates travel
with what they count in their task and are summed where they are made distinct; the frequent ones are dealt to several hashes by their key, which keep a count a slot, and
cuts go to the tasks of their key's hash. So a phrase is shuffled once a task in either case, never once an occurrence. The number of buckets follows the texts' size up
to 2 ** ``MOST_BITS``; beyond it, more candidates pass than need be, and the counts stay exact.
A language's words are never gathered in one task: all keys hold the language, and ranking keeps a report's worth of rows of each part of a language.

Defined cases: a null text has no words, a null language is ``und``; null ids, repeated rows (counted each time) and further columns don't matter; an
empty table gives no rows. Keys are two hashes of 64 bits, the second of each word's first eight bytes and length: what is no candidate counts as one with a
chance of 2 ** -64. A task that gives candidates tells them apart by the first: n different phrases of a task lose one with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.perfect_hash import PerfectHash, build, part_of
from contactloom.llm.shared import materialized
from contactloom.llm.textblocks import LOWER, Words, byte_class, mix, slices, text_bytes

MAX_WORDS, LEAST, TOP = 3, 10, 2000
#: A longer phrase with this percentage of a phrase's count stands for it.
COVERS_PERCENT = 50
SCALE = 1_000_000
UNKNOWN = "und"
FEWEST_BITS, MOST_BITS = 16, 28
#: Keys of one hash, and of the parts that it is built in.
SHARD_KEYS, PART_KEYS = 6_000_000, 1 << 16
#: Arrays summed by one task of the tree, slots of a block, and bytes of text that a mapper looks at together.
FAN, BLOCK, SLICE = 64, 1 << 18, 1 << 20
#: Phrases of one group where several hashes are needed, and parts of a language when it is ranked.
GROUP_ROWS, RANK_PARTS = 2_000_000, 64
#: Keys of candidates that a task remembers as given.
GIVEN_KEYS = 2_000_000
#: Phrases that a task holds before it gives them, also if it counts them, and bytes of text for each group in which they are made distinct.
HELD_PHRASES, HELD_COUNTED, GROUP_BYTES = 1 << 18, 1 << 21, 4 << 20
#: Occurrences that a task holds before it gives their buckets.
HELD_KEYS = 1 << 23

_ENDS = byte_class(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
_INSIDE = byte_class(lambda b: b not in (0x20, 0x09) and not _ENDS[b])
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_STEP = np.random.default_rng(20240401).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Phrases:
    """The phrases of some texts: ``keys(size)`` and ``second(size)`` for each word as the first one, and where they ``stand``."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.words = words = Words(texts, _INSIDE)
        named = langs.dictionary_encode()
        codes = np.array([_lang_key(x) for x in named.dictionary.to_pylist()] or [0], np.uint64)
        self.lang_row = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = codes[self.lang_row][words.doc] if len(words.doc) else np.zeros(0, np.uint64)
        ends = np.cumsum(_ENDS[words.raw], dtype=np.int32)
        # no piece goes on into another text
        self.piece = ends[words.start] + words.doc if len(words.start) else np.zeros(0, np.int64)
        self.next = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.words.start)

    def keys(self, size: int) -> np.ndarray:
        found = self.words.windows(size)
        return mix(found + self.lang[: len(found)])

    def second(self, size: int, at: np.ndarray) -> np.ndarray:
        """Of the phrases that begin at these words: another 64 bits, from the words' first bytes and lengths."""
        if not len(self.next) and len(self):
            padded = np.concatenate([LOWER[self.words.raw], np.zeros(8, np.uint8)])
            eight = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))
            length = self.words.end - self.words.start
            self.next = mix((eight[self.words.start] & _HEAD[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _STEP[15]))
        total = self.lang[at] * _STEP[14]
        for k in range(size):
            total = total + self.next[at + k] * _STEP[k]
        return mix(total)

    def stand(self, size: int) -> np.ndarray:
        """Which words begin a phrase of this size within their piece."""
        n = max(0, len(self) - size + 1)
        return self.piece[:n] == self.piece[size - 1 :] if size > 1 else np.ones(n, bool)

    def texts(self, size: int, at: np.ndarray) -> pa.Array:
        """The phrases that begin at these words: lower case, a blank between words."""
        start = self.words.start[at[:, None] + np.arange(size)].ravel()
        length = (self.words.end - self.words.start)[at[:, None] + np.arange(size)].ravel()
        wide = length + 1  # each word and a blank; the last one's is cut off
        wide[size - 1 :: size] -= 1
        to = np.cumsum(wide)
        source = np.repeat(start - (to - wide), wide) + np.arange(to[-1] if len(to) else 0)
        out = LOWER[self.words.raw[np.minimum(source, len(self.words.raw) - 1)]]
        blank = np.ones(len(wide), bool)
        blank[size - 1 :: size] = False
        out[(to - 1)[blank]] = 0x20
        offsets = np.concatenate([[0], to[size - 1 :: size]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out)))


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Phrases]]:
    for part in slices(batches, "text", SLICE):
        yield part, Phrases(part.column("text"), part.column("lang"))


# --- arrays: sparse blocks, summed as a tree ---


def _coded(block: np.ndarray) -> bytes:
    """Which slots hold anything, as bits, and what they hold; compressed."""
    import zstandard

    held = block != 0
    return zstandard.ZstdCompressor(level=1).compress(np.int32(len(block)).tobytes() + np.packbits(held).tobytes() + block[held].tobytes())


def _decoded(raw: bytes, dtype: str) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    held = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), 4), count=n).view(bool)
    block = np.zeros(n, dtype)
    block[held] = np.frombuffer(raw, dtype, offset=4 + -(-n // 8))
    return block


def _blocks(array: np.ndarray, kind: int, part: int) -> Iterator[pa.RecordBatch]:
    """The blocks of an array that hold anything."""
    for k in range(0, len(array), BLOCK):
        some = array[k : k + BLOCK]
        if some.any():
            some = some if array.dtype == np.uint8 else some.astype("<i8")
            yield pa.record_batch([pa.array([kind], pa.int32()), pa.array([k // BLOCK]), pa.array([part]), pa.array([_coded(some)], pa.binary())], ["kind", "block", "part", "counts"])


_BLOCKS = "kind int, block long, part long, counts binary"
_NO_BLOCKS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int64()), ("counts", pa.binary())])


def _tree_sum(blocks: DataFrame, dtype: str, most: int | None, finish: Callable[[np.ndarray], bytes] = _coded) -> DataFrame:
    """(kind, block, part, counts) with one row a block: sums of at most ``FAN`` arrays, level by level; sums stop at ``most``, the last level's are ``finish``ed."""

    def add(give: Callable[[np.ndarray], bytes]):
        def run(table: pa.Table) -> pa.Table:
            total = None
            for raw in table.column("counts"):
                some = _decoded(raw.as_py(), dtype)
                total = some if total is None else total + some
                if most is not None:
                    total = np.minimum(total, most).astype(dtype)
            one = table.slice(0, 1)
            return pa.table([one.column("kind"), one.column("block"), one.column("part"), pa.array([give(total)], pa.binary())], ["kind", "block", "part", "counts"])

        return run

    now = blocks
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN)
        now = now.withColumn("part", F.expr(f"part div {FAN}")).groupBy("kind", "block", "part").applyInArrow(add(_coded if parts > 1 else finish), _BLOCKS)
        if parts == 1:
            return now


def _put(totals: np.ndarray, block: int, counts: bytes) -> None:
    some = _decoded(bytes(counts), totals.dtype)
    totals[block * BLOCK : block * BLOCK + len(some)] = some


def _gathered(sums: DataFrame, size: int) -> np.ndarray:
    """The counts of one hash's slots, on the driver: ``SHARD_KEYS`` numbers at the most, whatever the texts' size."""
    found = np.zeros(size, "<i8")
    for row in sums.collect():
        _put(found, row["block"], row["counts"])
    return found


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


# --- candidates ---


def _bits(size: int, bits: int) -> int:
    """There are fewer different words than phrases."""
    return bits - 2 if size == 1 else bits


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, most of them small: their first bytes, then their second ones, and so on; compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _buckets(sizes: list[int], bits: int, least: int):
    """(kind, block, gaps, times): of each block of a size's buckets, the gaps between those that hold phrases, and how many up to ``least``."""

    def given(size: int, key: np.ndarray) -> pa.RecordBatch:
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=key[:1] + 1)) if len(key) else np.zeros(0, np.int64)
        times = np.minimum(np.diff(first, append=len(key)), least)
        at = key[first].astype(np.int64)
        begin = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
        gaps = np.diff(at, prepend=0)
        gaps[begin] = at[begin] % BLOCK
        edges = np.append(begin, len(at)).tolist()
        parts = list(zip(edges[:-1], edges[1:]))
        return pa.record_batch([pa.array(np.full(len(begin), size, np.int32)), pa.array(at[begin] // BLOCK), pa.array([_planes(gaps[a:b]) for a, b in parts], pa.binary()), pa.array([_planes(times[a:b]) for a, b in parts], pa.binary())], ["kind", "block", "gaps", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {size: [] for size in sizes}, 0
        for _, found in _phrases(batches):
            for size in sizes:
                held[size].append((found.keys(size)[found.stand(size)] & np.uint64((1 << _bits(size, bits)) - 1)).astype(np.uint32))
                n += len(held[size][-1])
            if n >= HELD_KEYS:
                for size in sizes:
                    yield given(size, np.concatenate(held.pop(size)))
                held, n = {size: [] for size in sizes}, 0
        for size, some in held.items():
            if some:
                yield given(size, np.concatenate(some))

    return run


def _passing_bits(least: int):
    """A bit a bucket of a block, from what its tasks held: whether it reaches ``least``."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint32)
        for gaps, times in zip(table.column("gaps"), table.column("times")):
            at = np.cumsum(_numbers(gaps.as_py()), dtype=np.int64)
            total[at] = np.minimum(total[at] + _numbers(times.as_py()), least)
        return pa.table([table.column("kind").slice(0, 1), table.column("block").slice(0, 1), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["kind", "block", "bits"])

    return run


class _Passing:
    """Where phrases begin whose own bucket and those of all phrases within them pass."""

    def __init__(self, found: Phrases, tables: dict[int, np.ndarray], bits: int):
        self.at: dict[int, np.ndarray] = {}
        ok = np.ones(0, bool)
        for size, table in sorted(tables.items()):
            stand = found.stand(size)
            good = stand & (ok[:-1] & ok[1:])[: len(stand)] if size > 1 else stand
            at = np.flatnonzero(good)
            key = found.keys(size)[at]
            place = key & np.uint64((1 << _bits(size, bits)) - 1)
            some = (table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            ok = np.zeros(len(stand), bool)
            self.at[size] = at[some]
            ok[self.at[size]] = True
            setattr(self, f"key{size}", key[some])


def _sorted_blobs(lang: str, phrases: pa.Array, group: np.ndarray, times: np.ndarray | None) -> pa.RecordBatch:
    """(group, lang, blob, times): each group's phrases, sorted, a line each, compressed; and how often each of them occurs, by planes of bytes."""
    import pyarrow.compute as pc
    import zstandard

    coder = zstandard.ZstdCompressor(level=1)
    order = pc.sort_indices(phrases).to_numpy()
    order = order[np.argsort(group[order], kind="stable")]
    group = group[order]
    raw, offsets = text_bytes(pc.binary_join_element_wise(phrases.take(pa.array(order)), "", "\n"))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    rows = np.append(first, len(group)).tolist()
    edges = offsets[rows].tolist()
    blobs = [coder.compress(raw[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
    counts = [None] * len(blobs)
    if times is not None:
        ordered = times[order]
        counts = [_planes(ordered[a:b]) for a, b in zip(rows[:-1], rows[1:])]
    return pa.record_batch([pa.array(group[first]), pa.array([lang] * len(blobs), pa.string()), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["group", "lang", "blob", "times"])


class _Given:
    """The candidates of a task, each as often as it must be: once for all that is held, or once a task if they aren't counted."""

    def __init__(self, groups: int, counted: bool):
        self.groups, self.counted = groups, counted
        self.known, self.texts, self.times, self.n = np.zeros(0, np.uint64), {}, [], 0

    def add(self, keys: np.ndarray, at: np.ndarray, size: int, found: Phrases, langs: list[str]) -> None:
        once, first, times = np.unique(keys, return_index=True, return_counts=True)
        if self.counted:
            self.times.append((once, times))
            # keys of a slice are held again with their times
            self.n += len(once) // 4
        if len(self.known):
            new = self.known[np.minimum(np.searchsorted(self.known, once), len(self.known) - 1)] != once
            once, first = once[new], first[new]
        at = at[first]
        self.known = once if len(self.known) > GIVEN_KEYS and not self.counted else np.concatenate([self.known, once])
        self.known.sort(kind="stable")
        code = found.lang_row[found.words.doc[at]]
        for k, lang in enumerate(langs):
            own = np.flatnonzero(code == k)
            if len(own):
                self.texts.setdefault(lang, []).append((found.texts(size, at[own]), once[own]))
                self.n += len(own)

    def give(self, all_of: bool = False) -> Iterator[pa.RecordBatch]:
        """What is held, if that is enough or the last."""
        if self.n < (HELD_COUNTED if self.counted else HELD_PHRASES) and not all_of:
            return
        totals = None
        if self.counted and self.times:
            keys = np.concatenate([k for k, _ in self.times])
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
            sums = np.add.reduceat(np.concatenate([t for _, t in self.times])[order], first) if len(first) else np.zeros(0, np.int64)
            totals = keys[order[first]], sums
        for lang, some in self.texts.items():
            keys = np.concatenate([k for _, k in some])
            times = totals[1][np.searchsorted(totals[0], keys)] if totals else None
            yield _sorted_blobs(lang, pa.concat_arrays([x for x, _ in some]), part_of(keys, self.groups), times)
        self.texts, self.times, self.n = {}, [], 0
        if self.counted:
            self.known = np.zeros(0, np.uint64)


def _candidates(shared, bits: int, groups: int, counted: bool):
    """The candidates, in blobs of each of a number of groups by their key, with their counts in the task if ``counted``; and, as group -1, each language's number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = _Given(groups, counted), {}
        for part, found in _phrases(batches):
            named = part.column("lang").dictionary_encode()
            langs = named.dictionary.to_pylist()
            for lang, n in zip(langs, np.bincount(found.lang_row, found.words.counts(), len(langs)).astype(np.int64).tolist()):
                words[lang] = words.get(lang, 0) + n
            passing = _Passing(found, shared.value, bits)
            for size, at in passing.at.items():
                held.add(getattr(passing, f"key{size}"), at, size, found, langs)
            yield from held.give()
        yield from held.give(all_of=True)
        totals = [n.to_bytes(8, "little") for n in words.values()]
        yield pa.record_batch([pa.array(np.full(len(words), -1)), pa.array(list(words), pa.string()), pa.nulls(len(words), pa.binary()), pa.array(totals, pa.binary())], ["group", "lang", "blob", "times"])

    return run


_MERGED = "lang string, phrase string, n long"


def _merged(table: pa.Table) -> pa.Table:
    """The distinct phrases of a group's blobs, which are of one language, with their counts if they have some; of group -1, a row with the number of words."""
    import zstandard

    lang = table.column("lang")[0].as_py()
    rows = lambda phrases, counts: pa.table([pa.array([lang] * len(counts), pa.string()), phrases, counts], ["lang", "phrase", "n"])
    if table.column("group")[0].as_py() < 0:
        return rows(pa.nulls(1, pa.string()), pa.array([sum(int.from_bytes(x.as_py(), "little") for x in table.column("times"))], pa.int64()))
    coder = zstandard.ZstdDecompressor()
    held = []
    for blob, times in zip(table.column("blob"), table.column("times")):
        raw = coder.decompress(blob.as_py())
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x0A) + 1
        lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(raw)])
        counts = pa.nulls(len(ends), pa.int64())
        if times.is_valid:
            counts = pa.array(_numbers(times.as_py()).astype(np.int64))
        held.append(pa.table([lines, counts], ["line", "n"]))
    found = pa.concat_tables(held).group_by("line", use_threads=False).aggregate([("n", "sum")]).sort_by("line")
    # a line ends with a line feed, which no phrase has
    raw, offsets = text_bytes(found.column("line"))
    lengths = np.diff(offsets)
    keep = np.ones(len(raw), bool)
    keep[offsets[1:] - 1] = False
    phrases = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths - 1)).astype(np.int32)), pa.py_buffer(raw[keep])])
    return rows(phrases.cast(pa.string()), found.column("n_sum").combine_chunks())


# --- counts ---


def _own_keys(batch: pa.RecordBatch) -> tuple[Phrases, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (lang, phrase): the number of words and both keys."""
    found = Phrases(batch.column("phrase"), batch.column("lang"))
    sizes, at = found.words.counts(), found.words.first[:-1]
    first, second = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        first[rows], second[rows] = found.keys(size)[at[rows]], found.second(size, at[rows])
    return found, sizes, first, second


def _shard(first: np.ndarray, shards: int) -> np.ndarray:
    return (mix(first + np.uint64(77)) % np.uint64(shards)).astype(np.int64)


def _keyed(shards: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "phrase", SLICE):
            _, _, first, second = _own_keys(part)
            yield pa.record_batch([pa.array(_shard(first, shards)), pa.array(part_of(first, parts)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), part.column("n")], ["shard", "part", "first", "second", "n"])

    return run


def _built(table: pa.Table) -> pa.Table:
    keys = [table.column(c).to_numpy().view(np.uint64) for c in ("first", "second")]
    counts = None if table.column("n").null_count else table.column("n").to_numpy()
    return pa.table([table.column("shard").slice(0, 1), table.column("part").slice(0, 1), pa.array([build(*keys, counts)], pa.binary())], ["shard", "part", "hash"])


def _assembled(rows, parts: int) -> PerfectHash:
    return PerfectHash({part: bytes(raw) for part, raw in rows}, parts)


class _Counter:
    """Adds slots up in one array, a block at a time: little more memory than the array itself."""

    def __init__(self, size: int):
        # a task's counts; the tree sums them in 64 bits
        self.total, self.held, self.n = np.zeros(size, np.uint32), [], 0

    def add(self, slots: np.ndarray) -> None:
        self.held.append(slots)
        self.n += len(slots)
        if self.n > 1 << 20:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.held:
            slots = np.concatenate(self.held)
            slots.sort()
            edges = np.arange(0, len(self.total) + BLOCK, BLOCK)
            at = np.searchsorted(slots, edges)
            for begin, a, b in zip(edges.tolist(), at[:-1].tolist(), at[1:].tolist()):
                if b > a:
                    own = self.total[begin : begin + BLOCK]
                    own += np.bincount(slots[a:b] - begin, minlength=len(own)).astype(np.uint32)
        self.held, self.n = [], 0
        return self.total


def _counted(tables, bits: int, hashed):
    """Counts by slot of the phrases of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: PerfectHash = hashed.value
        counter = _Counter(len(known))
        for _, found in _phrases(batches):
            passing = _Passing(found, tables.value, bits)
            for size, at in passing.at.items():
                slot = known.slots(getattr(passing, f"key{size}"), found.second(size, at))
                counter.add(slot[slot >= 0].astype(np.int32))
        yield from _blocks(counter.flush(), 0, _part())

    return run


def _with_hashes(rows: DataFrame, hashes: DataFrame, give: Callable, schema: str, salted_by: str) -> DataFrame:
    """``give(rows, hash parts)`` for groups of about ``GROUP_ROWS`` rows of one shard; rows of one key that differ in ``salted_by`` may go to several."""
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    salts = -(-most // GROUP_ROWS) or 1
    left = rows.withColumn("salt", F.pmod(F.xxhash64("first", salted_by), F.lit(salts)).cast("long"))
    right = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(give, schema)


def _read(known: PerfectHash, counts: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    slot = known.slots(first, second)
    return np.where(slot >= 0, counts[np.maximum(slot, 0)], 0) if len(counts) else np.zeros(len(slot), np.int64)


def _parts(max_words: int, shards: int):
    """For each phrase of two words or more, with its count ``a``: the keys of both sides of each cut k (parts 2k - 1 and 2k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "phrase", SLICE):
            found, sizes, _, _ = _own_keys(part)
            at = found.words.first[:-1]
            whole = {s: found.keys(s) for s in range(1, max_words)}
            for size in range(2, max_words + 1):
                rows = np.flatnonzero(sizes == size)
                own = [part.column(c).take(pa.array(rows)) for c in ("lang", "phrase", "n")]
                for number, begin, n in (x for k in range(1, size) for x in ((2 * k - 1, at[rows], k), (2 * k, at[rows] + k, size - k))):
                    one, two = whole[n][begin], found.second(n, begin)
                    yield pa.record_batch([*own, pa.array(np.full(len(rows), size, np.int32)), pa.array(np.full(len(rows), number, np.int32)), pa.array(_shard(one, shards)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["lang", "phrase", "a", "size", "part", "shard", "first", "second"])

    return run


def _read_rows(max_words: int, hashed, counts):
    """(lang, phrase, size, counts) of the candidates: own count, then both sides of each cut, read by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals = hashed.value, counts.value
        for part in slices(batches, "phrase", SLICE):
            found, sizes, _, _ = _own_keys(part)
            at = found.words.first[:-1]
            whole = {n: found.keys(n) for n in range(1, max_words + 1)}
            read = lambda begin, n: _read(known, totals, whole[n][begin], found.second(n, begin))
            for size in range(2, max_words + 1):
                rows = np.flatnonzero(sizes == size)
                begin = at[rows]
                sides = [read(begin, size)] + [x for k in range(1, size) for x in (read(begin, k), read(begin + k, size - k))]
                flat = np.column_stack(sides).ravel() if len(rows) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (2 * size - 1), pa.int32()), pa.array(flat))
                yield pa.record_batch([part.column("lang").take(pa.array(rows)), part.column("phrase").take(pa.array(rows)), pa.array(np.full(len(rows), size, np.int32)), lists], ["lang", "phrase", "size", "f"])

    return run


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, shard_keys: int = SHARD_KEYS, part_keys: int = PART_KEYS, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of two words or more that occur ``least`` times, and (lang, n), each language's number of words.

    ``f``: the phrase's count, then those of both sides of each cut.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang")).where("text IS NOT NULL")
    sizes = list(range(1, max_words + 1))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(FEWEST_BITS, (n_bytes // 12).bit_length()))
    tables = {size: np.zeros((1 << _bits(size, bits)) // 8, np.uint8) for size in sizes}
    # which buckets reach the least count; what the tasks hold of a block is some KB each
    blocks = texts.mapInArrow(_buckets(sizes, bits, least), "kind int, block long, gaps binary, times binary").groupBy("kind", "block")
    for row in blocks.applyInArrow(_passing_bits(least), "kind int, block long, bits binary").collect():
        # len(sizes) * 2 ** most_bits bits at the most, whatever the texts' size
        own = tables[row["kind"]][row["block"] * BLOCK // 8 :][: BLOCK // 8]
        own[:] = np.frombuffer(bytes(row["bits"]), np.uint8)[: len(own)]
    passing = spark.sparkContext.broadcast(tables)

    def candidates_of(counted: bool) -> DataFrame:
        # a group's candidates come from some GROUP_BYTES of text, however much there is
        blobs = texts.mapInArrow(_candidates(passing, bits, max(16, n_bytes // GROUP_BYTES), counted), "group long, lang string, blob binary, times binary")
        return materialized(blobs.groupBy("group", "lang").applyInArrow(_merged, _MERGED), "candidates")

    # more passing buckets than one hash holds: the candidates bring their counts
    counted = sum(int(np.bitwise_count(x).sum()) for x in tables.values()) > shard_keys
    given = candidates_of(counted)
    n = given.where("phrase IS NOT NULL").count()
    if n > shard_keys and not counted:
        counted, given = True, candidates_of(True)
    totals = given.where("phrase IS NULL").select("lang", "n")
    candidates = given.where("phrase IS NOT NULL")
    if counted:
        candidates = candidates.where(F.col("n") >= least)
        n = candidates.count()
    shards = max(1, -(-n // shard_keys))
    parts = max(1, -(-n // (shards * part_keys)))
    # a shard's or part's keys are a hash's share of all: hardly more than wanted
    hashes = candidates.mapInArrow(_keyed(shards, parts), "shard long, part long, first long, second long, n long").groupBy("shard", "part").applyInArrow(_built, "shard long, part long, hash binary")
    if not counted:
        known = _assembled(((r["part"], r["hash"]) for r in hashes.collect()), parts)
        hashed = spark.sparkContext.broadcast(known)
        sums = _tree_sum(materialized(texts.mapInArrow(_counted(passing, bits, hashed), _BLOCKS), "counts"), "<i8", None)
        counts = spark.sparkContext.broadcast(_gathered(sums, len(known)))
        found = candidates.mapInArrow(_read_rows(max_words, hashed, counts), "lang string, phrase string, size int, f array<long>")
        return found.where(F.col("f")[0] >= least), totals
    answer = "lang string, phrase string, a long, size int, part int, f long"

    def read(mine: pa.Table, known: pa.Table) -> pa.Table:
        mine = mine if known.num_rows else mine.slice(0, 0)
        table = _assembled(zip(known.column("part").to_pylist(), known.column("hash").to_pylist()), parts)
        found = _read(table, table.values, *(mine.column(c).to_numpy().view(np.uint64) for c in ("first", "second")))
        return mine.select(["lang", "phrase", "a", "size", "part"]).append_column("f", pa.array(found, pa.int64()))

    asked = candidates.mapInArrow(_parts(max_words, shards), "lang string, phrase string, a long, size int, part int, shard long, first long, second long")
    answers = _with_hashes(asked, materialized(hashes, "hashes"), read, answer, "phrase")
    rows = answers.groupBy("lang", "phrase", "size", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "f"))), lambda x: x["f"]).alias("f"))
    return rows.select("lang", "phrase", "size", F.concat(F.array("a"), "f").alias("f")), totals


#: The cut with the lowest score, then the smallest k. Whole numbers of 38 digits: counts of up to 10 ** 15 keep every product exact.
_CUT = f"""array_min(transform(sequence(1, size - 1), k -> named_struct(
    'score', (CAST({SCALE} AS DECIMAL(38,0)) * CAST(f[0] AS DECIMAL(38,0)) * CAST(f[0] AS DECIMAL(38,0))) div (CAST(f[2 * k - 1] AS DECIMAL(38,0)) * CAST(f[2 * k] AS DECIMAL(38,0))),
    'k', k, 'l', f[2 * k - 1], 'r', f[2 * k])))"""


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, covers_percent: int = COVERS_PERCENT, **bounds) -> DataFrame:
    """Each language's ``top`` phrases: (lang, rank, phrase, a, l, r, n, score). ``bounds``: those of ``phrase_counts``."""
    counted, totals = phrase_counts(docs, text_col=text_col, lang_col=lang_col, max_words=max_words, least=least, **bounds)
    found = materialized(counted, "phrases")
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda k: F.array_join(F.slice(words, k, n), " "))))
    inner = found.where("size > 2").select("lang", F.explode(spans).alias("phrase"), F.col("f")[0].alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {covers_percent} * f[0]")
    scored = kept.select("lang", "phrase", F.col("f")[0].alias("a"), F.expr(_CUT).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a part of a language gives its best rows, then the parts are ranked together: RANK_PARTS * top rows a language at the most
    parted = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    few = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERY = "op12_phrase_collocations"


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sized AS (SELECT lang, w, unnest([1, 2, 3]) AS s FROM cut
), grams AS (
  SELECT lang, s, unnest(list_transform(generate_series(1, len(w) - s + 1), lambda k: array_to_string(w[k:k + s - 1], ' '))) AS phrase FROM sized
), f AS (SELECT lang, s, phrase, count(*) AS f FROM grams GROUP BY lang, s, phrase
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE s = 1 GROUP BY lang
), candidates AS (SELECT lang, s, phrase, f AS a FROM f WHERE s > 1 AND f >= 10
), split AS (SELECT lang, s, phrase, a, string_split(phrase, ' ') AS w, unnest(generate_series(1, s - 1)) AS k FROM candidates
), cuts AS (SELECT lang, s, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:s], ' ') AS y FROM split
), scored AS (
  SELECT cuts.lang, cuts.s, cuts.phrase, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM candidates WHERE s = 3) GROUP BY ALL
), kept AS (SELECT best.* FROM best LEFT JOIN inner_phrases i ON i.lang = best.lang AND i.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY rank <= 2000
"""
