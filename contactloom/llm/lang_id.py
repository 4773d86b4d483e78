"""Language identification by compression with one zstandard dictionary a language.

What a text shares with a language shortens it when that language's sample is the compressor's raw-content
dictionary. A whole text is compressed in chunks of ``CHUNK`` bytes, so that the dictionary counts for all of
a long text and not only until it has become its own dictionary; the sizes of its chunks are summed, and the language with the
least sum is chosen. A text under ``SHORT`` bytes follows a lead of ``LEAD`` bytes of the language's sample, whose own size is taken off: alone, it
would hold too little to be coded at all. Case is folded. Where the runner-up needs hardly more, ``accepted`` is false: the guess is given and marked as one.

Dictionaries are a bounded sample: of each language ``DICT_BYTES`` at most, in pieces of ``PIECE`` code points that begin anywhere
in a text; of ``MOST_LANGS`` languages at most, those with most labelled rows, and of ``TOTAL_BYTES`` at most in all. They are the only thing that
is broadcast, and prediction is one pass without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0, not accepted; so is every text if no language was learnt.
Equally short languages: the first in order. Rows without id, text, letter or language teach nothing; copies of a sampled piece teach once. Repeated rows are judged
again, very long texts whole; other columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.textblocks import slices, text_bytes

FOLDS, HELD = 3, 1
DICT_BYTES, TOTAL_BYTES, MOST_LANGS = 96 << 10, 16 << 20, 256
PIECE, CHUNK, LEVEL = 400, 4096, 6
SHORT, LEAD = 1024, 1024
#: A guess is rejected unless the runner-up is larger by this share and so many bytes.
MARGIN, MARGIN_BYTES = 0.01, 2
#: So much larger a runner-up, as a share and in bytes, stands for odds of e.
SOFTNESS, SOFT_BYTES = 0.02, 3
NONE = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def learn(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary of each language, from the rows that may be learnt from."""
    known = docs.select(F.col(f"`{doc_col}`").alias("doc_id"), F.lower(F.col(f"`{text_col}`")).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("doc_id IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not counts:
        return {}
    most = min(dict_bytes, TOTAL_BYTES // len(counts))
    whole, rows = 1 << 30, 4 * (most // PIECE + 1)  # four times as many as fill a dictionary of letters of one byte: texts are short, or copies
    rates = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(whole, rows * whole // n)))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < F.element_at(rates, F.col("lang")))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.char_length("text") - PIECE + 1)) + 1
    pieces = drawn.select("lang", F.substring(F.col("text"), start.cast("int"), F.lit(PIECE)).alias("piece"), F.xxhash64("doc_id", F.lit(2)).alias("draw")).groupBy("lang", "piece").agg(F.min("draw").alias("draw"))
    # about MOST_LANGS * rows pieces at the most, whatever the tables' size
    found: dict[str, bytes] = {}
    for r in pieces.orderBy("lang", "draw", "piece").toLocalIterator():
        have = found.get(r["lang"], b"")
        if len(have) < most:
            found[r["lang"]] = have + r["piece"].encode()[: most - len(have)] + b"\n"
    return dict(sorted(found.items()))


class Judge:
    """Compressors of all languages; ``sizes(texts)``: the summed sizes of each text's chunks, one column a language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, chunk: int = CHUNK):
        import zstandard

        self.langs, self.chunk, self.segments = list(dictionaries), chunk, zstandard.BufferWithSegments
        plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.coders, self.leads, self.lead_sizes = [], [], []
        for whole in dictionaries.values():
            lead, raw = whole[: min(LEAD, len(whole) // 2)], whole[min(LEAD, len(whole) // 2) :]
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
            if known:
                known.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=known, **plain))
            self.leads.append(lead)
            self.lead_sizes.append(len(self.coders[-1].multi_compress_to_buffer([lead])[0]))

    def short_sizes(self, texts: list[bytes]) -> np.ndarray:
        """What each text adds to the size of each language's lead."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for k, (coder, lead, alone) in enumerate(zip(self.coders, self.leads, self.lead_sizes)):
            out[:, k] = np.fromiter(map(len, coder.multi_compress_to_buffer([lead + x for x in texts])), np.int64, len(texts)) - alone
        return np.maximum(out, 0)

    def sizes(self, texts: pa.Array) -> np.ndarray:
        raw, offsets = text_bytes(texts)
        length = np.diff(offsets)
        n = np.where(length < SHORT, 0, -(-length // self.chunk))
        out = np.zeros((len(n), len(self.langs)), np.int64)
        few = np.flatnonzero(n == 0)
        if len(few):
            out[few] = self.short_sizes([raw[offsets[k] : offsets[k + 1]].tobytes() for k in few.tolist()])
        if not n.sum():
            return out
        row = np.repeat(np.arange(len(n)), n)
        start = offsets[row] + self.chunk * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(offsets[row + 1] - start, self.chunk)
        parts = self.segments(np.ascontiguousarray(raw).data, np.column_stack([start, length]).astype("<u8").tobytes())
        for k, coder in enumerate(self.coders):
            size = np.fromiter(map(len, coder.multi_compress_to_buffer(parts)), np.int64, len(row))
            out[:, k] += np.bincount(row, size, len(n)).astype(np.int64)
        return out

    def judged(self, texts: pa.Array, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the number of its language, a score, and whether it is far enough ahead."""
        sizes = self.sizes(texts)
        best = sizes.argmin(1)
        least = sizes.min(1)
        more = sizes - least[:, None]
        score = 1 / np.exp(-more / (SOFTNESS * least + SOFT_BYTES)[:, None]).sum(1)
        more[np.arange(len(best)), best] = more.max(initial=0) + (1 << 40)  # one language alone has no runner-up
        return best, score, more.min(1) >= margin * least + MARGIN_BYTES


def _judge(shared, level: int, chunk: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, level, chunk)
        names = pa.array([*judge.langs, NONE], pa.string())
        for part in slices(batches, "text"):
            has = part.column("judged").to_numpy(zero_copy_only=False).astype(bool) & bool(judge.langs)
            best, score, accepted = np.full(part.num_rows, len(judge.langs)), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
            if has.any():
                best[has], score[has], accepted[has] = judge.judged(part.column("text").filter(pa.array(has)), margin)
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), names.take(pa.array(best)), pa.array(score), pa.array(accepted)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes], *, doc_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, chunk: int = CHUNK, margin: float = MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted), one row a document."""
    text = F.lower(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{doc_col}`").alias("doc_id"), held_out(F.col(f"`{doc_col}`")).alias("held_out"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("judged"))
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    return rows.mapInArrow(_judge(shared, level, chunk, margin), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, accepted boolean")


QUERY = "op13_language_id"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs))
