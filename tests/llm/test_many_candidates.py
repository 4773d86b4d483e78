"""More candidates than one hash holds: they bring their counts, and no occurrence is written or shuffled."""

import os
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from contactloom.llm import collocations

RNG = np.random.default_rng(5)


def plain_counts(rows, sizes=(1, 2, 3)):
    found = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece.lower())
            found.update((lang, " ".join(w[k : k + s])) for s in sizes for k in range(len(w) - s + 1))
    return found


def some_rows(n, words):
    vocabulary = [f"w{k}é" for k in range(words)]
    return [(" ".join(RNG.choice(vocabulary, 40)) + ". " + " ".join(RNG.choice(vocabulary, 20)), ["en", "de"][k % 2]) for k in range(n)]


def test_tables_stay_smaller_than_the_texts(spark, monkeypatch):
    rows = some_rows(6000, 90)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2).cache()
    docs.count()
    written, real = {}, collocations.materialized

    def materialized(df, name):
        found = real(df, name)
        written[name] = written.get(name, 0) + sum(os.path.getsize(f.removeprefix("file://")) for f in found.inputFiles())
        return found

    monkeypatch.setattr(collocations, "materialized", materialized)
    one = {tuple(r) for r in collocations.collocations(docs).collect()}
    assert len(one) == 4000
    written.clear()
    assert {tuple(r) for r in collocations.collocations(docs, shard_keys=5_000).collect()} == one
    assert sum(written.values()) < 0.6 * sum(len(text) for text, _ in rows), (written, sum(len(text) for text, _ in rows))


def test_more_candidates_than_buckets(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FEWEST_BITS", 6)
    rows = some_rows(60, 12)
    found, totals = collocations.phrase_counts(spark.createDataFrame(rows, "text string, lang string").repartition(3), most_bits=6, shard_keys=150, part_keys=20)
    expected = plain_counts(rows)
    got = {(r["lang"], r["phrase"]): r["f"] for r in found.collect()}
    assert {k: f[0] for k, f in got.items()} == {k: n for k, n in expected.items() if n >= 10 and " " in k[1]}
    for (lang, phrase), f in got.items():
        w = phrase.split(" ")
        assert f[1:] == [expected[lang, " ".join(x)] for k in range(1, len(w)) for x in (w[:k], w[k:])]
    assert {tuple(r) for r in totals.collect()} == {(lang, sum(n for (x, p), n in expected.items() if x == lang and " " not in p)) for lang in ("en", "de")}


@pytest.mark.parametrize("held", [200, 3000, 1 << 30])
def test_counts_of_what_a_task_holds(monkeypatch, held):
    monkeypatch.setattr(collocations, "_part", lambda: 0)
    monkeypatch.setattr(collocations, "SLICE", 2000)
    monkeypatch.setattr(collocations, "HELD_KEYS", held)
    monkeypatch.setattr(collocations, "HELD_COUNTED", held)
    rows, bits, least = some_rows(150, 40), 24, 3
    batch = lambda: iter([pa.record_batch([[t for t, _ in rows], [x for _, x in rows]], ["text", "lang"])])
    held_blocks = pa.Table.from_batches(list(collocations._buckets([1, 2, 3], bits, least)(batch())))
    tables = {size: np.zeros((1 << collocations._bits(size, bits)) // 8, np.uint8) for size in (1, 2, 3)}
    for kind, block in {(r["kind"], r["block"]) for r in held_blocks.select(["kind", "block"]).to_pylist()}:
        own = held_blocks.filter(pa.compute.and_(pa.compute.equal(held_blocks["kind"], kind), pa.compute.equal(held_blocks["block"], block)))
        bits_of = np.frombuffer(collocations._passing_bits(least)(own).column("bits")[0].as_py(), np.uint8)
        tables[kind][block * collocations.BLOCK // 8 :][: len(bits_of)] = bits_of
    expected = plain_counts(rows)
    frequent = {k: n for k, n in expected.items() if n >= least}
    # two phrases may share a bucket
    assert abs(sum(int(np.bitwise_count(x).sum()) for x in tables.values()) - len(frequent)) < 30
    blobs = pa.Table.from_batches(list(collocations._candidates(SimpleNamespace(value=tables), bits, 3, True)(batch())))
    got = {}
    for group, lang in {(r["group"], r["lang"]) for r in blobs.select(["group", "lang"]).to_pylist()}:
        own = blobs.filter(pa.compute.and_(pa.compute.equal(blobs["group"], group), pa.compute.equal(blobs["lang"], lang)))
        for r in collocations._merged(own).to_pylist():
            assert (r["lang"], r["phrase"]) not in got
            got[r["lang"], r["phrase"]] = r["n"]
    words = {lang: got.pop((lang, None)) for lang in ("en", "de")}
    assert got.keys() >= frequent.keys() and got == {k: expected[k] for k in got} and len(got) < len(frequent) + 30
    assert words == {lang: sum(n for (x, p), n in expected.items() if x == lang and " " not in p) for lang in words}
