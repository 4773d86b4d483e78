"""Words are found in slices whose arrays stay small, and are the same whatever the slices."""

import tracemalloc

import numpy as np
import pyarrow as pa

from contactloom.llm import textblocks


def test_slices_hold_little():
    texts = pa.array(["a longer word and another " * 400] * 400)  # 4 MB
    textblocks.Words(texts[:1], textblocks.NONSPACE)  # the tables of powers
    tracemalloc.start()
    words = textblocks.Words(texts, textblocks.NONSPACE)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    own = sum(x.nbytes for x in (words.start, words.end, words.hash))
    assert peak - 2 * own < 12 << 20


def test_words_do_not_depend_on_slices(monkeypatch):
    texts = pa.array(["Some words, é ü 漢字 and more " * 50, None, "", "x" * 3000, "last one"])
    whole = textblocks.Words(texts, textblocks.NONSPACE)
    monkeypatch.setattr(textblocks, "SLICE_BYTES", 100)
    parts = textblocks.Words(texts, textblocks.NONSPACE)
    for name in ("start", "end", "hash", "first", "doc"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name))
