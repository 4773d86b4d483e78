"""Token ids of text columns, by a public tokenizer.

The tokenizer drops white space and never looks across it, so each task encodes a
word once and puts texts together from its words' ids.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from contactloom.llm.textblocks import LOWER, text_bytes

END_ID = 1
#: When the number of its words or their bytes pass this, a task forgets those that came back least: half of them or more.
MOST_WORDS, MOST_BYTES = 300_000, 16 << 20
_MARK = "\x01"
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch


#: Texts in which a tokenizer of another kind betrays itself.
_PROBES = ["Hello, World!  The\tquick (brown) FOX-jumps over 12,345.67 dogs?!", "a\n\nb \u00e9t\u00e9 \u0130\u00df stra\u00dfe don't x_y", "under_score http://x.com/a?b=c#d  ...", " lead and trail ", "", "e.g. U.S.A. \u4e2d\u6587 \u0645\u0631\u062d\u0628\u0627"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """``encode(texts)``: the ids of all texts, each text's end id included, and n + 1 offsets."""

    def __init__(self, path: str | None = None, end_id: int = END_ID, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end_id = Tokenizer.from_file(path or default_path()), end_id
        self.most_words, self.most_bytes = most_words, most_bytes
        self.count = np.arange(1 << 20)
        # words of these letters are what the normalizer makes of them, and one piece for the splitter: both can be left out
        self.letters = Tokenizer(self.tokenizer.model)  # the model is shared, not loaded again
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        marked = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = marked[0] if marked else -1
        self._forget()
        # the ways around work for a tokenizer that drops case and white space and never looks across it; any other encodes whole texts
        self.plain = False
        self.plain = not all(len(x) == len(y) and (x == y).all() for x, y in zip(self.encode(pa.array(_PROBES)), self._encode_plainly(pa.array(_PROBES))))
        self._forget()

    def _encode_plainly(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = [[*x.ids, self.end_id] for x in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
        return np.asarray([i for x in coded for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids, self.first, self.size, self.bytes = np.array([self.end_id], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64), 0
        self.uses = np.zeros(1, np.int32)

    def _forget_rare(self) -> None:
        """Keep the words that were met in more than one slice, the more frequent half at the most; their counts age."""
        uses = self.uses[1:]
        kept = np.argsort(-uses, kind="stable")[: len(uses) // 2]
        kept = np.sort(kept[uses[kept] > 1])
        names = list(self.words)  # word k has number k + 1
        some = [names[k] for k in kept.tolist()]
        number = np.concatenate([[0], kept + 1])
        size, first = self.size[number], self.first[number]
        ids = self.ids[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.words = dict(zip(some, range(1, len(some) + 1)))
        self.ids, self.size, self.first = ids, size, np.cumsum(size) - size
        self.uses, self.bytes = self.uses[number] // 2, sum(map(len, some))
        if self.bytes > self.most_bytes // 2:
            self._forget()

    @staticmethod
    def _simpler(texts: pa.Array) -> pa.Array:
        """Other texts with the same ids and fewer different words: lower case, and a blank between a letter and the punctuation after it."""
        raw, offsets = text_bytes(texts)
        whole = lambda data: pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        found = whole(raw)
        if not pc.any(pc.match_substring(found, "<|")).as_py():  # a special token may stand there, which only counts as it is spelt
            found = whole(LOWER[raw])
        return pc.replace_substring_regex(found, r"([a-z])([.,:;!?]+)", r"\1 \2")

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, and their number for each word."""
        simple = [bool(x) for x in map(_LETTERS, words)]
        sizes = np.zeros(len(words), np.int64)
        parts: list[np.ndarray] = []
        for kind, coder in ((True, self.letters), (False, self.tokenizer)):
            at = [k for k, x in enumerate(simple) if x is kind]
            some_ids, some_sizes = self._encode_joined(coder, [words[k] for k in at])
            sizes[at] = some_sizes
            parts.append(some_ids)
        if not parts[1].size:
            return parts[0], sizes
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~np.asarray(simple))])
        ids = np.concatenate(parts)
        moved = sizes[order]
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(moved) - moved
        return ids[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))], sizes

    def _encode_joined(self, coder, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words are one call's text, with a mark between them that is a token of its own."""
        if words and not any(_MARK in x for x in words):
            texts = [f" {_MARK} ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
            ids = np.concatenate([np.asarray([*x.ids, self.mark], np.int32) for x in coder.encode_batch_fast(texts, add_special_tokens=False)])
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(words):
                return ids[ids != self.mark], np.diff(marks, prepend=-1) - 1
        coded = [x.ids for x in coder.encode_batch_fast(words, add_special_tokens=False)]
        return np.asarray([i for x in coded for i in x], np.int32), np.asarray([len(x) for x in coded], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.plain:
            return self._encode_plainly(texts)
        if len(self.words) > self.most_words or self.bytes > self.most_bytes:
            self._forget_rare()
        split = pc.ascii_split_whitespace(self._simpler(texts))
        ends = split.offsets.to_numpy()
        named = split.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        ends = ends - ends[0]
        names = named.dictionary.to_numpy(zero_copy_only=False).tolist()  # strings of a whole column at a time
        new = [x for x in names if x not in self.words]
        if new:
            ids, sizes = self._encode_words(new)
            self.words.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.ids = np.concatenate([self.ids, ids])
            self.bytes += sum(map(len, new))
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        number = np.fromiter(map(self.words.__getitem__, names), np.int32, len(names))
        self.uses[number] += 1
        # word 0 is the end id: one after each text's last word
        word = np.zeros(int(ends[-1]) + len(ends) - 1, np.int32)
        last = ends[1:] + np.arange(len(ends) - 1)
        plain = np.ones(len(word), bool)
        plain[last] = False
        word[plain] = number[named.indices.to_numpy()] if len(names) else 0
        size = self.size[word]
        before = np.cumsum(size)
        shift = self.first[word]
        shift[1:] -= before[:-1]
        source = np.repeat(shift, size)
        source += self.count[: len(source)] if len(source) <= len(self.count) else np.arange(len(source))
        return self.ids[source], np.concatenate([[0], before[last]])

    def sentence_ends(self) -> np.ndarray:
        """Ids of tokens that close a sentence: a word end whose text is only full stops, question and exclamation marks."""
        vocabulary = self.tokenizer.get_vocab()
        return np.array(sorted(i for x, i in vocabulary.items() if x.endswith("</w>") and x[:-4] and not x[:-4].strip(".!?")), np.int32)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None = None, end_id: int = END_ID, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> Encoder:
    """One for each worker process."""
    key = (path, end_id, most_words, most_bytes)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
