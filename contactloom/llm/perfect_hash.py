"""Minimal perfect hashing of 128-bit keys, vectorised: levels of bit arrays with ranks.

Keys are dealt to parts by a hash, and parts are built apart from each other. In a part, a key takes the first level at which no
other key left shares its place; its slot is the number of places taken before it, all earlier parts' keys included. What is no key may get
a slot too, so ``slots`` compares the second half of the key, stored there; the first half chose the slot.
"""

from __future__ import annotations

import io

import numpy as np

from contactloom.llm.textblocks import mix

#: Places a key left at each level, and the most levels: with so many, keys are equal.
GAMMA, MOST_LEVELS = 2.0, 64


def _place(first: np.ndarray, second: np.ndarray, level: int, size) -> np.ndarray:
    return (mix(first ^ mix(second + np.uint64(level * 2 + 1))) % size).astype(np.int64)


def part_of(first: np.ndarray, parts: int) -> np.ndarray:
    return (mix(first + np.uint64(99)) % np.uint64(parts)).astype(np.int64)


def build(first: np.ndarray, second: np.ndarray, values: np.ndarray | None = None) -> bytes:
    """A part's levels and the second halves of its keys in the order of their slots, with a whole number each if ``values`` are given. The pairs must be distinct."""
    levels, left = {}, np.arange(len(first))
    order = []
    while len(left):
        if len(levels) == MOST_LEVELS:
            raise ValueError("keys are not distinct")
        size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
        place = _place(first[left], second[left], len(levels), np.uint64(size))
        alone = np.bincount(place, minlength=size) == 1
        levels[f"level{len(levels)}"] = np.packbits(alone, bitorder="little").view(np.uint64)
        taken = alone[place]
        order.append(left[taken][np.argsort(place[taken])])
        left = left[~taken]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    raw = io.BytesIO()
    if values is not None:
        levels["values"] = values[order].astype(np.min_scalar_type(int(values.max(initial=0))))
    np.savez(raw, second=second[order], **levels)
    return raw.getvalue()


class PerfectHash:
    """``slots(first, second)``: the slot of each key, -1 for what is none; ``values`` by slot, if it was built with some. Made of the bytes of its parts, by number."""

    def __init__(self, built: dict[int, bytes], parts: int):
        self.parts = max(1, parts)
        found = [dict(np.load(io.BytesIO(built[k]))) if k in built else {} for k in range(self.parts)]
        none = np.zeros(0, np.uint64)
        self.second = np.concatenate([none, *(x.get("second", none) for x in found)])
        self.values = np.concatenate([np.zeros(0, np.int64), *(x["values"].astype(np.int64) for x in found if "values" in x)])
        before = np.concatenate([[0], np.cumsum([len(x.get("second", none)) for x in found])[:-1]]).astype(np.int64)
        #: of each level: size and first word of each part, all words, keys before each word
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while any(f"level{len(self.levels)}" in x for x in found):
            words = [x.get(f"level{len(self.levels)}", np.zeros(1, np.uint64)) for x in found]
            ones = [np.bitwise_count(x).astype(np.int64) for x in words]
            ranks = np.concatenate([b + np.cumsum(x) - x for b, x in zip(before, ones)])
            before = before + np.array([x.sum() for x in ones])
            sizes = np.array([len(x) for x in words])
            self.levels.append((sizes.astype(np.uint64) * np.uint64(64), np.cumsum(sizes) - sizes, np.concatenate(words), ranks))

    def __len__(self) -> int:
        return len(self.second)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1, np.int64)
        left, part = np.arange(len(first)), part_of(first, self.parts)
        for level, (sizes, begin, words, ranks) in enumerate(self.levels):
            own = part[left]
            place = _place(first[left], second[left], level, sizes[own])
            at, bit = begin[own] + (place >> 6), (place & 63).astype(np.uint64)
            word = words[at]
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[here]] = (ranks[at] + below)[here]
            left = left[~here]
            if not len(left):
                break
        own = np.flatnonzero(out >= 0)
        out[own[self.second[out[own]] != second[own]]] = -1
        return out
