"""Bit tables of key sets: of a size that follows the number of keys up to a fixed bound, to be broadcast.

A table only lets keys through that may be in the set; what passes is joined with the set itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table has at least so many times as many bits as keys, and never more than 2 ** ``MOST_BITS`` bits (32 MiB).
BITS_A_KEY, MOST_BITS = 8, 28


def bits_for(n_keys: int) -> int:
    return min(MOST_BITS, max(12, (BITS_A_KEY * n_keys).bit_length()))


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """2 ** ``bits`` bits with those of the low bits of ``key`` set; only these words, a fixed number, come to the driver."""
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit keys may be in the table's set."""
    at = keys & np.int64((len(table) << 6) - 1)
    return (table[at >> np.int64(6)] >> (at & np.int64(63)) & np.int64(1)).astype(bool)
