"""Bloom-like sieve of fixed size: which keys may be in a set.

Built with Spark's bitmap aggregates (partial sums per task), so the driver gets at most
``bits / 8`` bytes whatever the set.  A key that is not in the set may pass; one that is always
does.  Users join what passes with the set itself, so a full sieve only saves less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


class Sieve:
    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether each 64-bit key may be in the set."""
        at = keys.astype(np.int64) & (len(self.bitmap) * 8 - 1)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def build(keys: DataFrame, column: str, bits: int = BITS) -> Sieve:
    """Sieve of the well-mixed 64-bit keys in ``column``; ``bits`` is a power of two, 32,768 at least."""
    at = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1  # these functions count from 1
    maps = keys.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map"))
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for no, part in maps.toLocalIterator():
        held = np.frombuffer(bytes(part), dtype=np.uint8)
        bitmap[(no - 1) * 4096 : (no - 1) * 4096 + len(held)] = held
    return Sieve(bitmap)
