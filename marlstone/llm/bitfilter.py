"""A Bloom filter over 64-bit hashes, built by Spark and asked in numpy.

Its size follows the number of hashes up to MOST bits (8 MB) and never goes beyond, so it may be broadcast. It only
spares work: a false hit goes on to an exact count or join. Callers know by holds() when there are too many hashes for
it to be worth asking.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits in a page, the unit of Spark's bitmap functions.
PAGE = 1 << 15
MOST = 1 << 26


def bits_for(n: int) -> int:
    """About 16 bits to a hash, as a power of two."""
    return min(MOST, max(PAGE, 1 << (16 * max(n, 1) - 1).bit_length()))


def holds(n: int) -> bool:
    """Whether the filter of n hashes lets through few others: with four bits to a hash, fewer than one in six."""
    return n * 4 <= MOST


def build(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter's bytes, of bits (a power of two from PAGE up): each hash sets the bit of its low and of its high half."""
    h, mask = F.col(column), F.lit(bits - 1).cast("long")
    at = hashes.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("at"))
    pages = at.groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(PAGE - 1).cast("long"))).alias("bits"))
    grid = np.zeros(bits // 8, np.uint8)
    for r in pages.collect():
        grid[r["page"] * PAGE // 8 :][: PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return grid


def may_have(grid: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in the filter."""
    bits = np.uint64(len(grid) * 8 - 1)
    out = np.ones(len(hashes), bool)
    for at in (hashes & bits, (hashes >> np.uint64(32)) & bits):
        out &= (grid[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out
