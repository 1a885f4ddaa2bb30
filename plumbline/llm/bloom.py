"""A Bloom filter of 64-bit hashes, built by an aggregation and asked in numpy.

It only spares a join rows that can't match: what passes is joined exactly. Its size is bounded
by `MOST_BITS` whatever the number of hashes; a fuller filter lets more through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the most bits: 16 MB.
MOST_BITS = 27
#: The hash's bits that are used as places, from these on.
SHIFTS = (0, 18, 37)
#: Bits for each hash, as long as MOST_BITS allows.
EACH = 32


def bloom(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """(words of bits, log2 of the bits) for the distinct column h of `hashes`."""
    n = hashes.count()
    size = min(MOST_BITS, max(10, (EACH * n).bit_length()))
    at = hashes.select(F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit((1 << size) - 1)) for s in SHIFTS])).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return bits, size


def passes(h: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Which of the unsigned hashes may be in the filter."""
    ok, mask = np.ones(len(h), bool), np.uint64((1 << size) - 1)
    for shift in SHIFTS:
        at = (h >> np.uint64(shift)) & mask
        ok &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok
