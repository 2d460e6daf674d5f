"""Reproducible pseudo-random orders that any SQL engine can repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2_147_483_647
MULTIPLIER = 48_271


def draw(seed: int, *keys: Column) -> Column:
    """Sort key of a random order: the md5 of seed and keys, as hexadecimal text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[key.cast("string") for key in keys]))


def draw_number(seed: int, key: Column) -> Column:
    """The first 60 bits of :func:`draw` as a number."""
    return F.conv(F.substring(draw(seed, key), 1, 15), 16, 10).cast("long")


def pair_draws(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Random order of pairs from the draw numbers (60 bits) of both sides, cheap for many pairs."""
    return _remainder(_remainder(a ^ b) * MULTIPLIER)


def low_pairs(a: np.ndarray, b: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs whose draw is at most ``upto``.

    The remainder of a product is its lower 31 bits plus its upper ones, which are less than the multiplier, and a factor that is one
    modulus too high makes these bits less by one multiplier. So the lower bits alone, in the upper 31 of 32-bit numbers, rule out
    nearly all pairs.
    """
    low, high = ([(x & MODULUS).astype(np.uint32), (x >> 31).astype(np.uint32)] for x in (a, b))
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    multiplier, shift = np.uint32(2 * MULTIPLIER), np.uint32(4 * MULTIPLIER)
    reach = np.uint32(min(2 * upto + 4 * MULTIPLIER + 1, (1 << 32) - 1))
    step = max(1, (1 << 18) // max(1, len(b)))
    for start in range(0, len(a), step):
        some = slice(start, start + step)
        x = low[0][some, None] ^ high[0][None, :]
        x += low[1][some, None] ^ high[1][None, :]
        x *= multiplier
        x += shift
        at = np.flatnonzero(x <= reach)
        row, column = at // len(b) + start, at % len(b)
        close = pair_draws(a[row], b[column]) <= upto
        rows.append(row[close])
        columns.append(column[close])
    return np.concatenate(rows), np.concatenate(columns)


def _remainder(x: np.ndarray) -> np.ndarray:
    """Of a division by the modulus, which is 2^31 - 1, without one: 2^31 leaves 1, so the upper bits are added to the lower ones."""
    for _ in range(2):
        x = (x & MODULUS) + (x >> 31)
    return np.where(x == MODULUS, 0, x)
