"""Draws that are functions of (seed, table, column, row): the same under any partitioning."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: str, row: Column, draw: int = 0) -> Column:
    """A double in [0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(key), row.cast("long"), F.lit(draw)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def normal(key: str, row: Column, mean: float, std: float) -> Column:
    """Box and Muller, from two draws."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(key, row, 1)))
    return F.lit(mean) + F.lit(std) * radius * F.cos(F.lit(2 * math.pi) * uniform(key, row, 2))


def exponential(key: str, row: Column, low: float, scale: float) -> Column:
    return F.lit(low) - F.lit(scale) * F.log(F.lit(1.0) - uniform(key, row, 1))


def index(key: str, row: Column, n: int, draw: int = 0) -> Column:
    """A whole number in [0, n)."""
    return F.least(F.floor(uniform(key, row, draw) * n).cast("long"), F.lit(n - 1).cast("long"))


def pick(values: list, key: str, row: Column, draw: int = 0) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index(key, row, len(values), draw) + 1).cast("int"))


def permuted(key: str, row: Column, n: int) -> Column:
    """The image of row under a keyed bijection of [0, n): a Feistel network that walks on while it lands outside."""
    if n <= 1:
        return F.lit(0).cast("long")
    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "big") for i in range(4)]

    @F.pandas_udf("long")
    def run(rows):
        import numpy as np
        import pandas as pd

        def once(x):
            left, right = x >> np.uint64(half), x & np.uint64((1 << half) - 1)
            for k in keys:
                mixed = (right + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ (mixed >> np.uint64(64 - half))
            return left << np.uint64(half) | right

        out = once(rows.to_numpy().astype(np.uint64))
        while (outside := out >= np.uint64(n)).any():
            out[outside] = once(out[outside])
        return pd.Series(out.astype(np.int64))

    return run(row.cast("long"))
