"""Portable hash keys.

All randomness derives from ``md5(seed:id)``: it gives the same value after a
task retry, on any engine and under any partitioning, which ``rand()`` does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52


def hash_key(*ids: Column | str, seed: object = 42) -> Column:
    """52-bit non-negative bigint from ``seed:id[:id...]``."""
    parts = [F.lit(str(seed))]
    for i in ids:
        parts.append((F.col(i) if isinstance(i, str) else i).cast("string"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint")


def uniform(*ids: Column | str, seed: object = 42) -> Column:
    """Uniform double in [0, 1); exact because 52 bits fit a double."""
    return hash_key(*ids, seed=seed) / F.lit(float(2**HASH_BITS))


def text_hash(text: Column, bits: int = 31) -> Column:
    """Hash of a string itself, below ``2**bits`` (at most 52)."""
    full = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return F.shiftright(full, HASH_BITS - bits)
