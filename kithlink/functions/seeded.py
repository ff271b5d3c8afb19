"""Seeded, portable pseudo-random order built from md5.

The order depends only on (seed, stage, id): not on partitioning, task
retries or the engine, so a lost executor can never change a sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hex digits are 60 bits: the largest prefix that stays positive in a bigint.
HEX_DIGITS = 15


def order_hash(seed: int, stage: str, *ids: Column) -> Column:
    """Hex digest that orders ids within (seed, stage)."""
    parts = [F.lit(str(seed)), F.lit(stage), *[i.cast("string") for i in ids]]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def hash_int(digest: Column) -> Column:
    """Non-negative bigint from the first 15 hex digits of a digest."""
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")


def hash_mod(digest: Column, modulus: Column | int) -> Column:
    """Digest reduced to 0..modulus-1."""
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    return hash_int(digest) % m.cast("bigint")
