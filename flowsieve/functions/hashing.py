"""Engine-independent hashing.

The value is the first 60 bits of MD5 over the text, modulo ``mod``.  Any engine with MD5
reproduces it, it does not depend on partitioning, and it is a row-local expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORY_MOD = 2**31 - 1
SPLIT_MOD = 1_000_000


def hash60(text: Column) -> Column:
    """Uniform 60-bit non-negative number."""
    digest = F.md5(F.coalesce(text.cast("string"), F.lit("unknown")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def stable_hash(value: Column, mod: int = CATEGORY_MOD) -> Column:
    """Category code in ``[0, mod)``; null hashes like the word ``unknown``."""
    return F.pmod(hash60(value), F.lit(mod).cast("bigint"))


def seeded_hash60(seed: int, key: Column) -> Column:
    return hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def unit_interval(seed: int, key: Column) -> Column:
    """Uniform number in [0, 1) in steps of one millionth."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return stable_hash(text, SPLIT_MOD) / F.lit(float(SPLIT_MOD))
