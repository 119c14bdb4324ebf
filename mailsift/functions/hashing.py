"""Seeded, engine-independent order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows are counted in buckets by the first four hex digits of their hash.
BUCKET_DIGITS = 4


def seed_hash(seed: int, key: str | Column) -> Column:
    """``md5("seed|key")``: a fixed pseudo-random order, equal on every run and retry."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_bucket(h: Column) -> Column:
    return F.substring(h, 1, BUCKET_DIGITS)
