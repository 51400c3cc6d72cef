"""Reproducible randomness from md5, identical on every engine that has md5.

A draw depends only on (seed, tag, key), never on partitioning, task order or retries, so a
recomputed task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
_DIGITS = 13  # hex digits of a draw: 52 bits, which a double holds exactly


def _as_columns(keys: Sequence[Column | str]) -> list[Column]:
    return [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]


def hash_hex(tag: str, *keys: Column | str, seed: int = SEED) -> Column:
    """32 hex characters; their text order is a reproducible shuffle of the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *_as_columns(keys)))


def uniform(tag: str, *keys: Column | str, seed: int = SEED) -> Column:
    """Double in [0, 1) from the first 52 bits of the hash."""
    head = F.substring(hash_hex(tag, *keys, seed=seed), 1, _DIGITS)
    return F.conv(head, 16, 10).cast("double") / F.lit(16.0**_DIGITS)
