"""Random choices as functions of row identity, so that they do not depend on partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_key(seed, row_id: str | Column = "row_id") -> Column:
    """Hex key md5(seed|row_id); rows ordered by it are in a seeded random order."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws("|", F.lit(str(seed)), row_id.cast("string")))


def unit(key: Column) -> Column:
    """Uniform number in [0, 1) from the first eight hex digits of a key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_row_id(df: DataFrame, columns: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """Add a key made of the given columns (all by default); unique once full duplicates are gone.

    Every cell goes in with its length, and a missing one as a mark of its own, so different rows have different texts.
    """
    columns = columns or df.columns
    cells = [F.col(c).cast("string") for c in columns]
    text = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]
    return df.withColumn(name, F.md5(F.concat(*text)))


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit numbers, for random choices inside tasks."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unit64(key: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1), one for each seed (rows) and key (columns)."""
    with np.errstate(over="ignore"):
        h = mix64(key[None, :] ^ mix64(seed.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))[:, None])
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
