"""Bit maps of 64-bit keys: bounded in size, sent to all tasks, never without a key that they should have."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_map(keys: DataFrame, column: str, rows: int, spread: int, least: int, most: int) -> np.ndarray:
    """A map with a bit for the low bits of each key: about ``spread`` bits a key, 2 ** ``least`` to 2 ** ``most`` in all.

    Beyond the upper bound it lets more foreign keys pass; joins that follow give the same rows.
    """
    width = min(max(least, (spread * rows).bit_length()), most)
    at = F.col(column).bitwiseAND(F.lit((1 << width) - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (width - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits


def listed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the map has the keys; true for all of its own and few others."""
    at = keys & ((len(bits) << 6) - 1)
    return ((bits[at >> 6] >> (at & 63)) & 1).astype(bool)


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that is no column of ``frame`` (in any case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
