"""Bitmaps of hashed keys: a broadcast of checked size that drops most rows a join would not match."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 26


def bits_for(rows: int) -> int:
    """Eight slots a key or more, up to 2^26 slots (8 MB); beyond that more rows pass, never fewer."""
    return min(MOST_BITS, max(16, (8 * rows).bit_length()))


def marks(keys: DataFrame, slot: Column, bits: int) -> Broadcast:
    """A broadcast bitmap of 2^bits slots with those of ``keys`` set; words are put together by Spark."""
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("marks")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("marks").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def marked(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each slot is set."""
    return (bitmap[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1

