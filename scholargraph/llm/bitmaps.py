"""Bitmaps of fixed size that tell tasks which hashes may matter: never wrongly no, sometimes wrongly yes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bits of a bitmap of texts.
TEXT_BITS = 1 << 24


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash (column h) modulo `bits`, a power of two. What comes to the driver is at most bits / 64 numbers,
    whatever the number of hashes."""
    place = hashes.select(F.pmod("h", F.lit(bits)).alias("place"))
    found = place.groupBy(F.expr("place div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))")).alias("set")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return out


def has(found: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes (uint64) are set."""
    place = h & np.uint64((len(found) << 6) - 1)
    return (found[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def may_be_in(hashes: DataFrame, h: Column, bits: int) -> Column:
    """A condition on rows with hash `h`: true for all whose hash is among `hashes` (column h). Rows for which it is false
    need no join, and so no shuffle, to be told apart from those."""
    sent = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes, bits))

    @F.pandas_udf("boolean")
    def asked(x: pd.Series) -> pd.Series:
        return pd.Series(has(sent.value, x.to_numpy(np.int64).view(np.uint64)))

    return asked(h)
