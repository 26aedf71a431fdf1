"""A Bloom filter of bounded size over key columns, to find a few rows of a large table without shuffling it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits: 16 for each key, within these bounds (32 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28


def probes(*keys: Column) -> list[Column]:
    """Two hashes of the key, which a filter's bits are taken from; null is a value too."""
    return [F.xxhash64(*keys, F.lit(i)) for i in range(2)]


class Bloom:
    """Keys that a filter misses were never added; beyond ``MOST_BITS`` it lets more and more others through."""

    def __init__(self, rows: DataFrame, *keys: str):
        """``rows``: a written table. A row for each 64 bits at most reaches the driver, however many keys there are."""
        wanted = 16 * max(rows.count(), 1)
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << wanted.bit_length()))
        bit = F.explode(F.array(*[p.bitwiseAND(F.lit(self.bits - 1)) for p in probes(*[F.col(k) for k in keys])]))
        one = F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")
        found = rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
        words = np.zeros(self.bits >> 6, np.uint64)
        words[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint64)
        self.words = rows.sparkSession.sparkContext.broadcast(words)

    def hit(self, *hashes: np.ndarray) -> np.ndarray:
        words, out = self.words.value, np.ones(len(hashes[0]), bool)
        for h in hashes:
            at = h.astype(np.int64).view(np.uint64) & np.uint64(self.bits - 1)
            out &= ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out

    def may_hold(self, *keys: Column) -> Column:
        """The same as a condition on rows; only the hashes travel to Python."""

        @F.pandas_udf("boolean")
        def test(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(self.hit(a.to_numpy(), b.to_numpy()))

        return test(*probes(*keys))
