"""A bitmap of keys: at most 16 MB whatever their number, and never without a key that was put in.

Rows whose key it does not hold need no join with a table of those keys, so their texts need not be shuffled. With very
many keys it fills up and lets more rows through; joins behind it are exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import mix


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([mix(keys.astype(np.uint64) + np.uint64(i)) & np.uint64(bits - 1) for i in (1, 2)])


class KeyBits:
    def __init__(self, keys: DataFrame, column: str):
        """keys: a stored table, as it is read twice; null keys are left out."""
        self.bits = bits = 1 << min(27, max(16, (16 * keys.count()).bit_length()))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits).ravel()
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64))], names=["w", "bit"])

        words = np.zeros(bits // 64, np.uint64)
        marked = keys.select(column).mapInArrow(mark, "w long, bit long").groupBy("w").agg(F.expr("bit_or(bit)").alias("bit"))
        found = marked.toArrow()  # at most bits / 64 rows: 32 MB
        words[found["w"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
        self.words = keys.sparkSession.sparkContext.broadcast(words)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at, words = _places(keys, self.bits), self.words.value
        return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=0)

    def column(self, key: Column) -> Column:
        """Whether the bitmap holds a key of type long; false for null. Only the key goes to Python."""

        @F.pandas_udf("boolean")
        def held(keys: pd.Series) -> pd.Series:
            return pd.Series(self.holds(keys.to_numpy()))

        return key.isNotNull() & held(F.coalesce(key, F.lit(0)))
