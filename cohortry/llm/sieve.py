"""A bitmap of fixed size that keeps rows which cannot matter from being shuffled; what it lets through is joined exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.bytes import lean, mix

# 2 MB for each task, whatever the input; with very many keys it lets everything through, and results stay the same.
BITS = 24


def _bit(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64)) & np.uint64((1 << BITS) - 1)


def sieve(keys: DataFrame) -> np.ndarray:
    """The bitmap of a one-column table of integers: at most ``2**BITS / 64`` words are fetched."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bit(batch.column(0).to_numpy(zero_copy_only=False)))
            places, starts = np.unique(bits >> np.uint64(6), return_index=True)
            if len(places):
                values = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(values.view(np.int64))], ["place", "bits"])

    name = keys.columns[0]
    found = keys.filter(f"`{name}` is not null").mapInArrow(lean(words), "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((1 << BITS) // 64, np.uint64)
    out[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that the table did not hold."""
    bit = _bit(keys)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
