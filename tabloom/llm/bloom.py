"""Bloom filters that tasks build together."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
PROBES = 5
MOST_BYTES = 64 << 20


def _mixed(a: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of hashes, for each level and probe."""
    with np.errstate(over="ignore"):
        x = a + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def places(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit places of keys, one row per probe."""
    with np.errstate(over="ignore"):
        first, step = _mixed(a, level), _mixed(b, level) | np.uint64(1)
        return np.stack([(first + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)])


def passes(words: np.ndarray, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    at = places(a, b, level, len(words) * 64)
    return np.all((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1), axis=0)


def filter_of(rows: DataFrame, n: int, level: int) -> np.ndarray:
    """The Bloom filter of ``rows``, whose number is ``n``."""
    n_words = max(1, math.ceil(n * BITS_PER_KEY / 64))

    def emit(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            at = places(a, b, level, n_words * 64).ravel()
            word, back = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    merged = rows.mapInArrow(emit, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(n_words, np.uint64)
    got = merged.toPandas()  # at most n_words rows, whose bytes the shards bound
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def without_most(rows: DataFrame, key: str, wanted: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` without most of those whose key is not in ``wanted``, so that a join after it moves little.

    The filter is broadcast, so its size is checked: with more keys than
    ``most_bytes`` hold, all rows stay and the join does the work alone.
    """
    n = wanted.count()
    if n * BITS_PER_KEY > 8 * most_bytes:
        return rows
    halves = [F.xxhash64(F.lit(side), F.col(key)) for side in "ab"]
    words = filter_of(wanted.select(halves[0].alias("a"), halves[1].alias("b")), n, 0)
    held = rows.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def may_be(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(passes(held.value, a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64), 0))

    return rows.where(may_be(*halves))
