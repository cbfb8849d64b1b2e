"""Row splits that depend on the row key only.

A row's part follows from the md5 of its key, so it is the same for every
partitioning, cluster size and rerun, and can be worked out in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(key: str = "row_id") -> Column:
    """The first 32 bits of the md5 of the key, as a number from 0 to 2**32-1."""
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def in_holdout(key: str = "row_id", share: float = 0.2) -> Column:
    """True for about ``share`` of all rows."""
    return row_hash(key) % 10000 < int(round(share * 10000))


def fold_number(k: int = 5, key: str = "row_id") -> Column:
    """The fold of a row, 0 to k-1."""
    return (row_hash(key) % k).cast("int")


def with_holdout(df: DataFrame, share: float = 0.2, key: str = "row_id", name: str = "is_holdout") -> DataFrame:
    return df.withColumn(name, in_holdout(key, share))


def with_fold(df: DataFrame, k: int = 5, key: str = "row_id", name: str = "fold") -> DataFrame:
    return df.withColumn(name, fold_number(k, key))


def holdout_split(df: DataFrame, share: float = 0.2, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(training rows, holdout rows)."""
    held = in_holdout(key, share)
    return df.filter(~held), df.filter(held)
