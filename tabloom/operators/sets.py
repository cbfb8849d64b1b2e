"""Row unions, schema alignment, duplicates and key joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(train: DataFrame, test: DataFrame, tag: str = "split") -> DataFrame:
    """Train and test rows by column name; a column one side lacks is null there."""
    return train.withColumn(tag, F.lit("train")).unionByName(
        test.withColumn(tag, F.lit("test")), allowMissingColumns=True
    )


def split_back(df: DataFrame, part: str, tag: str = "split") -> DataFrame:
    """The rows of one side of `union_tagged`."""
    return df.filter(F.col(tag) == part).drop(tag)


def align_schema(df: DataFrame, like: DataFrame, fill=0) -> DataFrame:
    """The columns of ``like``, in its order: missing ones filled, extra ones dropped."""
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in have else F.lit(fill).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()


def attach_target(features: DataFrame, target: DataFrame, key: str = "row_id") -> DataFrame:
    """Features with their target, matched on the row key."""
    return features.join(target, key, "inner")


def join_predictions(frames: dict[str, DataFrame], key: str = "row_id", value: str = "prediction") -> DataFrame:
    """One row per key with a prediction column per model.

    The frames are stacked and folded in a single shuffle on the key, whatever
    their number; keys that a model lacks get a null there.
    """
    stacked = None
    names = list(frames)
    for name in names:
        part = frames[name].select(key, F.lit(name).alias("model"), F.col(value).alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(key).agg(
        *[F.max(F.when(F.col("model") == name, F.col("value"))).alias(name) for name in names]
    )
