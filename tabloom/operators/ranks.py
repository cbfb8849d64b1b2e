"""Exact positions of the rows of a table of any size, as a DataFrame.

Rows are ranged by the wanted order, numbered within their range where they
stand, and shifted by the rows of the ranges before.  Only one count per range
(and group) is summed up in a window; no task sees more than its range, and the
driver sees nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.quantiles import number
from tabloom.session import write_and_reread

# Fixed value: Spark numbers the rows of partition p from p * 2^33.
PARTITION_BITS = 33
SALTS = 8


def with_rank(df: DataFrame, order: Sequence[str], name: str = "rank", groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with the position of each row, from 0, within its group; nulls come first.

    Rows that are equal in ``order`` get positions beside each other, in no stated order, and any
    number of them is spread over tasks.  The group's size is added as ``<name>_of``.
    """
    place, tie, part, shift = (f"__{name}_{x}" for x in ("place", "tie", "part", "shift"))
    sort = [*groups, *order, tie]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).drop(tie)
    laid = write_and_reread(ranged.withColumn(place, F.monotonically_increasing_id()), "ranks")
    laid = laid.withColumn(part, F.shiftright(place, PARTITION_BITS))
    counts = laid.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("__rows"), F.min(place).alias("__first"))
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # a row per range
    before = own.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(g).alias(f"__{name}_g{i}") for i, g in enumerate(groups)],
        F.col(part).alias(f"{part}_"),
        (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias(shift),
        F.sum("__rows").over(own).alias(f"{name}_of"),
    )
    same = [F.col(part) == F.col(f"{part}_")] + [F.col(g).eqNullSafe(F.col(f"__{name}_g{i}")) for i, g in enumerate(groups)]
    joined = laid.join(shifts, reduce(Column.__and__, same))
    return joined.select(*df.columns, (F.col(place) + F.col(shift)).alias(name), f"{name}_of")


def level_positions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, level, position): the levels of all columns, one position each, column after column, levels in order."""
    pairs = ", ".join(f"{i}, '{c}', CAST(`{c}` AS STRING)" for i, c in enumerate(columns))
    levels = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (number, column_name, level)").filter("level IS NOT NULL").distinct()
    return with_rank(levels, ["number", "level"], "position").select("column_name", "level", "position")


def one_hot_positions(df: DataFrame, positions: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, indices): where the one-hot vector of a row is 1, ascending; a null or unseen level has no place.

    The rows' levels meet the positions by column and level, in long form, so one join serves all columns, and a
    vector is put together where its row's places arrive.  A level that most rows hold is spread by a salt.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    long = df.selectExpr(f"`{key}`", f"stack({len(columns)}, {pairs}) AS (column_name, level)").withColumn("salt", salt)
    salted = positions.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    met = long.join(salted, ["column_name", "level", "salt"])
    places = met.groupBy(key).agg(F.sort_array(F.collect_list("position")).alias("indices"))
    empty = F.array().cast("array<bigint>")
    return df.select(key).join(places, key, "left").select(key, F.coalesce("indices", empty).alias("indices"))


def qq_rows(df: DataFrame, column: str, key: str = "row_id") -> DataFrame:
    """(key, probability, normal_quantile, sample_quantile) of every row with a value: all points of a Q-Q plot.

    Equal values are ordered by ``key``.
    """
    values = df.select(key, number(column).alias("sample_quantile")).filter("sample_quantile IS NOT NULL")
    ranked = with_rank(values, ["sample_quantile", key], "place")
    probability = (F.col("place") + F.lit(0.5)) / F.col("place_of")

    @F.pandas_udf("double")
    def normal(p: pd.Series) -> pd.Series:
        inverse = NormalDist().inv_cdf
        return pd.Series(np.fromiter(map(inverse, p), dtype=float, count=len(p)))

    points = ranked.select(key, probability.alias("probability"), "sample_quantile")
    return points.select(key, "probability", normal("probability").alias("normal_quantile"), "sample_quantile")
