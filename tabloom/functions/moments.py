"""Moments of many columns in one pass, and the sample statistics built on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_PARTIAL = "i int, n double, mean double, m2 double, m3 double, m4 double, low double, high double"


def moment_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, mean, m2, m3, m4, min, max) per column, nulls and NaN left out.

    ``m2`` to ``m4`` are sums of powers of the distance from the mean.  A task
    folds its Arrow batches into one row per column; the rows of all tasks are
    then combined around the common mean.  Unlike one aggregate with hundreds
    of expressions, this stays compact however many columns there are.
    """
    names = list(columns)

    def combine(a, b):
        """Moments of two groups of rows taken together (Pebay 2008)."""
        n = a[0] + b[0]
        safe = np.where(n > 0, n, 1.0)
        mean = (a[0] * a[1] + b[0] * b[1]) / safe
        parts = [_around(group, mean) for group in (a, b)]
        sums = [x + y for x, y in zip(*parts, strict=True)]
        return np.array([n, mean, *sums, np.fmin(a[5], b[5]), np.fmax(a[6], b[6])])

    def fold(batches):
        d = len(names)
        total = np.zeros((7, d))
        total[5:] = np.nan
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)])
            seen = ~np.isnan(x)
            n = seen.sum(0).astype(float)
            mean = np.where(seen, x, 0.0).sum(0) / np.maximum(n, 1.0)
            c = np.where(seen, x - mean, 0.0)
            square = c * c
            low = np.where(n > 0, np.where(seen, x, np.inf).min(0), np.nan)
            high = np.where(n > 0, np.where(seen, x, -np.inf).max(0), np.nan)
            total = combine(
                total,
                np.array([n, mean, square.sum(0), (square * c).sum(0), (square * square).sum(0), low, high]),
            )
        columns = [pa.array(np.arange(d, dtype=np.int32)), *[pa.array(total[k]) for k in range(7)]]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "mean", "m2", "m3", "m4", "low", "high"])

    doubles = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    partial = doubles.mapInArrow(fold, _PARTIAL).filter("n > 0")
    whole = Window.partitionBy("i")
    shifted = partial.withColumn("d", F.col("mean") - F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    n, d, m2, m3 = F.col("n"), F.col("d"), F.col("m2"), F.col("m3")
    totals = shifted.groupBy("i").agg(
        F.sum("n").alias("n"),
        (F.sum(n * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
    )
    every = df.sparkSession.range(len(names)).select(
        F.col("id").cast("int").alias("i"), F.get(F.array(*[F.lit(c) for c in names]), "id").alias("column_name")
    )
    return every.join(totals, "i", "left").select(
        "column_name",
        F.coalesce("n", F.lit(0.0)).cast("bigint").alias("n"),
        *["mean", "m2", "m3", "m4", "min", "max"],
    )


def _around(moments, mean):
    """Sums of powers 2 to 4 about another mean."""
    n, own, m2, m3, m4 = moments[:5]
    d = own - mean
    return m2 + n * d**2, m3 + 3 * d * m2 + n * d**3, m4 + 4 * d * m3 + 6 * d**2 * m2 + n * d**4


def _count() -> Column:
    return F.col("n").cast("double")


def sample_deviation() -> Column:
    return F.when(F.col("n") > 1, F.sqrt(F.try_divide(F.col("m2"), _count() - 1)))


def population_deviation() -> Column:
    return F.sqrt(F.try_divide(F.col("m2"), _count()))


def sample_skewness() -> Column:
    """Adjusted Fisher-Pearson skewness G1; null below three values or without spread."""
    n = _count()
    g1 = F.try_divide(F.sqrt(n) * F.col("m3"), F.pow(F.col("m2"), 1.5))
    return F.when((n > 2) & (F.col("m2") > 0), F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g1)


def sample_kurtosis() -> Column:
    """Sample excess kurtosis G2; null below four values or without spread."""
    n = _count()
    g2 = F.try_divide(n * F.col("m4"), F.col("m2") * F.col("m2")) - 3
    return F.when((n > 3) & (F.col("m2") > 0), F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3)))
