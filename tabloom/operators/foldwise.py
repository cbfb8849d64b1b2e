"""Linear models of all folds and penalties from one scan.

A task folds its rows into moments per fold: rows, means, and the matrix of
products of distances from the means, features and label together.  The
training rows of fold k are all other folds, so their moments are the sum of
those; every penalty is then a small system of equations, and the error on a fold
follows from its own moments.  A grid of any size reads the table once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.quantiles import number
from tabloom.session import MERGE_WAYS

MOMENT_SCHEMA = "fold int, way int, n double, mean binary, products binary"
STEPS = 10_000  # sweeps of the coordinate descent
TOLERANCE = 1e-12


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred products of the features and, as the last one, the label."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0)
        centred = rows - mean
        return cls(float(len(rows)), mean, centred.T @ centred)

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        step = other.mean - self.mean
        mean = self.mean + step * (other.n / n)
        return Moments(n, mean, self.products + other.products + np.outer(step, step) * (self.n * other.n / n))


def fold_moments(df: DataFrame, columns: Sequence[str], label: str, fold: Column) -> dict[int, Moments]:
    """The moments of each fold over the rows without missing values, in one scan; folds come back as one row each."""
    width = len(columns) + 1
    values = [number(c).alias(f"x{i}") for i, c in enumerate((*columns, label))]

    def fold_rows(batches):
        held: dict[int, Moments] = {}
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
            folds = batch.column(width).to_numpy(zero_copy_only=False)
            whole = ~np.isnan(rows).any(axis=1)
            for k in np.unique(folds[whole]).tolist():
                found = Moments.of(rows[whole & (folds == k)])
                held[int(k)] = held[int(k)].plus(found) if int(k) in held else found
        yield _moment_batch([(k, m) for k, m in held.items()])

    def merge(group: pa.Table) -> pa.Table:
        total = reduce(Moments.plus, (_moments_of(row, width) for row in group.to_pylist()))
        return pa.Table.from_batches([_moment_batch([(group.column("fold")[0].as_py(), total)])])

    way = F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)).cast("int")
    partial = df.select(*values, fold.cast("int").alias("fold")).filter("fold IS NOT NULL").mapInArrow(fold_rows, MOMENT_SCHEMA)
    some = partial.withColumn("way", way).groupBy("fold", "way").applyInArrow(merge, MOMENT_SCHEMA)
    rows = some.groupBy("fold").applyInArrow(merge, MOMENT_SCHEMA).collect()
    return {r["fold"]: _moments_of(r.asDict(), width) for r in rows}


def _moment_batch(found: Sequence[tuple[int, Moments]]) -> pa.RecordBatch:
    columns = [
        pa.array([k for k, _ in found], pa.int32()),
        pa.array([0] * len(found), pa.int32()),
        pa.array([m.n for _, m in found], pa.float64()),
        pa.array([m.mean.tobytes() for _, m in found], pa.binary()),
        pa.array([m.products.tobytes() for _, m in found], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["fold", "way", "n", "mean", "products"])


def _moments_of(row: dict, width: int) -> Moments:
    products = np.frombuffer(row["products"], dtype=np.float64).reshape(width, width)
    return Moments(row["n"], np.frombuffer(row["mean"], dtype=np.float64), products)


@dataclass(frozen=True)
class LinearFit:
    columns: tuple[str, ...]
    weights: np.ndarray
    intercept: float

    def prediction(self) -> Column:
        terms = [F.lit(float(w)) * F.col(c).cast("double") for w, c in zip(self.weights, self.columns, strict=True)]
        return reduce(Column.__add__, terms, F.lit(float(self.intercept)))

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.prediction())

    def mse(self, on: Moments) -> float:
        """The mean squared error on rows of which only the moments are known."""
        w = np.append(-self.weights, 1.0)
        bias = on.mean @ w - self.intercept
        return float(w @ on.products @ w / on.n + bias**2)


def solved(moments: Moments, columns: Sequence[str], alpha: float = 0.0, l1_ratio: float = 0.0) -> LinearFit:
    """Least squares with penalty.

    Without an L1 share, ``alpha`` is added to the diagonal of the products, and a direction
    that the data do not determine gets no weight.  With one, the mean squared error is halved
    and ``alpha`` weighs absolute (``l1_ratio``) and squared values, by coordinate descent on the products.
    """
    xx, xy = moments.products[:-1, :-1], moments.products[:-1, -1]
    if l1_ratio == 0:
        weights = np.linalg.lstsq(xx + alpha * np.eye(len(xx)), xy, rcond=None)[0]
    else:
        weights = _descended(xx / moments.n, xy / moments.n, alpha * l1_ratio, alpha * (1 - l1_ratio))
    return LinearFit(tuple(columns), weights, float(moments.mean[-1] - weights @ moments.mean[:-1]))


def _descended(xx: np.ndarray, xy: np.ndarray, l1: float, l2: float) -> np.ndarray:
    w = np.zeros(len(xx))
    for _ in range(STEPS):
        largest = 0.0
        for j in range(len(w)):
            if xx[j, j] == 0:
                continue
            rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (xx[j, j] + l2)
            largest, w[j] = max(largest, abs(new - w[j]) * xx[j, j] ** 0.5), new
        if largest < TOLERANCE:
            break
    return w


@dataclass(frozen=True)
class FoldFits:
    """The model of each fold, fitted without it."""

    fits: dict[int, LinearFit]

    def out_of_fold(self, df: DataFrame, fold: str = "fold", prediction: str = "prediction") -> DataFrame:
        """Every row scored by the model of its fold, in the scan that reads it."""
        value = reduce(lambda rest, k: F.when(F.col(fold) == k, self.fits[k].prediction()).otherwise(rest), self.fits, F.lit(None))
        return df.withColumn(prediction, value.cast("double"))

    def mean(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """New rows scored by the mean of all models."""
        total = reduce(Column.__add__, [f.prediction() for f in self.fits.values()])
        return df.withColumn(prediction, total / F.lit(float(len(self.fits))))


def _others(moments: dict[int, Moments], k: int) -> Moments:
    return reduce(Moments.plus, [m for j, m in sorted(moments.items()) if j != k])


def fit_folds(df: DataFrame, columns: Sequence[str], label: str, fold: str = "fold", alpha: float = 0.0, l1_ratio: float = 0.0) -> FoldFits:
    """One model per fold, from one scan."""
    moments = fold_moments(df, columns, label, F.col(fold))
    return FoldFits({k: solved(_others(moments, k), columns, alpha, l1_ratio) for k in sorted(moments)})


def linear_grid(
    df: DataFrame, columns: Sequence[str], label: str, candidates: Sequence[dict[str, float]], fold: str = "fold"
) -> tuple[LinearFit, list[tuple[int, dict[str, float], int, float]]]:
    """Cross-validation of every candidate (alpha, and l1Ratio where wanted), and the best one on all rows.

    The trials are (trial, parameters, fold, RMSE on the fold).
    """
    moments = fold_moments(df, columns, label, F.col(fold))
    trials = []
    for t, c in enumerate(candidates):
        shown = {name: float(v) for name, v in c.items()}
        for k in sorted(moments):
            fit = solved(_others(moments, k), columns, c["alpha"], c.get("l1Ratio", 0.0))
            trials.append((t, shown, k, fit.mse(moments[k]) ** 0.5))
    mean = {t: np.mean([score for u, _, _, score in trials if u == t]) for t in range(len(candidates))}
    best = candidates[min(mean, key=lambda t: (mean[t], t))]
    whole = reduce(Moments.plus, [m for _, m in sorted(moments.items())])
    return solved(whole, columns, best["alpha"], best.get("l1Ratio", 0.0)), trials
