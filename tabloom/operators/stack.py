"""Out-of-fold predictions and stacking."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.boost import Booster, BoosterModel, fit_together
from tabloom.operators.linear import Ols
from tabloom.session import write_and_reread

# A fit function takes (training rows, validation rows) and returns a model with
# ``transform`` that adds a ``prediction`` column.
Fitter = Callable[[DataFrame, DataFrame], object]


def out_of_fold(
    df: DataFrame,
    fit: Fitter,
    folds: int,
    fold: str = "fold",
    key: str = "row_id",
    test: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame | None]:
    """Predictions of every row by the model of the other folds.

    Returns (key, fold, prediction and the columns to ``keep``) over ``df``, and
    for ``test`` the mean prediction of all fold models per row: the models are
    chained over one frame, so neither side is shuffled.
    """
    inside, outside = [], test
    for k in range(folds):
        validation = df.filter(F.col(fold) == k)
        model = fit(df.filter(F.col(fold) != k), validation)
        inside.append(model.transform(validation).select(key, fold, "prediction", *keep))
        if test is not None:
            outside = model.transform(outside).withColumnRenamed("prediction", f"__p{k}")
    oof = reduce(DataFrame.unionByName, inside)
    if test is None:
        return oof, None
    total = reduce(Column.__add__, [F.col(f"__p{k}") for k in range(folds)])
    return oof, outside.select(key, (total / F.lit(folds)).alias("prediction"))


@dataclass(frozen=True)
class StackedPredictions:
    """Base predictions per row, and the linear model that combines them."""

    train: DataFrame
    test: DataFrame
    combiner: LinearRegressionModel


def stack(
    df: DataFrame,
    test: DataFrame,
    base: Mapping[str, Fitter],
    folds: int = 5,
    label: str = "target",
    fold: str = "fold",
    key: str = "row_id",
) -> StackedPredictions:
    """Fit each base model per fold, then least squares on their out-of-fold predictions.

    Base predictions are written out, one table for training and one for test
    rows: the combiner must not score the base models again.  They are folded
    from the stacked frames with one shuffle on the key.
    """
    inside, outside = [], []
    for name, fit in base.items():
        oof, mean = out_of_fold(df, fit, folds, fold, key, test)
        inside.append(oof.select(key, F.lit(name).alias("model"), "prediction"))
        outside.append(mean.select(key, F.lit(name).alias("model"), "prediction"))
    names = list(base)
    train_table = write_and_reread(_by_model(inside, names, key).join(df.select(key, label), key), "oof")
    test_table = write_and_reread(_by_model(outside, names, key), "test-predictions")
    assembler = VectorAssembler(inputCols=names, outputCol="base_predictions")
    combiner = Ols(featuresCol="base_predictions", labelCol=label).fit(assembler.transform(train_table))
    return StackedPredictions(
        combiner.transform(assembler.transform(train_table)).drop("base_predictions"),
        combiner.transform(assembler.transform(test_table)).drop("base_predictions"),
        combiner,
    )


def stack_boosters(
    df: DataFrame,
    test: DataFrame,
    base: Mapping[str, Booster],
    folds: int = 5,
    label: str = "target",
    fold: str = "fold",
    key: str = "row_id",
) -> StackedPredictions:
    """`stack` for boosters: the models of all folds, and of all boosters with the same bins, grow together.

    Each side is scored in one scan: a training row by the models that have not seen its fold, a
    test row by the mean of a booster's models.  Persist ``df``.
    """
    alike: dict[tuple, list[str]] = {}
    for name, booster in base.items():
        bins = (tuple(booster.columns), tuple(booster.categories), booster.label, booster.key, booster.max_bins)
        alike.setdefault(bins, []).append(name)
    models: dict[str, list[BoosterModel]] = {}
    for names in alike.values():
        jobs = [(name, k) for name in names for k in range(folds)]
        found = fit_together(df, [base[name] for name, _ in jobs], [k for _, k in jobs], F.col(fold))
        for (name, _), model in zip(jobs, found, strict=True):
            models.setdefault(name, []).append(model)
    own = F.col(fold).cast("int")
    inside = df.select(key, label, *[_scored(m, own).alias(n) for n, m in models.items()])
    outside = test.select(key, *[_scored(m, F.lit(-1)).alias(n) for n, m in models.items()])
    assembler = VectorAssembler(inputCols=list(base), outputCol="base_predictions")
    train_table = assembler.transform(write_and_reread(inside, "oof"))
    test_table = assembler.transform(write_and_reread(outside, "test-predictions"))
    combiner = Ols(featuresCol="base_predictions", labelCol=label).fit(train_table)
    return StackedPredictions(
        combiner.transform(train_table).drop("base_predictions"), combiner.transform(test_table).drop("base_predictions"), combiner
    )


def _scored(models: Sequence[BoosterModel], fold: Column) -> Column:
    """The prediction of the row's fold's model, or the mean of all for a row of fold -1."""
    binning = models[0].binning
    starts, trees = [m.start for m in models], [m.trees[: m.best_iteration] for m in models]

    @F.pandas_udf("double")
    def score(own: pd.Series, *series: pd.Series) -> pd.Series:
        bins = binning.matrix([s.to_numpy() for s in series])
        folds = own.to_numpy()
        total = np.zeros(len(folds))
        for k, (start, members) in enumerate(zip(starts, trees, strict=True)):
            rows = np.flatnonzero((folds == k) | (folds < 0))
            out = np.full(len(rows), start)
            for tree in members:
                out += tree.predict(bins[rows])
            total[rows] += out / np.where(folds[rows] < 0, len(starts), 1)
        return pd.Series(total)

    return score(fold, *binning.inputs())


def _by_model(frames: list[DataFrame], names: list[str], key: str) -> DataFrame:
    stacked = reduce(DataFrame.unionByName, frames)
    return stacked.groupBy(key).agg(
        *[F.max(F.when(F.col("model") == name, F.col("prediction"))).alias(name) for name in names]
    )
