"""Regression metrics as aggregate expressions: one pass gives all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mse(actual: Column, predicted: Column) -> Column:
    return F.avg((actual - predicted) * (actual - predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(mse(actual, predicted))


def r2(actual: Column, predicted: Column) -> Column:
    """1 - SSE/SST; null where the actual values do not vary."""
    both = actual.isNotNull() & predicted.isNotNull()
    seen = F.when(both, actual)
    return 1 - F.try_divide(F.sum((actual - predicted) * (actual - predicted)), F.count(seen) * F.var_pop(seen))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Row count, MSE, RMSE and R2, in total or per group."""
    y, p = F.col(actual), F.col(predicted)
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        mse(y, p).alias("mse"),
        rmse(y, p).alias("rmse"),
        r2(y, p).alias("r2"),
    ]
    return df.groupBy(*by).agg(*aggregates)


def cross_validation_summary(df: DataFrame, actual: str, predicted: str, fold: str = "fold") -> DataFrame:
    """Mean and population deviation of the per-fold RMSE and R2."""
    per_fold = regression_metrics(df, actual, predicted, [fold])
    return per_fold.agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("rmse").alias("rmse_mean"),
        F.stddev_pop("rmse").alias("rmse_std"),
        F.avg("r2").alias("r2_mean"),
        F.stddev_pop("r2").alias("r2_std"),
    )
