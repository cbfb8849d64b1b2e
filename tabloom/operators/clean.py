"""Row and column cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.profile import long_form
from tabloom.operators.quantiles import exact_quantiles
from tabloom.roles import numeric_columns

# Columns whose zeros carry meaning (a class code, years, a month).
ZERO_EXEMPT = ("property_class", "year_built", "year_remodel", "parking_year", "year_sold", "month_sold")


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the named columns; names that are absent are ignored."""
    return df.drop(*names)


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def sparsity(df: DataFrame, threshold: float = 0.95, exempt: Sequence[str] = ZERO_EXEMPT) -> DataFrame:
    """Null rate, zero rate and verdict per column, from one pass over all columns.

    A column is dropped when its null rate reaches the threshold, or, for
    numbers outside ``exempt``, when its zero rate does.  Both rates are shares
    of all rows.
    """
    numeric = set(numeric_columns(df)) - set(exempt)
    aggregates = []
    for c in df.columns:
        aggregates.append(F.avg(F.col(c).isNull().cast("int")).alias(f"null_rate:{c}"))
        zero = F.coalesce(F.col(c) == 0, F.lit(False)).cast("int") if c in numeric else F.lit(None).cast("int")
        aggregates.append(F.avg(zero).alias(f"zero_rate:{c}"))
    rates = long_form(df.agg(*aggregates), df.columns, {"null_rate": "DOUBLE", "zero_rate": "DOUBLE"})
    verdict = (
        F.when(F.col("null_rate") >= threshold, "missing")
        .when(F.col("zero_rate") >= threshold, "zero")
        .otherwise("keep")
    )
    return rates.withColumn("verdict", verdict)


def sparse_columns(df: DataFrame, threshold: float = 0.95, exempt: Sequence[str] = ZERO_EXEMPT) -> list[str]:
    """Names of the columns that `sparsity` would drop."""
    found = sparsity(df, threshold, exempt).filter("verdict <> 'keep'").select("column_name").collect()
    names = {row["column_name"] for row in found}
    return [c for c in df.columns if c in names]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.95, exempt: Sequence[str] = ZERO_EXEMPT) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold, exempt))


def drop_cheap_large_plots(
    df: DataFrame,
    area: str = "land_area",
    target: str = "target",
    area_above: float = 50000,
    target_below: float = 200000,
) -> DataFrame:
    """Remove rows with a very large plot and a low (untransformed) target.

    A row where either value is missing stays.
    """
    suspicious = (F.col(area) > area_above) & (F.col(target) < target_below)
    return df.filter(~F.coalesce(suspicious, F.lit(False)))


def total_of(columns: Sequence[str]) -> Column:
    """The sum of the columns with nulls as 0."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total


@dataclass(frozen=True)
class UpperFence:
    """An upper outlier bound Q3 + factor*IQR, fitted on one table and usable on any."""

    columns: tuple[str, ...]
    q1: float
    q3: float
    factor: float

    @property
    def bound(self) -> float:
        return self.q3 + self.factor * (self.q3 - self.q1)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(total_of(self.columns) <= F.lit(self.bound))


def fit_upper_fence(
    df: DataFrame, columns: Sequence[str] = ("ground_area", "upper_area", "basement_area"), factor: float = 3.0
) -> UpperFence:
    """The fence of the sum of ``columns``; the quartiles are exact."""
    q1, q3 = exact_quantiles(df.select(total_of(columns).alias("total")), {"total": [0.25, 0.75]})["total"]
    return UpperFence(tuple(columns), q1, q3, factor)


def remove_outliers(df: DataFrame) -> DataFrame:
    """`drop_cheap_large_plots`, then the upper fence fitted on what is left."""
    kept = drop_cheap_large_plots(df)
    return fit_upper_fence(kept).apply(kept)
