"""Linear regressors on Spark ML's distributed least squares.

The penalties follow the usual textbook objectives

* ridge: ``|y - Xw|^2 + alpha*|w|^2``,
* lasso and elastic net: ``|y - Xw|^2/(2n) + alpha*l1*|w|_1 + alpha*(1-l1)/2*|w|^2``,

and are turned into Spark's parameters, whose solver divides the label, and with
it the L2 term, by the label's deviation.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.prepare import polynomial_stages

NORMAL_EQUATION_WIDTH = 4096  # widest problem that the solver's normal equations take
TINY_RIDGE = 1e-10  # makes a singular polynomial problem solvable


class _LinearEstimator(
    Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Least squares with an L1 and an L2 strength that subclasses define."""

    def _strengths(self, rows: int) -> tuple[float, float]:
        """(L1, L2) of the objective divided by 2n."""
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> LinearRegressionModel:
        label = self.getLabelCol()
        row = df.agg(
            F.count(label).alias("n"), F.stddev_pop(label).alias("population"), F.stddev_samp(label).alias("sample")
        ).first()
        width = _vector_width(df, self.getFeaturesCol())
        normal = width <= NORMAL_EQUATION_WIDTH
        deviation = (row["population"] if normal else row["sample"]) or 1.0
        l1, l2 = self._strengths(row["n"])
        strength = l1 + l2 * deviation
        return LinearRegression(
            featuresCol=self.getFeaturesCol(),
            labelCol=label,
            predictionCol=self.getPredictionCol(),
            regParam=strength,
            elasticNetParam=l1 / strength if strength else 0.0,
            standardization=False,
            solver="normal" if normal else "l-bfgs",
            maxIter=5000,
            tol=1e-12,
        ).fit(df)


def _vector_width(df: DataFrame, column: str) -> int:
    """Width of a vector column: from its metadata, else from one row."""
    attributes = df.schema[column].metadata.get("ml_attr", {})
    if "num_attrs" in attributes:
        return int(attributes["num_attrs"])
    row = df.select(column).first()
    return row[0].size if row is not None else 0


class Ols(_LinearEstimator):
    """Ordinary least squares with intercept."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _strengths(self, rows: int) -> tuple[float, float]:
        return 0.0, 0.0


class _WithAlpha(_LinearEstimator):
    alpha = Param(Params._dummy(), "alpha", "penalty strength", TypeConverters.toFloat)

    def getAlpha(self) -> float:
        return self.getOrDefault(self.alpha)


class Ridge(_WithAlpha):
    """Least squares with an L2 penalty."""

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol: str = "features",
        labelCol: str = "label",
        predictionCol: str = "prediction",
        alpha: float = 10.0,
    ):
        super().__init__()
        self._setDefault(alpha=10.0)
        self._set(**self._input_kwargs)

    def _strengths(self, rows: int) -> tuple[float, float]:
        return 0.0, self.getAlpha() / rows


class Lasso(_WithAlpha):
    """Least squares with an L1 penalty."""

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol: str = "features",
        labelCol: str = "label",
        predictionCol: str = "prediction",
        alpha: float = 0.001,
    ):
        super().__init__()
        self._setDefault(alpha=0.001)
        self._set(**self._input_kwargs)

    def _strengths(self, rows: int) -> tuple[float, float]:
        return self.getAlpha(), 0.0


class ElasticNet(_WithAlpha):
    """Least squares with a mix of both penalties."""

    l1Ratio = Param(Params._dummy(), "l1Ratio", "share of the L1 penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol: str = "features",
        labelCol: str = "label",
        predictionCol: str = "prediction",
        alpha: float = 0.01,
        l1Ratio: float = 0.5,
    ):
        super().__init__()
        self._setDefault(alpha=0.01, l1Ratio=0.5)
        self._set(**self._input_kwargs)

    def _strengths(self, rows: int) -> tuple[float, float]:
        share = self.getOrDefault(self.l1Ratio)
        return self.getAlpha() * share, self.getAlpha() * (1 - share)


class TinyRidge(_WithAlpha):
    """Least squares that stays solvable when columns are dependent or outnumber the rows."""

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol: str = "features",
        labelCol: str = "label",
        predictionCol: str = "prediction",
        alpha: float = TINY_RIDGE,
    ):
        super().__init__()
        self._setDefault(alpha=TINY_RIDGE)
        self._set(**self._input_kwargs)

    def _strengths(self, rows: int) -> tuple[float, float]:
        return 0.0, self.getAlpha()


def polynomial_regression(columns, degree: int = 2, labelCol: str = "label") -> Pipeline:
    """Monomials up to ``degree``, then least squares."""
    stages = polynomial_stages(columns, degree, "polynomial_features")
    return Pipeline(stages=[*stages, TinyRidge(featuresCol="polynomial_features", labelCol=labelCol)])
