"""The end-to-end job: clean, build features, prepare, fit, score."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.features import core_features
from tabloom.functions.scalar import log_target, target_from_log
from tabloom.functions.splits import in_holdout
from tabloom.operators import clean
from tabloom.operators.linear import Ridge
from tabloom.operators.prepare import GRADED_COLUMNS, preparation, transform
from tabloom.roles import Roles
from tabloom.session import reused
from tabloom.sources.fixture import property_table

IDENTIFIERS = ("row_id", "target")


def prepare_training(table: DataFrame) -> tuple[DataFrame, Roles, list[str]]:
    """Rows without outliers, with features, and without the columns that are nearly empty.

    Returns the frame, its roles and the dropped columns.
    """
    kept = clean.remove_outliers(table)
    sparse = [c for c in clean.sparse_columns(kept) if c not in IDENTIFIERS]
    featured = core_features().apply(kept.drop(*sparse))
    return featured, Roles.from_schema(featured, ordinal=GRADED_COLUMNS), sparse


def fit_ridge(train: DataFrame, roles: Roles, alpha: float = 10.0) -> tuple[PipelineModel, LinearRegressionModel]:
    """The preparation and a ridge model of the log target."""
    prepared_model = preparation(roles).fit(train)
    prepared = transform(prepared_model, train, [roles.id, roles.target])
    labelled = prepared.withColumn("label", log_target(F.col(roles.target)))
    return prepared_model, Ridge(alpha=alpha).fit(labelled)


def score(prepared_model: PipelineModel, model: LinearRegressionModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Predictions on the original scale."""
    scored = model.transform(transform(prepared_model, df, keep))
    return scored.withColumn("prediction", target_from_log(F.col("prediction"))).drop("features")


def score_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, target, prediction) of the holdout rows, by a ridge fitted on the others."""
    table = property_table(spark, sf_dir)
    with reused(table.filter(~in_holdout())) as train:
        featured, roles, sparse = prepare_training(train)
        with reused(featured) as kept:
            prepared_model, model = fit_ridge(kept, roles)
    holdout = core_features().apply(table.filter(in_holdout()).drop(*sparse))
    return score(prepared_model, model, holdout, ["row_id", "target"])
