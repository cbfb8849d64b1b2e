"""Saving and loading fitted models and preparations."""

from __future__ import annotations

import pickle
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a fitted pipeline lies at ``path`` (any file system Spark can reach)."""
    try:
        spark.read.text(f"{path}/metadata").limit(1).count()
        return True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def save_model(model, path: str) -> None:
    """Write a fitted model, replacing one at the same path.

    Spark ML models write themselves.  A model of this library is a dataclass:
    its values are pickled into a one-row table, tables it holds are written
    beside it, and `load_model` puts it together again.
    """
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
        return
    state = {}
    for f in fields(model):
        value = getattr(model, f.name)
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(f"{path}/{f.name}")
            state[f.name] = (True, None)
        elif isinstance(value, tuple) and any(isinstance(x, DataFrame) for x in value):
            for k, table in enumerate(value):
                table.write.mode("overwrite").parquet(f"{path}/{f.name}-{k}")
            state[f.name] = (True, len(value))
        else:
            state[f.name] = (False, value)
    row = [(bytearray(pickle.dumps((type(model), state))),)]
    SparkSession.active().createDataFrame(row, "model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str):
    """A model of this library from `save_model`; as with every pickle, only from a place one trusts."""
    kind, state = pickle.loads(bytes(spark.read.parquet(f"{path}/model").first()["model"]))
    parts = {}
    for name, (tables, value) in state.items():
        if tables and value is None:
            parts[name] = spark.read.parquet(f"{path}/{name}")
        else:
            parts[name] = tuple(spark.read.parquet(f"{path}/{name}-{k}") for k in range(value)) if tables else value
    return kind(**parts)


def load_or_fit(path: str, estimator: Estimator, train: DataFrame) -> PipelineModel:
    """The pipeline stored at ``path``; fitted on ``train`` and stored first if there is none."""
    if not stored(train.sparkSession, path):
        pipeline = estimator if isinstance(estimator, Pipeline) else Pipeline(stages=[estimator])
        save_model(pipeline.fit(train), path)
    return PipelineModel.load(path)
