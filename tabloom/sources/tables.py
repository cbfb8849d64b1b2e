"""Reading the parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class SourceNotFound(FileNotFoundError):
    """A table that a job needs is not there."""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` below ``folder``; `SourceNotFound` where there is none.

    The path is looked up when the plan is built, so a missing input stops the
    job before any work is done.
    """
    path = f"{folder}/{name}.parquet"
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise SourceNotFound(path) from error
        raise
