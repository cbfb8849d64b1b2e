"""CSV input with missing-value tokens and inferred types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.sources.tables import SourceNotFound

# Cell texts that mean "missing".
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


# What counts as a number: a cast alone also takes suffixes such as that of 5d.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    missing: Sequence[str] = MISSING_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """A CSV file or folder with a header.

    Every column is read as text, missing tokens become null, and then the
    column is cast.  Without ``schema``, one pass over the whole input finds the
    types: a column is bigint if all its values are whole numbers, double if all
    are numbers, else string.  Quotes inside quoted cells are doubled; with
    ``multi_line`` quoted cells may hold line breaks, and files are not split.
    """
    try:
        raw = spark.read.csv(
            path, header=True, inferSchema=False, enforceSchema=False, quote='"', escape='"', multiLine=multi_line
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise SourceNotFound(path) from error
        raise
    text = raw.select(*[F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    types = _named_types(schema) if schema is not None else infer_types(text)
    return text.select(
        *[F.col(f"`{c}`").try_cast(types[c]).alias(c) if types.get(c, "string") != "string" else F.col(f"`{c}`") for c in text.columns]
    )


def _named_types(schema: T.StructType | str) -> Mapping[str, str]:
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return {f.name: f.dataType.simpleString() for f in fields.fields}


def infer_types(text: DataFrame) -> dict[str, str]:
    """The narrowest of bigint, double and string for each text column, in one pass."""
    aggregates = []
    for i, c in enumerate(text.columns):
        x = F.col(f"`{c}`")
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.count(F.when(x.rlike(WHOLE), x.try_cast("bigint"))).alias(f"b{i}"),
            F.count(F.when(x.rlike(DECIMAL), x.try_cast("double"))).alias(f"d{i}"),
        ]
    row = text.agg(*aggregates).first()
    types = {}
    for i, c in enumerate(text.columns):
        n = row[f"n{i}"]
        if n == 0:
            types[c] = "string"
        elif row[f"b{i}"] == n:
            types[c] = "bigint"
        else:
            types[c] = "double" if row[f"d{i}"] == n else "string"
    return types
