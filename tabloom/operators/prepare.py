"""Fitted preparation stages: imputation, ordinal grades, scaling, one-hot, assembly.

Each stage is a Spark ML estimator or transformer, so stages chain in a
``Pipeline`` and are saved with it.  Fitting runs aggregates over all columns at
once; a fitted stage holds a few numbers per column and transforms by
expressions only, on batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.moments import moment_table, population_deviation
from tabloom.operators.profile import modes
from tabloom.operators.quantiles import exact_quantiles, number
from tabloom.roles import Roles

# Grade letters and their ranks; anything else counts as 0.
GRADES = {"Ex": 5, "Gd": 4, "TA": 3, "Fa": 2, "Po": 1, "None": 0, "NA": 0}
HEIGHT_GRADES = {"Ex": 5, "Gd": 4, "TA": 3, "Fa": 2, "Po": 1, "None": 0}

# The graded columns of the property tables.
GRADED_COLUMNS = {
    "exterior_quality": GRADES,
    "exterior_condition": GRADES,
    "heating_quality": GRADES,
    "kitchen_quality": GRADES,
    "lounge_quality": GRADES,
    "parking_quality": GRADES,
    "parking_condition": GRADES,
    "pool_quality": GRADES,
    "basement_condition": GRADES,
    "basement_exposure": GRADES,
    "land_elevation": GRADES,
    "land_slope": GRADES,
    "basement_height": HEIGHT_GRADES,
}

FIT_SCOPES = ("train", "self", "union")


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """Shared plumbing: keyword construction and persistence of JSON parameters."""

    def _start(self, kwargs: dict) -> None:
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


class FillValues(Transformer, _Stage):
    """Replace nulls by a constant per column.

    ``values`` maps a column to its constant.  With ``tagCol`` it maps each tag
    value to such a mapping, and a row takes the constants of its own tag.
    """

    values = Param(Params._dummy(), "values", "column to constant, or tag to such a mapping")
    tagCol = Param(Params._dummy(), "tagCol", "column that picks the mapping", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, values: Mapping | None = None, tagCol: str | None = None):
        super().__init__()
        self._start(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        values = self.getOrDefault(self.values)
        if not self.isSet(self.tagCol):
            return df.withColumns({c: _filled(df, c, F.lit(v)) for c, v in values.items() if v is not None})
        tag = F.col(self.getOrDefault(self.tagCol))
        columns = {c for mapping in values.values() for c in mapping}
        filled = {}
        for c in sorted(columns):
            constant = F.lit(None).cast("double")
            for name, mapping in values.items():
                constant = F.when(tag == name, F.lit(mapping.get(c))).otherwise(constant)
            filled[c] = _filled(df, c, constant)
        return df.withColumns(filled)


def _filled(df: DataFrame, name: str, constant: Column) -> Column:
    if dict(df.dtypes)[name] == "string":
        return F.coalesce(F.col(name), constant.cast("string"))
    return F.coalesce(number(name), constant.cast("double"))


class MedianImputer(Estimator, HasInputCols, _Stage):
    """Fill numeric nulls with the exact median.

    ``fitScope`` says whose median: that of the rows tagged ``train`` (the
    default once ``tagCol`` is set), of each tag for its own rows (``self``), or
    of all rows together (``union``).  The last two let test rows into the fit.
    """

    tagCol = Param(Params._dummy(), "tagCol", "train/test tag", TypeConverters.toString)
    fitScope = Param(Params._dummy(), "fitScope", "train, self or union", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, tagCol: str | None = None, fitScope: str = "train"):
        super().__init__()
        if fitScope not in FIT_SCOPES:
            raise ValueError(f"fitScope must be one of {FIT_SCOPES}")
        self._start(self._input_kwargs | {"fitScope": fitScope})

    def _fit(self, df: DataFrame) -> FillValues:
        columns = self.getInputCols()
        scope = self.getOrDefault(self.fitScope)
        if not self.isSet(self.tagCol) or scope == "union":
            return FillValues(values=_medians(df, columns))
        tag = self.getOrDefault(self.tagCol)
        if scope == "train":
            return FillValues(values=_medians(df.filter(F.col(tag) == "train"), columns))
        tags = [row[0] for row in df.select(tag).distinct().collect()]  # the parts of a split: two
        return FillValues(values={t: _medians(df.filter(F.col(tag) == t), columns) for t in tags}, tagCol=tag)


def _medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in columns}).items()}


class ModeImputer(Estimator, HasInputCols, _Stage):
    """Fill nulls with the most frequent value; the smallest value wins a tie."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._start(self._input_kwargs)

    def _fit(self, df: DataFrame) -> FillValues:
        found = modes(df, self.getInputCols()).collect()  # one row per column
        return FillValues(values={row["column_name"]: row["value"] for row in found})


class ContextImputer(Transformer, _Stage):
    """Fill by rule: a missing year from another year column, a missing size with 0.

    ``fallbacks`` maps a column to the column it falls back on; ``zeros`` lists
    columns where missing means absent.
    """

    fallbacks = Param(Params._dummy(), "fallbacks", "column to fallback column")
    zeros = Param(Params._dummy(), "zeros", "columns filled with 0", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, fallbacks: Mapping[str, str] | None = None, zeros: Sequence[str] | None = None):
        super().__init__()
        self._start({"fallbacks": {"parking_year": "year_built"}, "zeros": ["pool_area", "facade_area"]})
        self._start(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        changed = {c: F.coalesce(c, other) for c, other in self.getOrDefault(self.fallbacks).items()}
        changed |= {c: F.coalesce(F.col(c), F.lit(0.0)) for c in self.getOrDefault(self.zeros)}
        return df.withColumns(changed)


class GradeEncoder(Transformer, _Stage):
    """Ranks for grade letters: null counts as ``None``, an unknown letter as 0."""

    mappings = Param(Params._dummy(), "mappings", "column to (letter to rank)")

    @keyword_only
    def __init__(self, *, mappings: Mapping[str, Mapping[str, int]] | None = None):
        super().__init__()
        self._start(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        ranks = {}
        for c, mapping in self.getOrDefault(self.mappings).items():
            pairs = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
            letter = F.coalesce(F.col(c).cast("string"), F.lit("None"))
            ranks[c] = F.coalesce(F.try_element_at(pairs, letter), F.lit(0)).cast("int")
        return df.withColumns(ranks)


class ScaleColumns(Transformer, HasInputCols, HasOutputCols, _Stage):
    """(x - mean) / deviation with the numbers of a fit."""

    centers = Param(Params._dummy(), "centers", "mean per column")
    scales = Param(Params._dummy(), "scales", "deviation per column")

    @keyword_only
    def __init__(
        self,
        *,
        inputCols: Sequence[str] | None = None,
        outputCols: Sequence[str] | None = None,
        centers: Mapping[str, float] | None = None,
        scales: Mapping[str, float] | None = None,
    ):
        super().__init__()
        self._start(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        centers, scales = self.getOrDefault(self.centers), self.getOrDefault(self.scales)
        names = zip(self.getInputCols(), self.getOutputCols(), strict=True)
        return df.withColumns({out: (F.col(c) - F.lit(centers[c])) / F.lit(scales[c]) for c, out in names})


class StandardScale(Estimator, HasInputCols, HasOutputCols, _Stage):
    """Zero mean and unit population deviation; a constant column is only centred."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCols: Sequence[str] | None = None):
        super().__init__()
        self._start(self._input_kwargs)

    def _fit(self, df: DataFrame) -> ScaleColumns:
        columns = self.getInputCols()
        fits = moment_table(df, columns).withColumn("deviation", population_deviation()).collect()  # one per column
        by_name = {row["column_name"]: row for row in fits}
        return ScaleColumns(
            inputCols=columns,
            outputCols=self.getOutputCols() if self.isSet(self.outputCols) else columns,
            centers={c: by_name[c]["mean"] or 0.0 for c in columns},
            scales={c: by_name[c]["deviation"] or 1.0 for c in columns},
        )


def one_hot_stages(columns: Sequence[str], suffix: str = "_onehot") -> list:
    """Sorted levels of the fit, one position each; an unseen level or null gives a zero vector.

    The indexer puts unknown values last, and the encoder drops the last
    position, so all known levels keep theirs.
    """
    columns = list(columns)
    indexed = [f"{c}_index" for c in columns]
    indexer = StringIndexer(
        inputCols=columns, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    encoder = OneHotEncoder(inputCols=indexed, outputCols=[c + suffix for c in columns], dropLast=True)
    return [indexer, encoder]


def native_category_stages(columns: Sequence[str], numeric: Sequence[str], output: str = "features") -> list:
    """Level indexes with nominal metadata next to numbers: trees split them as categories."""
    columns = list(columns)
    indexed = [f"{c}_index" for c in columns]
    return [
        StringIndexer(inputCols=columns, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=indexed + list(numeric), outputCol=output),
    ]


def polynomial_stages(columns: Sequence[str], degree: int = 2, output: str = "features") -> list:
    """All monomials up to ``degree`` without the constant."""
    return [
        VectorAssembler(inputCols=list(columns), outputCol="linear_features"),
        PolynomialExpansion(degree=degree, inputCol="linear_features", outputCol=output),
    ]


def preparation(roles: Roles, output: str = "features", ordinals_also_nominal: bool = False) -> Pipeline:
    """Grades scaled, other strings one-hot, numbers imputed and scaled, all in one vector.

    ``ordinals_also_nominal`` adds one-hot positions for the graded columns too.
    Scaled values go to ``<column>_scaled``, so the input columns other stages
    read stay as they are.
    """
    graded, numeric, nominal = list(roles.ordinal), list(roles.numeric), list(roles.nominal)
    hot = nominal + graded if ordinals_also_nominal else nominal
    stages: list = []
    if hot:
        stages += [FillValues(values={c: "None" for c in hot}), *one_hot_stages(hot)]
    if graded:
        stages.append(GradeEncoder(mappings=dict(roles.ordinal)))
    if numeric:
        stages.append(MedianImputer(inputCols=numeric))
    scaled = [f"{c}_scaled" for c in graded + numeric]
    if scaled:
        stages.append(StandardScale(inputCols=graded + numeric, outputCols=scaled))
    vectors = [f"{c}_onehot" for c in hot]
    stages.append(VectorAssembler(inputCols=scaled + vectors, outputCol=output))
    return Pipeline(stages=stages)


def transform(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The prepared vector next to the columns in ``keep`` only."""
    output = model.stages[-1].getOutputCol()
    return model.transform(df).select(*keep, output)
