"""Encodings that follow the data: indicator columns, level codes, target statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.ranks import with_rank

MAX_INDICATOR_COLUMNS = 5000
SALTS = 8


def sorted_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Non-null levels per column, sorted.

    Each level becomes a column, so their number has to be one that a table can
    have; more is an error.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    levels = (
        df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, level)").filter("level IS NOT NULL").distinct()
    )
    found = levels.limit(MAX_INDICATOR_COLUMNS + 1).collect()
    if len(found) > MAX_INDICATOR_COLUMNS:
        raise ValueError(f"more than {MAX_INDICATOR_COLUMNS} levels in {list(columns)}: use category codes or one-hot positions")
    return {c: sorted(row["level"] for row in found if row["column_name"] == c) for c in columns}


def indicator_columns(
    df: DataFrame, levels: Mapping[str, Sequence[str]], drop_first: bool = False, null_column: bool = False
) -> DataFrame:
    """0/1 columns ``<column>_<level>`` in place of each column.

    ``drop_first`` leaves the first level out; ``null_column`` adds
    ``<column>_nan`` for nulls.
    """
    added: list[Column] = []
    for c, names in levels.items():
        x = F.col(c).cast("string")
        for level in list(names)[1 if drop_first else 0 :]:
            added.append(x.eqNullSafe(F.lit(level)).cast("int").alias(f"{c}_{level}"))
        if null_column:
            added.append(x.isNull().cast("int").alias(f"{c}_nan"))
    return df.select(*[c for c in df.columns if c not in levels], *added)


def category_codes(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """0-based position of each value among the sorted distinct values; -1 for null."""
    output = output or f"{column}_code"
    level, code = f"__{output}_level", output
    levels = df.select(F.col(column).alias(level)).filter(F.col(level).isNotNull()).distinct()
    coded = with_rank(levels, [level], code).select(F.col(level).cast("string").alias(level), code)
    # Nulls match nothing, so they may go anywhere: spread them instead of sending all to one task.
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    key = F.coalesce(F.col(column).cast("string"), spread)
    joined = df.withColumn("__key", key).join(coded, F.col("__key") == F.col(level), "left").drop("__key", level)
    return joined.withColumn(code, F.coalesce(F.col(code), F.lit(-1)).cast("int"))


@dataclass(frozen=True)
class TargetStatistics:
    """Smoothed target mean per category.

    Training rows get the mean over the rows *before* them in a fixed
    pseudo-random order, so that no row sees its own target; new rows get the
    mean over all training rows.  Both are pulled to ``prior`` with the given
    ``weight``.  The target enters in whole multiples of ``unit``, which keeps
    sums exact in any order.
    """

    category: str
    target: str
    key: str
    prior: float
    weight: float
    unit: float
    rows: int

    MISSING = "\u0000missing"
    ROWS_PER_BUCKET = 500_000

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        category: str,
        target: str = "target",
        key: str = "row_id",
        weight: float = 1.0,
        unit: float | None = None,
    ) -> TargetStatistics:
        """``unit`` is the step to which targets are rounded for exact sums; by default 2^-31 of the largest one."""
        if unit is None:
            most = df.agg(F.max(F.abs(F.col(target).cast("double")))).first()[0]
            unit = 2.0 ** (math.floor(math.log2(most)) - 30) if most and math.isfinite(most) else 1.0
        units = _units(target, unit)
        row = df.agg(F.sum(units).alias("total"), F.count(units).alias("n")).first()
        prior = (row["total"] or 0) * unit / max(row["n"], 1)
        return cls(category, target, key, prior, weight, unit, row["n"])

    @property
    def _digits(self) -> int:
        """Hex digits of the order hash that split even a category holding every row."""
        return max(1, math.ceil(math.log(max(self.rows / self.ROWS_PER_BUCKET, 1), 16)))

    def _smoothed(self, total: Column, n: Column) -> Column:
        return (total * F.lit(self.unit) + F.lit(self.weight * self.prior)) / (n + F.lit(self.weight))

    def _with_level(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__level", F.coalesce(F.col(self.category).cast("string"), F.lit(self.MISSING)))

    def encode_training(self, df: DataFrame, output: str) -> DataFrame:
        """Running statistics over earlier rows.

        A category is cut into buckets of the order, so that one held by most
        rows is spread over many tasks: the window runs inside a bucket, and the
        totals of the buckets before it are added.  The totals are joined on the
        same keys that the window is partitioned by, so the rows move once.
        """
        order = F.md5(F.col(self.key).cast("string").cast("binary"))
        rows = self._with_level(df).withColumns(
            {
                "__order": order,
                "__bucket": F.substring(order, 1, self._digits),
                "__units": _units(self.target, self.unit),
            }
        )
        totals = rows.groupBy("__level", "__bucket").agg(
            F.sum("__units").alias("__total"), F.count("__units").alias("__count")
        )
        before = Window.partitionBy("__level").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        prefix = totals.select(
            "__level",
            "__bucket",
            F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__total_before"),
            F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__count_before"),
        )
        inside = (
            Window.partitionBy("__level", "__bucket")
            .orderBy("__order", self.key)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        total = F.coalesce(F.sum("__units").over(inside), F.lit(0)) + F.col("__total_before")
        n = F.count("__units").over(inside) + F.col("__count_before")
        return rows.join(prefix, ["__level", "__bucket"]).select(*df.columns, self._smoothed(total, n).alias(output))

    def level_table(self, df: DataFrame) -> DataFrame:
        """Total and count per category over the training rows."""
        rows = self._with_level(df).withColumn("__units", _units(self.target, self.unit))
        return rows.groupBy("__level").agg(
            F.sum("__units").alias("__total"), F.count("__units").alias("__count")
        )

    def encode_new(self, df: DataFrame, levels: DataFrame, output: str) -> DataFrame:
        """Statistics over all training rows; an unseen category gets the prior."""
        joined = self._with_level(df).join(levels, "__level", "left")
        total, n = F.coalesce("__total", F.lit(0)), F.coalesce("__count", F.lit(0))
        return joined.select(*df.columns, self._smoothed(total, n).alias(output))


@dataclass(frozen=True)
class AllTargetStatistics:
    """`TargetStatistics` of several categories in one long table: a row per row and category.

    Windows, totals and joins are shared, so their number does not grow with the categories; the encodings of
    a row come together once, by its key, which must be unique.
    """

    categories: tuple[str, ...]
    shared: TargetStatistics  # prior, unit and weight belong to the target alone

    @classmethod
    def fit(cls, df: DataFrame, categories: Sequence[str], target: str, key: str, weight: float = 1.0, unit: float | None = None):
        return cls(tuple(categories), TargetStatistics.fit(df, categories[0], target, key, weight, unit))

    def __iter__(self) -> Iterator[TargetStatistics]:
        """The statistics of each category by itself."""
        return (replace(self.shared, category=c) for c in self.categories)

    def _long(self, df: DataFrame, *more: Column) -> DataFrame:
        pairs = [
            F.struct(F.lit(i).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(TargetStatistics.MISSING)).alias("level"))
            for i, c in enumerate(self.categories)
        ]
        rows = df.select(F.col(self.shared.key).alias("__key"), *more, F.explode(F.array(*pairs)).alias("__pair"))
        return rows.select("*", F.col("__pair.c").alias("__c"), F.col("__pair.level").alias("__level")).drop("__pair")

    def _wide(self, df: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
        """``df`` with a column per category from (__key, __c, value)."""
        one = values.groupBy("__key").agg(*[F.max(F.when(F.col("__c") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])
        return df.join(one, df[self.shared.key] == one["__key"]).select(*[df[c] for c in df.columns], *names)

    def encode_training(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Running statistics over earlier rows, as `TargetStatistics.encode_training` gives them."""
        s = self.shared
        order = F.md5(F.col(s.key).cast("string").cast("binary"))
        rows = self._long(
            df, order.alias("__order"), F.substring(order, 1, s._digits).alias("__bucket"), _units(s.target, s.unit).alias("__units")
        )
        group = ["__c", "__level"]
        totals = rows.groupBy(*group, "__bucket").agg(F.sum("__units").alias("__total"), F.count("__units").alias("__count"))
        before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        prefix = totals.select(
            *group,
            "__bucket",
            F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__total_before"),
            F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__count_before"),
        )
        inside = Window.partitionBy(*group, "__bucket").orderBy("__order", "__key").rowsBetween(Window.unboundedPreceding, -1)
        total = F.coalesce(F.sum("__units").over(inside), F.lit(0)) + F.col("__total_before")
        n = F.count("__units").over(inside) + F.col("__count_before")
        met = rows.join(prefix, [*group, "__bucket"])
        return self._wide(df, met.select("__key", "__c", s._smoothed(total, n).alias("value")), names)

    def level_table(self, df: DataFrame) -> DataFrame:
        """Total and count per category and level over the training rows."""
        rows = self._long(df, _units(self.shared.target, self.shared.unit).alias("__units"))
        return rows.groupBy("__c", "__level").agg(F.sum("__units").alias("__total"), F.count("__units").alias("__count"))

    def encode_new(self, df: DataFrame, levels: DataFrame, names: Sequence[str]) -> DataFrame:
        """Statistics over all training rows; an unseen level gets the prior.  Rows of a level are spread by a salt."""
        salt = F.pmod(F.xxhash64("__key"), F.lit(SALTS))
        salted = levels.withColumn("__salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        met = self._long(df).withColumn("__salt", salt).join(salted, ["__c", "__level", "__salt"], "left")
        total, n = F.coalesce("__total", F.lit(0)), F.coalesce("__count", F.lit(0))
        return self._wide(df, met.select("__key", "__c", self.shared._smoothed(total, n).alias("value")), names)


def few_levels(df: DataFrame, columns: Sequence[str], most: int) -> dict[str, list[str]]:
    """The sorted levels of each column that has at most ``most`` of them; all columns in one job."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("level")) for i, c in enumerate(columns)]))
    levels = df.select(pairs.alias("p")).select("p.c", "p.level").filter("level IS NOT NULL").distinct()
    place = F.row_number().over(Window.partitionBy("c").orderBy("level"))
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in levels.withColumn("place", place).filter(F.col("place") <= most + 1).orderBy("c", "place").collect():
        found[columns[row["c"]]].append(row["level"])
    return {c: v for c, v in found.items() if len(v) <= most}


def _units(target: str, unit: float) -> Column:
    return F.round(F.col(target) / F.lit(unit)).cast("bigint")
