"""Second-order gradient boosting for squared error, on distributed histograms.

The gain and leaf formulas are those of Chen & Guestrin (2016); growth can be
level-wise, best leaf first, or symmetric.  Any number of boosters is fitted
together on one binned table: a scan serves the current tree of every fold and
setting, and the margins of all models are a row's state, refreshed once per round.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.encode import AllTargetStatistics, few_levels, indicator_columns
from tabloom.operators.histtree import (
    TRAIN,
    VALIDATION,
    Batch,
    Binning,
    Fit,
    Growth,
    SplitRules,
    Tree,
    TreeTask,
    binned_table,
    encoded_row_bytes,
    grow_trees,
    kept_blocks,
    uniform_draw,
    with_state,
    written_blocks,
)
from tabloom.session import narrow_rows, release, write_and_reread

CURVE_SCHEMA = "iter int, split string, rmse double, r2 double, elapsed double"
NODE_SCHEMA = "tree int, node int, feature int, bin int, left int, value double, missing_left boolean, subset array<int>"


@dataclass(frozen=True)
class BoosterModel:
    binning: Binning
    start: float
    trees: tuple[Tree, ...]
    best_iteration: int
    curve: tuple[tuple[int, str, float, float], ...] = ()  # iteration, part, RMSE, R2
    elapsed: tuple[float, ...] = ()  # seconds from the start of the fit, for each line of the curve

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Add the prediction: one vectorised call per Arrow batch over the feature columns."""
        binning, start, trees = self.binning, self.start, self.trees[: self.best_iteration]

        @F.pandas_udf("double")
        def score(*series: pd.Series) -> pd.Series:
            bins = binning.matrix([s.to_numpy() for s in series])
            total = np.full(len(series[0]), start)
            for tree in trees:
                total += tree.predict(bins)
            return pd.Series(total)

        return df.withColumn(prediction, score(*binning.inputs()))

    def staged_errors(self, df: DataFrame, label: str) -> DataFrame:
        """(iter, n, rmse) of the model cut off after 0, 1, 2, ... trees, in one scan of ``df``.

        Rows without a label are left out; without rows there is no result.
        """
        binning, start, trees = self.binning, self.start, self.trees
        inputs = [c.alias(f"x{i}") for i, c in enumerate(binning.inputs())]
        rows = df.select(*inputs, F.col(label).cast("double").alias("y")).filter("y IS NOT NULL")

        def fold(batches):
            sse, n = np.zeros(len(trees) + 1), 0
            for batch in batches:
                bins = binning.matrix([batch.column(i).to_numpy(zero_copy_only=False) for i in range(binning.width)])
                rest = batch.column(binning.width).to_numpy(zero_copy_only=False) - start
                n += len(rest)
                sse[0] += rest @ rest
                for k, tree in enumerate(trees, start=1):
                    rest = rest - tree.predict(bins)
                    sse[k] += rest @ rest
            if n:
                columns = [np.arange(len(sse), dtype=np.int32), sse, np.full(len(sse), n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["iter", "sse", "n"])

        sums = rows.mapInArrow(fold, "iter int, sse double, n bigint").groupBy("iter").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"))
        return sums.select("iter", "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))

    def cut_at(self, trees: int) -> BoosterModel:
        """The model of the first ``trees`` trees."""
        return replace(self, best_iteration=min(trees, len(self.trees)))

    def cut_at_first_rise(self, df: DataFrame, label: str) -> BoosterModel:
        """The model before the first tree that does not lower the error on ``df``: what refits with 1, 2, ... trees find."""
        rows = sorted(self.staged_errors(df, label).collect())
        for earlier, later in zip(rows[1:], rows[2:]):
            if later["rmse"] >= earlier["rmse"]:
                return self.cut_at(earlier["iter"])
        return self.cut_at(len(self.trees))

    def training_log(self, spark: SparkSession) -> DataFrame:
        """(iter, split, rmse, r2, elapsed seconds) for every iteration, 0 being the constant start."""
        return spark.createDataFrame([(*line, t) for line, t in zip(self.curve, self.elapsed, strict=True)], CURVE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and log as tables, the rest as one JSON line."""
        nodes = [
            (t, i, tree.feature[i], tree.bin[i], tree.left[i], float(tree.value[i]), bool(tree.missing_left[i]), list(tree.subset[i]))
            for t, tree in enumerate(self.trees)
            for i in range(len(tree.feature))
        ]
        spark.createDataFrame(nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        self.training_log(spark).write.mode("overwrite").parquet(f"{path}/log")
        about = {"start": self.start, "best_iteration": self.best_iteration, "binning": asdict(self.binning)}
        spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoosterModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        trees: dict[int, Tree] = {}
        for row in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            tree = trees.setdefault(row["tree"], Tree([], [], [], [], [], []))
            for name in ("feature", "bin", "left", "value", "missing_left"):
                getattr(tree, name).append(row[name])
            tree.subset.append(tuple(row["subset"]))
        log = spark.read.parquet(f"{path}/log").orderBy("iter", "split").collect()
        binning = {
            name: tuple(tuple(v) if isinstance(v, list) else v for v in values) for name, values in about["binning"].items()
        }
        return cls(
            binning=Binning(**binning),
            start=about["start"],
            trees=tuple(trees[i] for i in sorted(trees)),
            best_iteration=about["best_iteration"],
            curve=tuple(tuple(row)[:4] for row in log),
            elapsed=tuple(row["elapsed"] for row in log),
        )


@dataclass(frozen=True)
class Booster:
    """Boosting settings.

    ``categories`` are split by subsets of their levels; they need no encoding.
    ``row_share`` and ``column_share`` sample per tree, ``weight_temperature``
    draws Bayesian bootstrap weights, ``split_noise`` adds normal noise to
    gains in units of the first residuals' deviation.  With ``patience`` and
    validation rows, training ends after that many iterations without a lower
    validation error, and the best iteration is kept.  ``trees_per_table`` is
    how many rounds pass before the margins are written out again.
    """

    columns: Sequence[str]
    label: str = "label"
    key: str = "row_id"
    trees: int = 100
    learning_rate: float = 0.1
    growth: Growth = field(default_factory=Growth)
    rules: SplitRules = field(default_factory=SplitRules)
    max_bins: int = 64
    cut_to_best: bool = True  # predict with the trees up to the least validation error only
    row_share: float = 1.0
    column_share: float = 1.0
    weight_temperature: float = 0.0
    split_noise: float = 0.0
    patience: int | None = None
    seed: int = 42
    trees_per_table: int = 10
    categories: Sequence[str] = ()

    def with_params(self, **params) -> Booster:
        """A copy with other settings; names of growth and rule fields are understood too."""
        own, growth, rules = {}, {}, {}
        for name, value in params.items():
            if name in Growth.__dataclass_fields__:
                growth[name] = value
            elif name in SplitRules.__dataclass_fields__ and name != "seed":
                rules[name] = value
            else:
                own[name] = value
        return replace(self, growth=replace(self.growth, **growth), rules=replace(self.rules, **rules), **own)

    def fit(
        self, df: DataFrame, is_validation: Column | None = None, start_from: BoosterModel | None = None
    ) -> BoosterModel:
        """Fit on the rows with a label; rows where ``is_validation`` holds only measure the error.

        ``start_from`` is a model whose trees are kept and whose margins the first new tree starts from; ``trees``
        more are added.
        """
        fold = None if is_validation is None else F.when(is_validation, VALIDATION).otherwise(TRAIN)
        held = None if is_validation is None else VALIDATION
        return fit_together(df, [self], [held], fold, [start_from])[0]

    def gradients(self, step: int):
        """Gradient, weight (None for ones) and residual of squared error at the margins of a batch."""
        share, temperature, seed = self.row_share, self.weight_temperature, self.seed

        def of(batch: Batch, margin: np.ndarray):
            residual = margin - batch.y
            if temperature <= 0 and share >= 1:
                return residual, None, residual
            weight = np.ones(len(residual))
            if temperature > 0:
                weight = (-np.log(uniform_draw(batch.u, seed + 1, step))) ** temperature
            if share < 1:
                weight = np.where(uniform_draw(batch.u, seed, step) < share, weight, 0.0)
            return residual * weight, weight, residual

        return of

    def tree_features(self, step: int) -> tuple[int, ...]:
        """The features that the tree of a step may use."""
        width = len(self.columns) + len(self.categories)
        wanted = max(1, round(self.column_share * width))
        return tuple(sorted(random.Random(self.seed * 1_000_003 + step).sample(range(width), wanted)))


def fit_together(
    df: DataFrame,
    boosters: Sequence[Booster],
    held: Sequence[int | None],
    fold: Column | None = None,
    start_from: Sequence[BoosterModel | None] | None = None,
) -> list[BoosterModel]:
    """Fit several boosters in the same passes over one binned table.

    Booster i learns from the rows whose ``fold`` is not ``held[i]``, and measures on the others.  All
    must agree in columns, categories, label, key and number of bins, for they share the bins; these
    come from every row that one of the boosters learns from, or from the models in ``start_from`` that
    boosters go on from.
    """
    lead = boosters[0]
    earlier = [None] * len(boosters) if start_from is None else list(start_from)
    known = [m.binning for m in earlier if m is not None]
    if any(b != known[0] for b in known):
        raise ValueError("models that are continued together must have the same bins")
    for name in ("columns", "categories", "label", "key", "max_bins"):
        if any(getattr(b, name) != getattr(lead, name) for b in boosters):
            raise ValueError(f"boosters that are fitted together must agree in {name}")
    clock = time.monotonic()
    labelled = df.filter(F.col(lead.label).isNotNull())
    folded = labelled if fold is None else labelled.withColumn("__fold", F.coalesce(fold.cast("int"), F.lit(-1)))
    moments = _fold_moments(folded, lead.label, fold is not None)
    if known:
        binning = known[0]
    else:
        learned = folded if len(set(held)) > 1 or held[0] is None else folded.filter(F.col("__fold") != held[0])
        binning = Binning.fit(learned, lead.columns, lead.max_bins, categories=lead.categories)
    runs = [_Run(b, h, moments, m) for b, h, m in zip(boosters, held, earlier, strict=True)]
    fold_column = None if fold is None else F.col("__fold")
    with narrow_rows(df.sparkSession, encoded_row_bytes(binning.width)):
        table = written_blocks(
            binned_table(folded, binning, lead.label, lead.key, [r.start for r in runs], fold_column, [r.trees for r in runs]), "binned"
        )
    outdated: list[DataFrame] = []
    try:
        for step in range(max(b.trees for b in boosters)):
            active = [m for m, r in enumerate(runs) if r.active(step)]
            if not active:
                break
            grown = grow_trees(
                table,
                binning,
                [runs[m].task(m, step) for m in active],
                with_fit=True,
                stop_if=lambda i, fit, a=tuple(active): runs[a[i]].record(fit, time.monotonic() - clock),
            )
            while outdated:
                release(outdated.pop())
            latest: dict[int, Tree] = {}
            for m, tree in zip(active, grown, strict=True):
                if tree is None:
                    runs[m].stopped = True
                else:
                    tree.value = [runs[m].booster.learning_rate * v for v in tree.value]
                    runs[m].trees.append(tree)
                    latest[m] = tree
            if latest:
                updated = with_state(table, binning.width, _added(latest))
                write = (step + 1) % lead.trees_per_table == 0
                outdated.append(table)
                table = written_blocks(updated, "margins") if write else kept_blocks(updated)
        unmeasured = [m for m, r in enumerate(runs) if not r.stopped]
        if unmeasured:
            fits = _measure(table, binning.width, unmeasured, [runs[m].held for m in unmeasured])
            for m, fit in fits.items():
                runs[m].record(fit, time.monotonic() - clock)
    finally:
        for old in outdated:
            release(old)
        release(table)
    return [r.model(binning) for r in runs]


class _Run:
    """A booster on its way: its trees, its error curve and the best iteration so far."""

    def __init__(self, booster: Booster, held: int | None, moments: dict[int, tuple[float, float, float]], start_from: BoosterModel | None):
        self.booster, self.held = booster, held
        own = [v for k, v in moments.items() if held is None or k != held]
        n, mean, spread = _pooled(own)
        self.variance = {TRAIN: spread / n if n else 0.0}
        if held in moments:
            count, _, other = _pooled([moments[held]])
            self.variance[VALIDATION] = other / count if count else 0.0
        self.start = mean if start_from is None else start_from.start
        self.trees: list[Tree] = [] if start_from is None else list(start_from.trees[: start_from.best_iteration])
        self.before = len(self.trees)
        self.rules = replace(booster.rules, noise=booster.split_noise * self.variance[TRAIN] ** 0.5, seed=booster.seed)
        earlier = [] if start_from is None else [i for i, line in enumerate(start_from.curve) if line[0] < self.before]
        self.curve = [start_from.curve[i] for i in earlier]
        self.elapsed = [start_from.elapsed[i] for i in earlier]
        self.best, self.least, self.stopped = 0, float("inf"), False
        for iteration, split, rmse, _ in self.curve:
            if split == "validation" and rmse**2 < self.least:
                self.best, self.least = iteration, rmse**2

    def active(self, step: int) -> bool:
        return not self.stopped and step < self.booster.trees

    def task(self, model: int, step: int) -> TreeTask:
        step += self.before
        b = self.booster
        return TreeTask(b.growth, self.rules, b.gradients(step), b.tree_features(step), model, self.held, step)

    def record(self, fit: Fit, elapsed: float) -> bool:
        """Note the errors with the trees so far; true where training should end."""
        done = len(self.trees)
        for part, name in ((TRAIN, "train"), (VALIDATION, "validation")):
            if fit.n.get(part):
                mse = fit.sse[part] / fit.n[part]
                r2 = 1 - mse / self.variance[part] if self.variance.get(part) else None
                self.curve.append((done, name, float(np.sqrt(mse)), r2))
                self.elapsed.append(elapsed)
        if not fit.n.get(VALIDATION):
            self.best = done
            return False
        error = fit.sse[VALIDATION] / fit.n[VALIDATION]
        if error < self.least:
            self.best, self.least = done, error
        return self.booster.patience is not None and done - self.best >= self.booster.patience

    def model(self, binning: Binning) -> BoosterModel:
        cut = self.booster.cut_to_best and self.held is not None
        best = self.best if cut else len(self.trees)
        return BoosterModel(binning, self.start, tuple(self.trees), best, tuple(self.curve), tuple(self.elapsed))


def _fold_moments(df: DataFrame, label: str, folded: bool) -> dict[int, tuple[float, float, float]]:
    """Rows, mean and sum of squared deviations of the label per fold."""
    y = F.col(label).cast("double")
    rows = df.groupBy("__fold" if folded else F.lit(TRAIN).alias("__fold")).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("v")
    )
    return {r["__fold"]: (float(r["n"]), float(r["mean"]), float(r["v"] * r["n"])) for r in rows.collect()}


def _pooled(parts: Sequence[tuple[float, float, float]]) -> tuple[float, float, float]:
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n if n else 0.0
    return n, mean, sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)


def _added(latest: dict[int, Tree]):
    """The margins with the outputs of each model's newest tree."""

    def change(batch: Batch) -> np.ndarray:
        state = batch.state.copy()
        for m, tree in latest.items():
            state[:, m] += tree.predict(batch.bins)
        return state

    return change


def _measure(table: DataFrame, width: int, models: Sequence[int], held: Sequence[int | None]) -> dict[int, Fit]:
    """Squared residuals and rows per model and part, with all trees in place."""

    def fold(batches):
        sums = np.zeros((len(models), 4))
        for arrow in batches:
            batch = Batch.of(arrow, width)
            for i, (m, h) in enumerate(zip(models, held, strict=True)):
                residual = batch.state[:, m] - batch.y
                out = batch.fold == (-2 if h is None else h)
                for part, of in ((0, ~out), (2, out)):
                    sums[i, part : part + 2] += (residual[of] @ residual[of], of.sum())
        columns = [np.array(models, dtype=np.int32), *sums.T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["m", "a", "b", "c", "d"])

    partial = table.mapInArrow(fold, "m int, a double, b double, c double, d double")
    rows = partial.groupBy("m").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()
    return {r["m"]: Fit({TRAIN: r["a"], VALIDATION: r["c"]}, {TRAIN: r["b"], VALIDATION: r["d"]}) for r in rows}


# ---------------------------------------------------------------- presets


LEVEL_RULES = SplitRules(l2=1.0, min_weight=1.0, prune_after=True, learn_missing=True)


def level_booster(columns: Sequence[str], label: str = "label", **params) -> Booster:
    """Level-wise trees with L1/L2 penalties, minimum child weight, learned direction of missing values and pruning by gain.

    Validation rows only measure; without ``patience`` all trees predict.
    """
    base = Booster(columns, label, trees=1000, growth=Growth("level", 6), rules=LEVEL_RULES, cut_to_best=False)
    made = base.with_params(**params)
    return made if made.patience is None or "cut_to_best" in params else replace(made, cut_to_best=True)


def leaf_booster(columns: Sequence[str], label: str = "label", **params) -> Booster:
    """Best-leaf-first trees without a depth limit, row and column sampling, early stopping."""
    base = Booster(
        columns,
        label,
        trees=2000,
        learning_rate=0.03,
        growth=Growth("leaf", max_depth=64, max_leaves=64),
        rules=SplitRules(l2=0.3, l1=0.1, min_weight=1e-3, min_rows=20, learn_missing=True, category_rows=100, category_l2=10.0),
        max_bins=255,
        row_share=0.8,
        column_share=0.8,
        patience=50,
    )
    return base.with_params(**params)


@dataclass(frozen=True)
class CategoryBoosterModel:
    """A booster with the encodings of its category columns."""

    booster: BoosterModel
    statistics: AllTargetStatistics | None
    levels: DataFrame | None
    indicators: dict[str, list[str]]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        encoded = df
        if self.statistics is not None:
            encoded = self.statistics.encode_new(df, self.levels, _mean_names(self.statistics))
        encoded = _with_indicators(encoded, self.indicators)
        return self.booster.transform(encoded, prediction).select(*df.columns, prediction)


def _mean_names(statistics: AllTargetStatistics) -> list[str]:
    return [f"{c}__mean" for c in statistics.categories]


@dataclass(frozen=True)
class CategoryBooster:
    """Symmetric trees over numbers and categories.

    A category with at most ``one_hot_max_size`` levels becomes indicators, any
    other the ordered target statistics of `TargetStatistics`, all of them from one long table.
    """

    columns: Sequence[str]
    categories: Sequence[str]
    label: str = "label"
    key: str = "row_id"
    one_hot_max_size: int = 2
    unit: float | None = None
    booster: Booster | None = None

    def fit(self, df: DataFrame, is_validation: Column | None = None) -> CategoryBoosterModel:
        train = df if is_validation is None else df.filter(~is_validation)
        indicators = few_levels(train, list(self.categories), self.one_hot_max_size)
        coded = [c for c in self.categories if c not in indicators]
        statistics, levels, names, encoded = None, None, [], df
        if coded:
            statistics = AllTargetStatistics.fit(train, coded, self.label, self.key, unit=self.unit)
            levels, names = write_and_reread(statistics.level_table(train), "levels"), _mean_names(statistics)
            encoded = statistics.encode_training(train, names)
            if is_validation is not None:
                encoded = encoded.unionByName(statistics.encode_new(df.filter(is_validation), levels, names))
        encoded = _with_indicators(encoded, indicators)
        names = [*self.columns, *names, *[f"{c}_{level}" for c, own in indicators.items() for level in own]]
        base = self.booster or symmetric_booster((), self.label)
        ready = write_and_reread(encoded, "encoded")
        fitted = replace(base, columns=names, label=self.label, key=self.key).fit(ready, is_validation)
        release(ready)
        return CategoryBoosterModel(fitted, statistics, levels, indicators)


def _with_indicators(df: DataFrame, indicators: dict[str, list[str]]) -> DataFrame:
    copies = df.withColumns({f"__{c}": F.col(c) for c in indicators}) if indicators else df
    return indicator_columns(copies, indicators).withColumnsRenamed({f"__{c}": c for c in indicators})


def symmetric_booster(columns: Sequence[str], label: str = "label", **params) -> Booster:
    """Symmetric trees with an L2 leaf penalty."""
    base = Booster(
        columns,
        label,
        trees=1000,
        learning_rate=0.05,
        growth=Growth("symmetric", 6),
        rules=SplitRules(l2=3.0),
        max_bins=255,
        patience=50,
    )
    return base.with_params(**params)
