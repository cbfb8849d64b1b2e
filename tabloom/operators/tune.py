"""Hyperparameter search: grid with cross-validation, grid or random trials on a holdout."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.metrics import rmse
from tabloom.operators.boost import Booster, BoosterModel, fit_together

Parameters = dict[str, float | int]
TRIAL_SCHEMA = "trial_id int, params map<string,double>, fold int, score double"


def parameter_grid(grid: Mapping[str, Iterable[float]]) -> list[Parameters]:
    """Every combination of the listed values."""
    names = list(grid)
    return [dict(zip(names, values, strict=True)) for values in product(*(grid[n] for n in names))]


@dataclass(frozen=True)
class Uniform:
    """A range to draw from: plain, logarithmic, or whole numbers only."""

    low: float
    high: float
    log: bool = False
    integer: bool = False

    def draw(self, rng: random.Random) -> float | int:
        if self.integer and not self.log:
            return rng.randint(int(self.low), int(self.high))
        if not self.log:
            return rng.uniform(self.low, self.high)
        value = float(np.exp(rng.uniform(np.log(self.low), np.log(self.high))))
        return round(value) if self.integer else value

    def scaled(self, value: float) -> float:
        """The place of a value in the range, from 0 to 1."""
        low, high, x = (math.log(v) if self.log else v for v in (self.low, self.high, value))
        return (x - low) / (high - low) if high > low else 0.5

    def at(self, place: float) -> float | int:
        """The value at a place in the range."""
        low, high = (math.log(v) if self.log else v for v in (self.low, self.high))
        value = low + min(max(place, 0.0), 1.0) * (high - low)
        value = math.exp(value) if self.log else value
        return min(max(round(value), math.ceil(self.low)), math.floor(self.high)) if self.integer else value


def random_candidates(space: Mapping[str, Uniform], trials: int, seed: int = 42) -> list[Parameters]:
    """Seeded independent draws from the space."""
    rng = random.Random(seed)
    return [{name: part.draw(rng) for name, part in space.items()} for _ in range(trials)]


def proposals(
    space: Mapping[str, Uniform],
    scored: Sequence[tuple[Parameters, float]],
    count: int,
    seed: int,
    good_share: float = 0.25,
    tried: int = 24,
) -> list[Parameters]:
    """New settings where good ones are denser than bad ones.

    The settings with the least scores are good, the others bad.  In each parameter, both are a mixture of normal
    curves around their values and an even one; ``tried`` draws from the good mixture are made for a proposal, and the one
    with the largest ratio of the densities is it (Bergstra et al. 2011).  The draws are seeded.
    """
    rng = random.Random(seed)
    ranked = [p for p, _ in sorted(scored, key=lambda t: t[1])]
    cut = max(1, math.ceil(good_share * len(ranked)))
    good, bad = ranked[:cut], ranked[cut:]

    def density(part: Uniform, name: str, rows: Sequence[Parameters], place: float) -> float:
        width = max(0.05, (len(rows) + 1) ** -0.5 / 2)
        curves = [math.exp(-0.5 * ((place - part.scaled(r[name])) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for r in rows]
        return (1.0 + sum(curves)) / (len(rows) + 1)

    def drawn(part: Uniform, name: str) -> float:
        chosen = rng.randrange(len(good) + 1)
        if chosen == len(good):
            return rng.random()
        return min(max(rng.gauss(part.scaled(good[chosen][name]), max(0.05, (len(good) + 1) ** -0.5 / 2)), 0.0), 1.0)

    found = []
    for _ in range(count):
        best = None
        for _ in range(tried):
            places = {name: drawn(part, name) for name, part in space.items()}
            ratio = sum(
                math.log(density(part, name, good, places[name])) - math.log(density(part, name, bad, places[name]))
                for name, part in space.items()
            )
            if best is None or ratio > best[0]:
                best = ratio, places
        found.append({name: part.at(best[1][name]) for name, part in space.items()})
    return found


def adaptive_search(
    df: DataFrame,
    booster: Booster,
    space: Mapping[str, Uniform],
    is_validation: Column,
    rounds: int = 3,
    per_round: int = 6,
    rungs: Sequence[int] = (5, 10, 20),
    keep: float = 0.5,
    seed: int = 42,
) -> tuple[BoosterModel, DataFrame]:
    """Search by successive halving, each round proposed from what the earlier ones found.

    A round's settings grow together, to the trees of the first rung; the better share of them goes on from its
    models to the next rung, and so on.  The first round is drawn at random, the others come from `proposals` over
    the errors at the first rung, which all settings reach.  Returns the best model of the last rung and
    (trial_id, params, fold, score), the fold being the rung.  Persist ``df``.
    """
    fold = F.when(is_validation, 1).otherwise(0)
    scored: list[tuple[Parameters, float]] = []
    rows, best = [], None
    for turn in range(rounds):
        settings = random_candidates(space, per_round, seed) if not scored else proposals(space, scored, per_round, seed + turn)
        alive = [(turn * per_round + i, c, None) for i, c in enumerate(settings)]
        for rung, trees in enumerate(rungs):
            more = trees - (rungs[rung - 1] if rung else 0)
            boosters = [booster.with_params(**c).with_params(trees=more, patience=None, cut_to_best=False) for _, c, _ in alive]
            models = fit_together(df, boosters, [1] * len(alive), fold, [m for _, _, m in alive])
            errors = [next(e for i, part, e, _ in reversed(m.curve) if part == "validation") for m in models]
            for (trial, c, _), error in zip(alive, errors, strict=True):
                rows.append((trial, {name: float(v) for name, v in c.items()}, rung, error))
                if rung == 0:
                    scored.append((c, error))
            order = sorted(range(len(alive)), key=lambda i: (errors[i], i))
            if rung == len(rungs) - 1:
                if best is None or errors[order[0]] < best[0]:
                    best = errors[order[0]], models[order[0]]
            else:
                order = order[: max(1, math.ceil(keep * len(alive)))]
                alive = [(alive[i][0], alive[i][1], models[i]) for i in sorted(order)]
    return best[1], df.sparkSession.createDataFrame(rows, TRIAL_SCHEMA)


def run_trials(
    spark: SparkSession,
    candidates: Sequence[Parameters],
    objective: Callable[[DataFrame, DataFrame, Parameters], float],
    splits: Sequence[tuple[DataFrame, DataFrame]],
    parallelism: int = 4,
) -> DataFrame:
    """Score every candidate on every (training, validation) split; one row per trial and split.

    Trials are submitted from ``parallelism`` driver threads; each fit is a
    distributed job of its own.  Persist the frames in ``splits``: every trial
    reads them.
    """
    jobs = [(t, f) for t in range(len(candidates)) for f in range(len(splits))]

    def score(job: tuple[int, int]) -> tuple:
        trial, fold = job
        train, validation = splits[fold]
        shown = {name: float(value) for name, value in candidates[trial].items()}
        return trial, shown, fold, float(objective(train, validation, candidates[trial]))

    with ThreadPool(max(1, parallelism)) as pool:
        rows = pool.map(score, jobs, chunksize=1)
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def trial_scores(trials: DataFrame) -> DataFrame:
    """Mean score per trial over its folds."""
    return trials.groupBy("trial_id").agg(F.first("params").alias("params"), F.avg("score").alias("score"))


def best_trial(trials: DataFrame, minimize: bool = True) -> DataFrame:
    """One row: the best trial, its parameters and score, and the number of trials.

    The lowest trial number wins a tie.
    """
    sign = 1 if minimize else -1
    order = F.struct((F.col("score") * sign).alias("score"), F.col("trial_id"))
    return trial_scores(trials).agg(
        F.min_by("trial_id", order).alias("trial_id"),
        F.min_by("params", order).alias("params"),
        F.min_by("score", order).alias("score"),
        F.count(F.lit(1)).alias("trials"),
    )


def grid_search(
    estimator: Estimator,
    grid: Mapping[Param, Sequence],
    df: DataFrame,
    fold_column: str,
    folds: int,
    evaluator: Evaluator,
    parallelism: int = 4,
) -> tuple[Model, DataFrame]:
    """Exhaustive grid with cross-validation; the best setting refitted on all of ``df``.

    Returns the model and (trial_id, params, score) with the mean score of each
    setting.
    """
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(param, list(values))
    maps = builder.build()
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=evaluator,
        numFolds=folds,
        foldCol=fold_column,
        parallelism=parallelism,
        collectSubModels=False,
    ).fit(df)
    rows = [
        (i, {p.name: float(v) for p, v in setting.items()}, float(score))
        for i, (setting, score) in enumerate(zip(maps, search.avgMetrics, strict=True))
    ]
    trials = df.sparkSession.createDataFrame(rows, "trial_id int, params map<string,double>, score double")
    return search.bestModel, trials


def booster_grid(
    df: DataFrame,
    booster: Booster,
    candidates: Sequence[Parameters],
    fold_column: str,
    folds: int,
    models_at_once: int = 64,
) -> tuple[BoosterModel, DataFrame]:
    """Cross-validated search over boosters; the best setting refitted on all of ``df``.

    All folds of up to ``models_at_once`` / ``folds`` candidates grow in the same passes over one binned
    table.  Returns the model and (trial_id, params, fold, score), the score being the RMSE on the fold with
    the trees that predict: all of them, or with ``patience`` those up to the best iteration.  Persist ``df``.
    """
    spark = df.sparkSession
    jobs = [(t, k) for t in range(len(candidates)) for k in range(folds)]
    settings = [booster.with_params(**c) for c in candidates]
    rows = []
    portion = max(1, models_at_once // folds) * folds
    for first in range(0, len(jobs), portion):
        part = jobs[first : first + portion]
        models = fit_together(df, [settings[t] for t, _ in part], [k for _, k in part], F.col(fold_column))
        for (trial, fold), model in zip(part, models, strict=True):
            shown = {name: float(value) for name, value in candidates[trial].items()}
            errors = {iteration: e for iteration, split, e, _ in model.curve if split == "validation"}
            if model.best_iteration in errors:  # a fold without rows has no score
                rows.append((trial, shown, fold, errors[model.best_iteration]))
    trials = spark.createDataFrame(rows, TRIAL_SCHEMA)
    best = best_trial(trials).first()["trial_id"]
    return replace(settings[best], patience=None).fit(df), trials


def holdout_rmse(scored: DataFrame, label: str, prediction: str = "prediction") -> float:
    """RMSE of a scored frame as a number, for use inside an objective."""
    return scored.agg(rmse(F.col(label), F.col(prediction)).alias("rmse")).first()["rmse"]


def fold_splits(df: DataFrame, fold_column: str, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(other folds, this fold) for each fold."""
    return [(df.filter(F.col(fold_column) != k), df.filter(F.col(fold_column) == k)) for k in range(folds)]
