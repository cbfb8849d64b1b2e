"""Linear models of folds and penalties from moments, stacked boosters, runs of all models."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabloom.operators import foldwise, tune
from tabloom.operators.boost import leaf_booster, level_booster
from tabloom.operators.linear import ElasticNet, Ols, Ridge
from tabloom.operators.stack import out_of_fold, stack_boosters
from tabloom.plans.run_all import default_regressors, fit_all, refit_all
from tabloom.sources.sinks import read_results

ROWS = 200
COLUMNS = ["a", "b", "c"]


def column(df, name="prediction"):
    return np.array([r[name] for r in df.orderBy("row_id").collect()])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1000, 3, (ROWS, 3))
    y = x @ np.array([2.0, -1.0, 0.0]) + rng.normal(0, 0.5, ROWS)
    rows = [(i, *map(float, x[i]), float(y[i]), i % 4) for i in range(ROWS)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, label double, fold int")
    return df.repartition(5).cache()


def test_fold_fits_equal_fits_on_the_other_folds(table):
    vectors = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(table)
    want, _ = out_of_fold(vectors, lambda train, _: Ols().fit(train), 4)
    fits = foldwise.fit_folds(table, COLUMNS, "label")
    np.testing.assert_allclose(column(fits.out_of_fold(table)), column(want), rtol=1e-8)
    mean = np.mean([column(f.transform(table)) for f in fits.fits.values()], axis=0)
    np.testing.assert_allclose(column(fits.mean(table)), mean, rtol=1e-10)


@pytest.mark.parametrize("alpha,share", [(0.0, 0.0), (50.0, 0.0), (0.4, 0.5), (0.4, 1.0)])
def test_penalties_are_those_of_the_estimators(table, alpha, share):
    vectors = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(table)
    estimator = Ridge(alpha=alpha) if share == 0 else ElasticNet(alpha=alpha, l1Ratio=share)
    want = estimator.fit(vectors)
    moments = foldwise.fold_moments(table, COLUMNS, "label", F.lit(0))[0]
    got = foldwise.solved(moments, COLUMNS, alpha, share)
    np.testing.assert_allclose(got.weights, want.coefficients.toArray(), atol=1e-5)


def test_errors_from_moments_are_those_of_the_rows(table):
    candidates = [{"alpha": 1.0}, {"alpha": 5000.0}]
    best, trials = foldwise.linear_grid(table, COLUMNS, "label", candidates)
    assert len(trials) == 8
    for t, _, k, score in trials:
        others = foldwise.fold_moments(table.filter(F.col("fold") != k), COLUMNS, "label", F.lit(0))[0]
        fit = foldwise.solved(others, COLUMNS, candidates[t]["alpha"])
        assert score == pytest.approx(tune.holdout_rmse(fit.transform(table.filter(F.col("fold") == k)), "label"))
    whole = foldwise.solved(foldwise.fold_moments(table, COLUMNS, "label", F.lit(0))[0], COLUMNS, 1.0)
    np.testing.assert_allclose(best.weights, whole.weights)


def test_rows_with_missing_values_and_constant_columns(spark):
    rows = [(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (None, 5.0, 9.0), (3.0, 5.0, 6.0), (4.0, 5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    moments = foldwise.fold_moments(df, ["a", "b"], "label", F.lit(0))
    assert moments[0].n == 3
    fit = foldwise.solved(moments[0], ["a", "b"])
    np.testing.assert_allclose([*fit.weights, fit.intercept], [2.0, 0.0, 0.0], atol=1e-9)
    assert foldwise.fold_moments(df.limit(0), ["a", "b"], "label", F.lit(0)) == {}


def test_stacked_boosters_equal_fold_by_fold_fits(table):
    base = {
        "level": level_booster(COLUMNS, trees=2, max_depth=2, learning_rate=0.5),
        "leaf": leaf_booster(COLUMNS, trees=2, max_leaves=3, learning_rate=0.5, min_rows=5, max_bins=64, patience=None),
    }
    # few values, so that a border lies at each of them in every fold: bins come from all rows when folds grow together
    few = table.select("row_id", "fold", "label", *[F.round((F.col(c) - 1000) / 4).alias(c) for c in COLUMNS])
    few = few.select("row_id", "fold", "label", *[F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)).alias(c) for c in COLUMNS]).cache()
    train, test = few.filter("row_id < 160"), few.filter("row_id >= 160")
    result = stack_boosters(train, test, base, 4, "label")
    for name, booster in base.items():
        models = [booster.fit(train, F.col("fold") == k) for k in range(4)]
        inside = np.array([column(m.transform(train)) for m in models])
        folds = column(train, "fold")
        np.testing.assert_allclose(column(result.train, name), inside[folds, np.arange(len(folds))], rtol=1e-9)
        np.testing.assert_allclose(column(result.test, name), np.mean([column(m.transform(test)) for m in models], axis=0), rtol=1e-9)
    assert set(result.test.columns) == {"row_id", "level", "leaf", "prediction"}


def test_every_family_runs_and_is_ranked(spark, table, tmp_path):
    ready = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(
        table.select("row_id", *[((F.col(c) - 1000) / 3).alias(c) for c in COLUMNS], (F.col("label") / 1000).alias("label"))
    ).withColumn("target", F.exp("label") - 1)
    train, holdout = ready.filter("row_id % 5 <> 0").cache(), ready.filter("row_id % 5 = 0").cache()
    regressors = default_regressors(COLUMNS, "features", "label", trees=3, points=16)
    board = fit_all(regressors, train, holdout, "target", str(tmp_path / "results"), "run")
    assert len(regressors) == 12 and board.count() == 12
    assert {r["model"] for r in read_results(spark, str(tmp_path / "results")).collect()} == set(regressors)
    model = refit_all(regressors["LevelBoosting"], train, holdout)
    want = level_booster(COLUMNS, trees=3).fit(ready)
    np.testing.assert_allclose(column(model.transform(ready)), column(want.transform(ready)), rtol=1e-9)
