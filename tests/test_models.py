import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabloom.functions.splits import row_hash
from tabloom.operators import tune
from tabloom.operators.adaboost import AdaBoostR2
from tabloom.operators.bayes import BayesianRidge
from tabloom.operators.boost import Booster, BoosterModel, CategoryBooster, leaf_booster, level_booster, symmetric_booster
from tabloom.operators.gaussian import GaussianProcess
from tabloom.operators.histtree import Growth, SplitRules, uniform_draw
from tabloom.operators.linear import ElasticNet, Lasso, Ols, Ridge, polynomial_regression
from tabloom.operators.stack import out_of_fold, stack

ROWS = 240


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 6, ROWS), rng.integers(0, 4, ROWS), rng.integers(0, 9, ROWS)]).astype(float)
    y = 3.0 * x[:, 0] - 2.0 * x[:, 1] * (x[:, 0] > 2) + 0.5 * x[:, 2] + rng.normal(0, 0.3, ROWS)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    rows = [(i, *map(float, x[i]), float(y[i]), i % 3) for i in range(ROWS)]
    return spark.createDataFrame(rows, "row_id bigint, a double, b double, c double, label double, fold int").cache()


COLUMNS = ["a", "b", "c"]


def vectors(df):
    return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(df)


def column(df, name="prediction"):
    return np.array([r[name] for r in df.orderBy("row_id").collect()])


def centered(x, y):
    return x - x.mean(0), y - y.mean()


def test_ols_and_ridge_equal_the_normal_equations(table, data):
    xc, yc = centered(*data)
    for estimator, alpha in ((Ols(), 0.0), (Ridge(alpha=10.0), 10.0), (Ridge(alpha=500.0), 500.0)):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        np.testing.assert_allclose(estimator.fit(vectors(table)).coefficients.toArray(), want, rtol=1e-7)


@pytest.mark.parametrize("estimator,l1,l2", [(Lasso(alpha=0.3), 0.3, 0.0), (ElasticNet(alpha=0.4, l1Ratio=0.5), 0.2, 0.2)])
def test_lasso_and_elastic_net_meet_their_optimality_conditions(table, data, estimator, l1, l2):
    xc, yc = centered(*data)
    w = estimator.fit(vectors(table)).coefficients.toArray()
    slope = xc.T @ (yc - xc @ w) / ROWS - l2 * w
    for j in range(3):
        if w[j] != 0:
            assert slope[j] == pytest.approx(l1 * np.sign(w[j]), abs=1e-5)
        else:
            assert abs(slope[j]) <= l1 + 1e-6


def test_polynomial_regression_fits_a_quadratic(spark):
    df = spark.range(50).select((F.col("id") / 10).alias("x")).withColumn("label", 2 - F.col("x") + 3 * F.col("x") ** 2)
    scored = polynomial_regression(["x"]).fit(df).transform(df)
    assert scored.agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 1e-4


def test_bayesian_ridge_is_at_its_fixed_point(table, data):
    x, y = data
    xc, yc = centered(x, y)
    model = BayesianRidge(COLUMNS, tolerance=1e-12).fit(table)
    ratio = model.weight_precision / model.noise_precision
    w = np.linalg.solve(xc.T @ xc + ratio * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(model.coefficients, w, rtol=1e-8)
    eigenvalues = np.linalg.eigvalsh(xc.T @ xc)
    gamma = np.sum(model.noise_precision * eigenvalues / (model.weight_precision + model.noise_precision * eigenvalues))
    assert model.weight_precision == pytest.approx(gamma / (w @ w), rel=1e-4)
    assert model.noise_precision == pytest.approx((ROWS - gamma) / np.sum((yc - xc @ w) ** 2), rel=1e-4)
    std = column(model.transform(table, std="std"), "std")
    covariance = np.linalg.inv(model.noise_precision * xc.T @ xc + model.weight_precision * np.eye(3))
    np.testing.assert_allclose(std, np.sqrt(np.einsum("ij,jk,ik->i", xc, covariance, xc) + 1 / model.noise_precision))


def test_gaussian_process_is_exact_with_a_point_per_row(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=40)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(40)], "row_id long, a double, b double, label double")
    model = GaussianProcess(["a", "b"], points=64, lengths=(0.5,), amplitudes=(1.0,), noises=(0.1,)).fit(df)
    new = np.vstack([rng.normal(size=(5, 2)), [[60.0, -60.0]]])
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(new)], "row_id long, a double, b double")
    scored = model.transform(frame.repartition(3), std="std").orderBy("row_id").toPandas()
    kernel = lambda p, q: np.exp(-0.5 * ((p[:, None, :] - q[None, :, :]) ** 2).sum(2) / 0.5**2)
    z = (y - y.mean()) / y.std()
    inverse = np.linalg.inv(kernel(x, x) + 0.1 * np.eye(40))
    cross = kernel(new, x)
    np.testing.assert_allclose(scored["prediction"], cross @ inverse @ z * y.std() + y.mean(), atol=1e-5)
    variance = 1.0 - np.einsum("ij,jk,ik->i", cross, inverse, cross) + 0.1
    np.testing.assert_allclose(scored["std"], np.sqrt(variance) * y.std(), atol=1e-5)
    assert scored["std"].iloc[-1] == pytest.approx(np.sqrt(1.1) * y.std(), rel=1e-6)  # prior, far away
    sign, logdet = np.linalg.slogdet(kernel(x, x) + 0.1 * np.eye(40))
    evidence = -0.5 * (z @ inverse @ z + logdet + 40 * np.log(2 * np.pi))
    assert model.bound == pytest.approx(evidence, abs=1e-3)


def test_fitted_kernel_has_the_largest_evidence(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-3, 3, 60)
    y = np.sin(1.5 * x) * 2 + rng.normal(0, 0.2, 60)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "row_id long, a double, label double")
    model = GaussianProcess(["a"], points=64, lengths=(0.3, 1.0, 3.0), fit_kernel=True, passes=5).fit(df.repartition(4))
    z = (y - y.mean()) / y.std()
    squares = (x[:, None] - x[None, :]) ** 2

    def evidence(length, amplitude, noise):
        kernel = amplitude * np.exp(-0.5 * squares / length**2) + noise * np.eye(60)
        return -0.5 * (z @ np.linalg.solve(kernel, z) + np.linalg.slogdet(kernel)[1] + 60 * np.log(2 * np.pi))

    at = (model.length, model.amplitude, model.noise)
    assert model.bound == pytest.approx(evidence(*at), abs=0.05)
    best = max(evidence(a, b, c) for a in np.geomspace(0.2, 5, 40) for b in np.geomspace(0.1, 30, 40) for c in np.geomspace(0.003, 0.1, 30))
    assert evidence(*at) > best - 0.05
    for k in range(3):
        for factor in (0.9, 1.1):
            moved = [v * factor if i == k else v for i, v in enumerate(at)]
            assert evidence(*moved) < evidence(*at) + 0.02


class PlainTree:
    """A tree grown from raw rows, one node at a time."""

    def __init__(self, x, g, h, l2):
        self.x, self.g, self.h, self.l2 = x, g, h, l2

    def best(self, rows):
        def score(r):
            return self.g[r].sum() ** 2 / (self.h[r].sum() + self.l2) if len(r) else 0.0

        found = (0.0, None, None)
        for f in range(self.x.shape[1]):
            for cut in np.unique(self.x[rows, f])[:-1]:
                left, right = rows[self.x[rows, f] <= cut], rows[self.x[rows, f] > cut]
                gain = 0.5 * (score(left) + score(right) - score(rows))
                if gain > found[0] + 1e-12:
                    found = (gain, f, cut)
        return found

    def leaves(self, mode, depth, max_leaves):
        leaves = [(np.arange(len(self.g)), 0)]
        while len(leaves) < max_leaves:
            able = [(self.best(r), i) for i, (r, d) in enumerate(leaves) if d < depth]
            able = [(b, i) for b, i in able if b[1] is not None]
            if not able:
                break
            (_, f, cut), i = max(able, key=lambda t: t[0][0])
            rows, d = leaves.pop(i)
            leaves += [(rows[self.x[rows, f] <= cut], d + 1), (rows[self.x[rows, f] > cut], d + 1)]
        return [r for r, _ in leaves]

    def fitted(self, leaves):
        out = np.zeros(len(self.g))
        for r in leaves:
            out[r] = -self.g[r].sum() / (self.h[r].sum() + self.l2)
        return out


@pytest.mark.parametrize("mode,depth,leaves", [("level", 3, 10**6), ("leaf", 9, 7)])
def test_one_tree_equals_brute_force(table, data, mode, depth, leaves):
    x, y = data
    plain = PlainTree(x, y.mean() - y, np.ones(ROWS), 1.5)
    want = y.mean() + plain.fitted(plain.leaves(mode, depth, leaves))
    booster = Booster(COLUMNS, trees=1, learning_rate=1.0, growth=Growth(mode, depth, leaves), rules=SplitRules(l2=1.5))
    np.testing.assert_allclose(column(booster.fit(table).transform(table)), want, rtol=1e-9)


def test_symmetric_tree_shares_the_split_of_a_level(table, data):
    x, y = data
    model = symmetric_booster(COLUMNS, trees=1, max_depth=2, learning_rate=1.0, l2=1.0).fit(table)
    tree = model.trees[0]
    assert len({(tree.feature[v], tree.bin[v]) for v in (1, 2)}) == 1
    g = y.mean() - y
    best = max(
        (
            sum(g[m].sum() ** 2 / (m.sum() + 1.0) for m in (x[:, f] <= c, x[:, f] > c)) - g.sum() ** 2 / (ROWS + 1.0),
            f,
            c,
        )
        for f in range(3)
        for c in np.unique(x[:, f])[:-1]
    )
    assert tree.feature[0] == best[1]
    assert model.binning.borders[best[1]][tree.bin[0] - 1] == best[2]


def test_boosting_properties(spark, table, data, tmp_path):
    booster = level_booster(COLUMNS, trees=6, max_depth=2, learning_rate=0.5, trees_per_table=2)
    model = booster.fit(table)
    errors = [e for _, part, e, _ in model.curve if part == "train"]
    assert len(errors) == 7 and all(b <= a + 1e-12 for a, b in zip(errors, errors[1:]))
    scores = column(model.transform(table))
    assert errors[-1] == pytest.approx(np.sqrt(np.mean((scores - data[1]) ** 2)))
    np.testing.assert_allclose(column(booster.fit(table.repartition(5)).transform(table)), scores, rtol=1e-9)
    model.save(spark, str(tmp_path / "model"))
    np.testing.assert_array_equal(column(BoosterModel.load(spark, str(tmp_path / "model")).transform(table)), scores)
    flat = booster.with_params(l2=1e15).fit(table)
    np.testing.assert_allclose(column(flat.transform(table)), data[1].mean(), rtol=1e-6)


def test_early_stopping_keeps_the_best_iteration(table):
    model = level_booster(COLUMNS, trees=25, max_depth=1, learning_rate=1.95, patience=3).fit(table, F.col("fold") == 0)
    watched = [e for _, part, e, _ in model.curve if part == "validation"]
    assert model.best_iteration == int(np.argmin(watched))
    assert len(model.trees) <= model.best_iteration + 3


def test_sampling_does_not_depend_on_partitions(table):
    booster = leaf_booster(COLUMNS, trees=3, max_leaves=4, learning_rate=0.3, row_share=0.6, min_rows=5, patience=None)
    a = column(booster.fit(table).transform(table))
    np.testing.assert_allclose(column(booster.fit(table.repartition(6)).transform(table)), a, rtol=1e-9)
    noisy = symmetric_booster(COLUMNS, trees=2, max_depth=2, split_noise=0.5, weight_temperature=1.0, patience=None)
    np.testing.assert_allclose(
        column(noisy.fit(table).transform(table)), column(noisy.fit(table.repartition(3)).transform(table)), rtol=1e-9
    )


def test_category_booster_learns_a_category(spark):
    df = spark.range(300).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("z"), (F.col("id") * 7 % 5).cast("string")).alias("zone"),
        F.when(F.col("id") % 2 == 0, "Y").otherwise("N").alias("flag"),
        (F.col("id") % 10).cast("double").alias("x"),
    )
    df = df.withColumn("label", (F.col("row_id") * 7 % 5) * 10.0 + F.when(F.col("flag") == "Y", 3.0).otherwise(0.0))
    booster = symmetric_booster((), trees=5, max_depth=3, learning_rate=0.8, l2=0.1, patience=None)
    model = CategoryBooster(["x"], ["zone", "flag"], booster=booster).fit(df)
    assert set(model.indicators) == {"flag"} and [s.category for s in model.statistics] == ["zone"]
    scored = model.transform(df)
    assert scored.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 4.0
    unseen = df.limit(1).withColumn("zone", F.lit("new")).withColumn("flag", F.lit(None).cast("string"))
    assert model.transform(unseen).first()["prediction"] is not None


def test_adaboost_equals_brute_force(table, data):
    x, y = data
    weight, trees, votes, rate = np.ones(ROWS), [], [], 0.5
    for _ in range(3):
        plain = PlainTree(x, -weight * y, weight, 0.0)
        fitted = plain.fitted(plain.leaves("level", 2, 10**6))
        error = np.abs(y - fitted)
        average = (weight * error).sum() / (error.max() * weight.sum())
        if average >= 0.5:
            break
        beta = average / (1 - average)
        trees.append(fitted)
        votes.append(rate * np.log(1 / beta))
        weight = weight * beta ** ((1 - error / error.max()) * rate)
    outputs, votes = np.column_stack(trees), np.array(votes)
    order = np.argsort(outputs, axis=1)
    reached = np.cumsum(votes[order], axis=1)
    middle = np.argmax(reached >= 0.5 * reached[:, -1:], axis=1)
    want = outputs[np.arange(ROWS), order[np.arange(ROWS), middle]]
    model = AdaBoostR2(COLUMNS, rounds=3, max_depth=2, learning_rate=rate, rounds_per_table=2).fit(table)
    np.testing.assert_allclose(column(model.transform(table)), want, rtol=1e-9)


@pytest.mark.parametrize("range_rows", [10**6, 50])
def test_resampled_adaboost_equals_brute_force(table, data, range_rows):
    x, y = data
    hashes = {r["row_id"]: r["u"] for r in table.select("row_id", row_hash().alias("u")).collect()}
    order = np.array(sorted(range(ROWS), key=hashes.get))
    weight, trees, votes, rate = np.ones(ROWS), [], [], 0.5
    for step in range(3):
        gap, start = weight.sum() / ROWS, uniform_draw(np.array([step], dtype=np.uint64), 42, step)[0]
        edges = np.concatenate([[0.0], np.cumsum(weight[order])])
        drawn = np.zeros(ROWS)
        drawn[order] = np.diff(np.floor(edges / gap + start))
        assert drawn.sum() == ROWS
        plain = PlainTree(x, -drawn * y, drawn, 0.0)
        kept = plain.leaves("level", 2, 10**6)
        fitted = plain.fitted([r for r in kept if drawn[r].sum()])
        error = np.abs(y - fitted)
        average = (weight * error).sum() / (error.max() * weight.sum())
        assert average < 0.5
        beta = average / (1 - average)
        trees.append(fitted)
        votes.append(rate * np.log(1 / beta))
        weight = weight * beta ** ((1 - error / error.max()) * rate)
    outputs, votes = np.column_stack(trees), np.array(votes)
    best = np.argsort(outputs, axis=1)
    reached = np.cumsum(votes[best], axis=1)
    middle = np.argmax(reached >= 0.5 * reached[:, -1:], axis=1)
    want = outputs[np.arange(ROWS), best[np.arange(ROWS), middle]]
    booster = AdaBoostR2(COLUMNS, rounds=3, max_depth=2, learning_rate=rate, resample=True, range_rows=range_rows)
    np.testing.assert_allclose(column(booster.fit(table.repartition(3)).transform(table)), want, rtol=1e-9)


def test_out_of_fold_covers_every_row_once_and_stacking_combines(table):
    fit = lambda train, _: Ols().fit(train)
    oof, mean = out_of_fold(vectors(table), fit, 3, test=vectors(table))
    assert oof.count() == ROWS and oof.select("row_id").distinct().count() == ROWS
    assert mean.count() == ROWS
    base = {"ols": fit, "ridge": lambda train, _: Ridge(alpha=300.0).fit(train)}
    result = stack(vectors(table), vectors(table), base, folds=3, label="label")
    assert result.train.count() == ROWS and set(result.test.columns) == {"row_id", "ols", "ridge", "prediction"}


def test_random_trials_are_seeded_and_best_is_picked(spark):
    space = {"depth": tune.Uniform(2, 6, integer=True), "rate": tune.Uniform(0.01, 0.3, log=True)}
    candidates = tune.random_candidates(space, 5)
    assert candidates == tune.random_candidates(space, 5)
    assert all(c["depth"] == int(c["depth"]) and 0.01 <= c["rate"] <= 0.3 for c in candidates)
    frame = spark.range(1)
    trials = tune.run_trials(spark, candidates, lambda a, b, p: abs(p["rate"] - 0.1), [(frame, frame)] * 2)
    best = tune.best_trial(trials).first()
    assert trials.count() == 10 and best["trials"] == 5
    assert best["params"]["rate"] == min(candidates, key=lambda c: abs(c["rate"] - 0.1))["rate"]
