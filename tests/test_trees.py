"""The histogram core: missing values, category subsets, pruning, forests, folds and settings together."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import histtree, tune
from tabloom.operators.boost import Booster, BoosterModel, fit_together, leaf_booster, level_booster, symmetric_booster
from tabloom.operators.forest import Forest, poisson_counts
from tabloom.operators.histtree import Growth, SplitRules

ROWS = 260


def column(df, name="prediction"):
    return np.array([r[name] for r in df.orderBy("row_id").collect()])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 7, (ROWS, 2)).astype(float)
    x[rng.random(ROWS) < 0.25, 0] = np.nan
    level = rng.integers(0, 6, ROWS)
    effect = np.array([4.0, -3.0, 0.5, 4.2, -2.5, 1.0])
    y = np.where(np.isnan(x[:, 0]), 5.0, x[:, 0]) + effect[level] + rng.normal(0, 0.3, ROWS)
    return x, level, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, level, y = data
    rows = [
        (i, *[None if np.isnan(v) else float(v) for v in x[i]], None if i % 11 == 0 else f"lev{level[i]}", float(y[i]), i % 4)
        for i in range(ROWS)
    ]
    return spark.createDataFrame(rows, "row_id bigint, a double, b double, c string, label double, fold int").cache()


def side_score(g, rows, l2):
    return g[rows].sum() ** 2 / (rows.sum() + l2) if rows.any() else 0.0


def test_missing_values_take_the_better_side(table, data):
    x, _, y = data
    model = Booster(["a"], trees=1, learning_rate=1.0, growth=Growth("level", 1), rules=SplitRules(l2=1.0, learn_missing=True)).fit(table)
    g = y.mean() - y
    missing = np.isnan(x[:, 0])
    best = max(
        (side_score(g, left, 1.0) + side_score(g, ~left, 1.0), toward, cut)
        for cut in range(6)
        for toward in (True, False)
        for left in [(x[:, 0] <= cut) | (missing & toward)]
    )
    tree = model.trees[0]
    left = (x[:, 0] <= best[2]) | (missing & best[1])
    assert tree.missing_left[0] == best[1]
    want = y.mean() + np.where(left, -g[left].sum() / (left.sum() + 1.0), -g[~left].sum() / ((~left).sum() + 1.0))
    np.testing.assert_allclose(column(model.transform(table)), want, rtol=1e-9)


def test_a_category_splits_by_the_best_subset_of_its_levels(table, data):
    _, level, y = data
    rules = SplitRules(l2=1.0, category_smooth=0.0)
    model = Booster([], categories=["c"], trees=1, learning_rate=1.0, growth=Growth("level", 1), rules=rules).fit(table)
    g = y.mean() - y
    names = np.where(np.arange(ROWS) % 11 == 0, -1, level)
    best = max(
        (side_score(g, np.isin(names, chosen), 1.0) + side_score(g, ~np.isin(names, chosen), 1.0), chosen)
        for size in range(1, 7)
        for chosen in combinations(range(6), size)
    )
    left = np.isin(names, best[1])
    want = y.mean() + np.where(left, -g[left].sum() / (left.sum() + 1.0), -g[~left].sum() / ((~left).sum() + 1.0))
    np.testing.assert_allclose(column(model.transform(table)), want, rtol=1e-9)
    unseen = table.limit(1).withColumn("c", F.lit("new"))
    right = y.mean() - g[~left].sum() / ((~left).sum() + 1.0)
    assert model.transform(unseen).first()["prediction"] == pytest.approx(right)


def test_rare_levels_stay_together(table):
    binning = histtree.Binning.fit(table, [], 3, categories=["c"])
    assert len(binning.levels[0]) == 2 and binning.sizes == [4]
    rules = SplitRules(category_rows=1000)
    model = Booster([], categories=["c"], trees=1, rules=rules, growth=Growth("level", 1)).fit(table)
    assert model.trees[0].feature == [-1]


def test_category_models_are_saved_with_their_subsets(spark, table, tmp_path):
    model = leaf_booster(["a", "b"], categories=["c"], trees=4, max_leaves=6, min_rows=5, category_rows=5, patience=None).fit(table)
    assert any(any(t.subset) for t in model.trees)
    model.save(spark, str(tmp_path / "m"))
    again = BoosterModel.load(spark, str(tmp_path / "m"))
    assert again.binning == model.binning and again.curve == model.curve
    np.testing.assert_array_equal(column(again.transform(table)), column(model.transform(table)))


def test_pruning_folds_back_what_gains_too_little(spark):
    # the first split alone gains nothing, the two below it everything
    rows = [(i, float(i // 2 % 2), float(i % 2), float((i // 2 % 2) ^ (i % 2)) + 0.001 * (i // 2 % 2)) for i in range(64)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label double")
    at_once = level_booster(["a", "b"], trees=1, max_depth=2, learning_rate=1.0, l2=0.0, min_gain=0.5, prune_after=False).fit(df)
    after = level_booster(["a", "b"], trees=1, max_depth=2, learning_rate=1.0, l2=0.0, min_gain=0.5).fit(df)
    none = level_booster(["a", "b"], trees=1, max_depth=2, learning_rate=1.0, l2=0.0, min_gain=100.0).fit(df)
    assert len(at_once.trees[0].feature) == 1 and len(after.trees[0].feature) == 7 and len(none.trees[0].feature) == 1
    np.testing.assert_allclose(column(after.transform(df)), [r[3] for r in rows], atol=1e-9)


@pytest.mark.parametrize("mode", ["level", "symmetric", "leaf"])
def test_small_portions_and_siblings_give_the_same_trees(table, monkeypatch, mode):
    growth = Growth(mode, 4, 9)
    booster = Booster(["a", "b"], trees=2, growth=growth, rules=SplitRules(learn_missing=mode != "symmetric"), learning_rate=0.5)
    whole = booster.fit(table)
    monkeypatch.setattr(histtree, "HISTOGRAM_BYTES", 1)
    parted = booster.fit(table.repartition(5))
    assert [t.feature for t in whole.trees] == [t.feature for t in parted.trees]
    assert [t.bin for t in whole.trees] == [t.bin for t in parted.trees]
    np.testing.assert_allclose(column(whole.transform(table)), column(parted.transform(table)), rtol=1e-9)


def test_local_growth_equals_growth_by_histograms(table):
    def forest(local_rows):
        return Forest(["a", "b"], trees=3, max_depth=5, min_rows=2, categories=["c"], local_rows=local_rows, trees_at_once=2)

    by_histogram = forest(0).fit(table)
    np.testing.assert_allclose(column(forest(40).fit(table).transform(table)), column(by_histogram.transform(table)), rtol=1e-9)
    np.testing.assert_allclose(column(forest(10**6).fit(table.repartition(3)).transform(table)), column(by_histogram.transform(table)), rtol=1e-9)


def test_a_forest_without_bootstrap_is_one_tree_of_means(table, data):
    _, _, y = data
    model = Forest(["b"], trees=2, max_depth=10, min_rows=1, bootstrap=False).fit(table)
    b = data[0][:, 1]
    want = np.array([y[b == v].mean() for v in b])
    np.testing.assert_allclose(column(model.transform(table)), want, rtol=1e-9)


def test_poisson_counts_have_mean_and_variance_one():
    counts = poisson_counts(np.random.default_rng(1).random(200_000))
    assert counts.mean() == pytest.approx(1.0, abs=0.01) and counts.var() == pytest.approx(1.0, abs=0.02)


def test_folds_and_settings_grown_together_equal_single_fits(table):
    base = level_booster(["a", "b"], trees=3, max_depth=2, learning_rate=0.5)
    other = base.with_params(l2=20.0, max_depth=3, row_share=0.7)
    leafy = leaf_booster(["a", "b"], trees=3, max_leaves=5, min_rows=3, learning_rate=0.5, max_bins=64, patience=None)
    jobs = [(b, k) for b in (base, other, leafy) for k in (0, 2)]
    together = fit_together(table, [b for b, _ in jobs], [k for _, k in jobs], F.col("fold"))
    for (booster, k), model in zip(jobs, together, strict=True):
        alone = booster.fit(table, F.col("fold") == k)
        np.testing.assert_allclose(column(model.transform(table)), column(alone.transform(table)), rtol=1e-9)
        assert [(i, s) for i, s, *_ in model.curve] == [(i, s) for i, s, *_ in alone.curve]
        np.testing.assert_allclose([e for _, _, e, _ in model.curve], [e for _, _, e, _ in alone.curve])


def test_booster_grid_picks_by_mean_error_and_refits(table, data):
    base = level_booster(["a", "b"], trees=4, max_depth=2)
    grid = tune.parameter_grid({"learning_rate": [0.02, 0.6], "l2": [1.0]})
    model, trials = tune.booster_grid(table, base, grid, "fold", 4, models_at_once=5)
    scores = {}
    for r in trials.collect():
        alone = base.with_params(**grid[r["trial_id"]]).fit(table, F.col("fold") == r["fold"])
        out = alone.transform(table).filter(F.col("fold") == r["fold"])
        assert r["score"] == pytest.approx(tune.holdout_rmse(out, "label"))
        scores.setdefault(r["trial_id"], []).append(r["score"])
    assert np.mean(scores[1]) < np.mean(scores[0]) and len(scores[0]) == 4
    want = base.with_params(**grid[1]).fit(table)
    np.testing.assert_allclose(column(model.transform(table)), column(want.transform(table)), rtol=1e-9)
    with pytest.raises(ValueError, match="columns"):
        fit_together(table, [base, level_booster(["a"])], [None, None])


def test_a_fit_goes_on_from_a_model(table):
    booster = level_booster(["a", "b"], trees=5, max_depth=2, learning_rate=0.4, row_share=0.8)
    whole = booster.fit(table, F.col("fold") == 1)
    part = booster.with_params(trees=2).fit(table, F.col("fold") == 1)
    rest = booster.with_params(trees=3).fit(table, F.col("fold") == 1, start_from=part)
    np.testing.assert_allclose(column(rest.transform(table)), column(whole.transform(table)), rtol=1e-9)
    np.testing.assert_allclose([e for _, _, e, _ in rest.curve], [e for _, _, e, _ in whole.curve])


def test_staged_errors_are_those_of_the_cut_models(table):
    model = symmetric_booster(["a", "b"], trees=4, max_depth=2, learning_rate=0.9, patience=None).fit(table)
    staged = {r["iter"]: (r["n"], r["rmse"]) for r in model.staged_errors(table, "label").collect()}
    for k in range(5):
        assert staged[k] == (ROWS, pytest.approx(tune.holdout_rmse(model.cut_at(k).transform(table), "label")))
    steep = level_booster(["b"], trees=12, max_depth=1, learning_rate=1.9).fit(table, F.col("fold") == 0)
    held = table.filter("fold = 0")
    cut = steep.cut_at_first_rise(held, "label").best_iteration
    errors = [e for _, s, e, _ in steep.curve if s == "validation"]
    first = next((k for k in range(1, 12) if errors[k + 1] >= errors[k]), 12)
    assert cut == first
    assert list(steep.elapsed) == sorted(steep.elapsed) and len(steep.elapsed) == len(steep.curve)


def test_statistics_of_all_categories_equal_those_of_each(spark, monkeypatch):
    from tabloom.operators.encode import AllTargetStatistics, TargetStatistics, few_levels

    monkeypatch.setattr(TargetStatistics, "ROWS_PER_BUCKET", 7)
    rows = [(i, None if i % 6 == 0 else f"a{i % 4}", f"b{i % 9}", float(i % 13)) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, c string, d string, target double").repartition(4)
    both = AllTargetStatistics.fit(df, ["c", "d"], "target", "row_id")
    trained = {r["row_id"]: (r["x"], r["y"]) for r in both.encode_training(df, ["x", "y"]).collect()}
    levels = both.level_table(df)
    new = spark.createDataFrame([(1, "a1", "zz"), (2, None, "b3")], "row_id long, c string, d string")
    coded = {r["row_id"]: (r["x"], r["y"]) for r in both.encode_new(new, levels, ["x", "y"]).collect()}
    for i, c in enumerate(("c", "d")):
        one = TargetStatistics.fit(df, c)
        assert {r["row_id"]: r["m"] for r in one.encode_training(df, "m").collect()} == {k: v[i] for k, v in trained.items()}
        alone = {r["row_id"]: r["m"] for r in one.encode_new(new, one.level_table(df), "m").collect()}
        assert alone == {k: v[i] for k, v in coded.items()}
    assert few_levels(df, ["c", "d"], 4) == {"c": ["a0", "a1", "a2", "a3"]}


SPACE = {"learning_rate": tune.Uniform(0.01, 1.0, log=True), "max_depth": tune.Uniform(1, 3, integer=True)}


def test_halving_goes_on_from_models_and_finds_the_same_on_any_partitioning(table):
    base = level_booster(["a", "b"])
    search = {"rounds": 2, "per_round": 4, "rungs": (1, 3, 5)}
    model, trials = tune.adaptive_search(table, base, SPACE, F.col("fold") == 0, **search)
    again, others = tune.adaptive_search(table.repartition(6), base, SPACE, F.col("fold") == 0, **search)
    rows = sorted(trials.collect(), key=lambda r: (r["trial_id"], r["fold"]))
    same = sorted(others.collect(), key=lambda r: (r["trial_id"], r["fold"]))
    assert [(r["trial_id"], r["params"], r["fold"]) for r in rows] == [(r["trial_id"], r["params"], r["fold"]) for r in same]
    assert [sum(r["fold"] == k for r in rows) for k in range(3)] == [8, 4, 2]
    last = [r for r in rows if r["fold"] == 2]
    best = min(last, key=lambda r: r["score"])
    params = {**best["params"], "max_depth": int(best["params"]["max_depth"])}
    alone = base.with_params(**params, trees=5).fit(table, F.col("fold") == 0)
    np.testing.assert_allclose(column(model.transform(table)), column(alone.transform(table)), rtol=1e-9)
    np.testing.assert_allclose(column(again.transform(table)), column(alone.transform(table)), rtol=1e-9)
    held = table.filter("fold = 0")
    assert best["score"] == pytest.approx(tune.holdout_rmse(alone.transform(held), "label"))


def test_proposals_gather_where_good_settings_are():
    scored = [({"learning_rate": r, "max_depth": d}, abs(np.log(r / 0.1)) + abs(d - 2)) for r in (0.01, 0.05, 0.1, 0.12, 0.5, 1.0) for d in (1, 2, 3)]
    found = tune.proposals(SPACE, scored, 40, seed=1)
    assert found == tune.proposals(SPACE, scored, 40, seed=1) != tune.proposals(SPACE, scored, 40, seed=2)
    assert all(0.01 <= p["learning_rate"] <= 1.0 and p["max_depth"] in (1, 2, 3) for p in found)
    near = np.mean([0.03 < p["learning_rate"] < 0.3 for p in found])
    assert near > 0.8 and np.mean([p["max_depth"] == 2 for p in found]) > 0.5
