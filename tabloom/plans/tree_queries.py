"""Registered queries of boosters and forests: settings and folds together, missing values, category subsets, curves.

One-split trees on columns with few values are checked against SQL over cells
(`stump_sql`); a border lies at each value, so both sides see the same splits.
The last block runs the learners at the size they are used in.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.scalar import log_target, target_from_log
from tabloom.functions.splits import fold_number, in_holdout
from tabloom.operators import stack, tune
from tabloom.operators.adaboost import AdaBoostR2
from tabloom.operators.boost import Booster, CategoryBooster, leaf_booster, level_booster, symmetric_booster
from tabloom.operators.forest import Forest
from tabloom.operators.histtree import Growth, SplitRules
from tabloom.plans.registry import HOLDOUT_SQL, NUMBERS, STRINGS, Catalog, rounded, union_all, with_property
from tabloom.plans.stump_sql import FIVE_FOLDS, HOLDOUT_FOLD, boosted_ctes, curve_sql, data_cte, predictions_sql
from tabloom.session import reused
from tabloom.sources.fixture import property_table

STUMP = ("overall_quality", "total_rooms")  # the second one has missing values
RATE = 0.6


def _labelled(spark, d, *columns):
    df = property_table(spark, d).select("row_id", "target", *columns)
    return df.withColumns({"label": log_target(F.col("target")), "is_holdout": in_holdout(), "fold": fold_number(5)})


def _predictions(scored):
    return scored.select("row_id", F.round(target_from_log(F.col("prediction")), 2).alias("prediction"))


def _stumps(booster):
    """All rows, scored by a booster that is fitted on the rows outside the holdout."""

    def run(spark, d):
        df = _labelled(spark, d, *booster.columns, *booster.categories)
        with reused(df) as kept:
            model = booster.fit(kept, F.col("is_holdout"))
        return _predictions(model.transform(df))

    return run


# ---- settings and folds together ---------------------------------------------------

GRID = tune.parameter_grid({"learning_rate": [0.3, 0.9], "l2": [1.0, 5000.0]})
GRID_ROUNDS = 2
FOLDS = 5


def _grid(spark, d):
    booster = level_booster(STUMP, trees=GRID_ROUNDS, max_depth=1)
    with reused(_labelled(spark, d, *STUMP)) as df:
        _, trials = tune.booster_grid(df, booster, GRID, "fold", FOLDS)
    return tune.trial_scores(trials).select(
        "trial_id",
        F.col("params")["learning_rate"].alias("learning_rate"),
        F.col("params")["l2"].alias("l2"),
        F.round("score", 6).alias("score"),
    )


def _grid_sql() -> str:
    jobs = [(k, c["l2"], c["learning_rate"]) for c in GRID for k in range(FOLDS)]
    return with_property(
        f"SELECT CAST(j // {FOLDS} AS INTEGER) AS trial_id, rate AS learning_rate, l2, round(AVG(sqrt(mse)), 6) AS score "
        f"FROM ({curve_sql(GRID_ROUNDS)}) c JOIN jobs USING (j) WHERE iter = {GRID_ROUNDS} AND split = 'validation' GROUP BY ALL",
        *boosted_ctes(STUMP, GRID_ROUNDS, jobs, FIVE_FOLDS),
    )


# ---- curves, stopping, going on ------------------------------------------------------

STEEP = 1.9  # so large a step overshoots, and the error rises again
CURVE_ROUNDS = 7
PATIENCE = 2


def _steep(**settings):
    return level_booster(STUMP, **{"trees": CURVE_ROUNDS, "max_depth": 1, "learning_rate": STEEP, **settings})


def _log(spark, d):
    with reused(_labelled(spark, d, *STUMP)) as df:
        model = _steep().fit(df, F.col("is_holdout"))
    return rounded(model.training_log(spark).drop("elapsed"))


def _curve_ctes(rate=STEEP, rounds=CURVE_ROUNDS):
    return boosted_ctes(STUMP, rounds, [(1, 1.0, rate)])


LOG_SQL = with_property(
    f"SELECT CAST(iter AS INTEGER) AS iter, split, round(sqrt(mse), 6) AS rmse, round(r2, 6) AS r2 FROM ({curve_sql(CURVE_ROUNDS)}) c",
    *_curve_ctes(),
)


def _stopped(spark, d):
    with reused(_labelled(spark, d, *STUMP)) as df:
        model = _steep(patience=PATIENCE).fit(df, F.col("is_holdout"))
    log = model.training_log(spark).filter("split = 'validation'")
    return log.agg(F.max("iter").alias("iterations_run"), F.lit(model.best_iteration).alias("best_iteration"))


STOPPED_SQL = with_property(
    "SELECT CAST(stop AS INTEGER) AS iterations_run, CAST((SELECT arg_min(iter, mse) FROM v WHERE iter <= stop) AS INTEGER) AS best_iteration "
    f"FROM (SELECT coalesce(MIN(iter) FILTER (iter - best >= {PATIENCE}), {CURVE_ROUNDS}) AS stop FROM (SELECT iter, "
    "(SELECT arg_min(w.iter, w.mse) FROM v w WHERE w.iter <= v.iter) AS best FROM v) t) s",
    *_curve_ctes(),
    f"v AS MATERIALIZED (SELECT iter, mse FROM ({curve_sql(CURVE_ROUNDS)}) c WHERE split = 'validation')",
)


def _staged(spark, d):
    """The error of 1, 2, ... trees on the holdout rows, and the number before the first rise."""
    with reused(_labelled(spark, d, *STUMP)) as df:
        model = _steep().fit(df.filter(~F.col("is_holdout")))
        holdout = df.filter("is_holdout")
        best = model.cut_at_first_rise(holdout, "label").best_iteration
        errors = model.staged_errors(holdout, "label").filter("iter > 0")
        return errors.select("iter", "n", F.round("rmse", 6).alias("rmse"), (F.col("iter") == best).alias("is_best"))


STAGED_SQL = with_property(
    "SELECT CAST(iter AS INTEGER) AS iter, n, round(sqrt(mse), 6) AS rmse, iter = (SELECT coalesce(MIN(iter) - 1, "
    f"{CURVE_ROUNDS}) FROM (SELECT iter, mse >= lag(mse) OVER (ORDER BY iter) AS worse FROM v) w WHERE worse) AS is_best FROM v, "
    "(SELECT COUNT(*) AS n FROM d WHERE fold = 1) c",
    *_curve_ctes(),
    f"v AS MATERIALIZED (SELECT iter, mse FROM ({curve_sql(CURVE_ROUNDS)}) c WHERE split = 'validation' AND iter > 0)",
)


def _warm_start(spark, d):
    booster = level_booster(STUMP, trees=2, max_depth=1, learning_rate=RATE)
    df = _labelled(spark, d, *STUMP)
    with reused(df) as kept:
        first = booster.fit(kept, F.col("is_holdout"))
        model = booster.fit(kept, F.col("is_holdout"), start_from=first)
    return _predictions(model.transform(df))


# ---- category subsets ----------------------------------------------------------------

SUBSET_COLUMNS = ("zone", "kitchen_quality", "basement_height")
SMOOTH = 10.0
SUBSET_L2 = 1.0


def _subset_booster():
    rules = SplitRules(l2=SUBSET_L2, category_smooth=SMOOTH)
    return Booster((), categories=SUBSET_COLUMNS, trees=1, learning_rate=1.0, growth=Growth("level", 1), rules=rules)


def _subset_sql() -> str:
    """Levels in the order of gradient over smoothed rows, cut everywhere from both ends; missing values stay right."""
    sides = union_all(
        [
            f"SELECT {i} AS f, {c} AS level, SUM(m - y) AS g, CAST(COUNT(*) AS DOUBLE) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}"
            for i, c in enumerate(SUBSET_COLUMNS)
        ]
    )
    level = "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(SUBSET_COLUMNS)) + " END"
    score = f"gl * gl / (nl + {SUBSET_L2}) + (g - gl) * (g - gl) / (n - nl + {SUBSET_L2})"
    return with_property(
        f"SELECT row_id, round(exp(m + CASE WHEN list_contains(lefts, {level}) THEN -gl / (nl + {SUBSET_L2}) ELSE -(g - gl) / (n - nl + {SUBSET_L2}) END) - 1, 2) "
        "AS prediction FROM prop, best, mean",
        f"mean AS (SELECT AVG(ln(1 + target)) AS m FROM prop WHERE NOT {HOLDOUT_SQL})",
        f"t AS (SELECT prop.*, ln(1 + target) AS y, m FROM prop, mean WHERE NOT {HOLDOUT_SQL})",
        f"sides AS ({sides})",
        "cuts AS (" + union_all(
            [
                f"SELECT f, SUM(g) OVER w AS gl, SUM(n) OVER w AS nl, list(level) OVER w AS lefts FROM sides "
                f"WINDOW w AS (PARTITION BY f ORDER BY g / (n + {SMOOTH}) {way} ROWS UNBOUNDED PRECEDING)"
                for way in ("ASC", "DESC")
            ]
        ) + ")",
        "best AS (SELECT f, gl, nl, lefts, g, n FROM cuts, (SELECT SUM(m - y) AS g, CAST(COUNT(*) AS DOUBLE) AS n FROM t) a WHERE nl < n "
        f"ORDER BY {score} DESC, f LIMIT 1)",
    )


# ---- one unbagged tree, two rounds of AdaBoost -------------------------------------------


def _unbagged(spark, d):
    df = _labelled(spark, d, *STUMP)
    with reused(df) as kept:
        model = Forest(STUMP, trees=1, max_depth=1, min_rows=5, bootstrap=False).fit(kept.filter(~F.col("is_holdout")))
    return _predictions(model.transform(df))


ADA_COLUMNS = ("overall_quality", "overall_condition")
ADA_RATE = 0.5


def _two_rounds(spark, d):
    df = _labelled(spark, d, *ADA_COLUMNS)
    with reused(df) as kept:
        model = AdaBoostR2(ADA_COLUMNS, rounds=2, max_depth=1, learning_rate=ADA_RATE).fit(kept.filter(~F.col("is_holdout")))
    return _predictions(model.transform(df))


def _two_rounds_sql() -> str:
    """Two weighted stumps; of two outputs the weighted median is that of the larger vote, the lower one on a tie."""

    def stump(t: int) -> list[str]:
        sides = union_all(
            [
                f"SELECT {i} AS f, x{i} AS cut, SUM(SUM(w * y)) OVER (ORDER BY x{i}) AS sl, SUM(SUM(w)) OVER (ORDER BY x{i}) AS wl FROM w{t} GROUP BY x{i}"
                for i in range(len(ADA_COLUMNS))
            ]
        )
        x = "CASE f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(len(ADA_COLUMNS))) + " END"
        return [
            f"b{t} AS MATERIALIZED (SELECT f, cut, sl / wl AS vl, (s - sl) / (w - wl) AS vr FROM ({sides}) q, (SELECT SUM(w * y) AS s, SUM(w) AS w FROM w{t}) a "
            "WHERE w - wl > 1e-9 ORDER BY sl * sl / wl + (s - sl) * (s - sl) / (w - wl) DESC, f, cut LIMIT 1)",
            f"o{t} AS MATERIALIZED (SELECT row_id, fold, y, CASE WHEN {x} <= cut THEN vl ELSE vr END AS o FROM d, b{t})",
            f"e{t} AS MATERIALIZED (SELECT largest, loss / (largest * total) / (1 - loss / (largest * total)) AS beta FROM (SELECT MAX(abs(y - o)) AS largest, "
            f"SUM(w * abs(y - o)) AS loss, SUM(w) AS total FROM o{t} JOIN (SELECT row_id, w FROM w{t}) v USING (row_id)) a)",
        ]

    return with_property(
        "SELECT row_id, round(exp(CASE WHEN v1 > v2 THEN a WHEN v2 > v1 THEN b ELSE least(a, b) END) - 1, 2) AS prediction FROM "
        "(SELECT row_id, o1.o AS a, o2.o AS b, ln(1 / e1.beta) AS v1, ln(1 / e2.beta) AS v2 FROM o1 JOIN o2 USING (row_id), e1, e2) q",
        data_cte(ADA_COLUMNS, HOLDOUT_FOLD),
        "w1 AS (SELECT *, 1.0::DOUBLE AS w FROM d WHERE fold = 0)",
        *stump(1),
        f"w2 AS (SELECT w1.* REPLACE (w * pow(beta, (1 - abs(w1.y - o) / largest) * {ADA_RATE}) AS w) FROM w1 JOIN o1 USING (row_id), e1)",
        *stump(2),
    )


# ---- full shapes ----------------------------------------------------------------------

WIDE = [c for c in NUMBERS if c != "target"]


def _wide(spark, d):
    return _labelled(spark, d, *WIDE, *STRINGS)


def _holdout_scores(fit):
    """The holdout rows scored by what ``fit`` makes of the whole frame, all columns."""

    def run(spark, d):
        with reused(_wide(spark, d)) as df:
            model = fit(df)
        return _predictions(model.transform(_wide(spark, d).filter("is_holdout")))

    return run


def _fitted(booster):
    return _holdout_scores(lambda df: booster.fit(df, F.col("is_holdout")))


def _wide_grid(spark, d):
    booster = level_booster(WIDE, trees=10, max_depth=4)
    candidates = tune.parameter_grid({"learning_rate": [0.1, 0.3], "l2": [1.0, 3.0]})
    with reused(_wide(spark, d)) as df:
        _, trials = tune.booster_grid(df.filter(~F.col("is_holdout")), booster, candidates, "fold", FOLDS)
    return rounded(tune.trial_scores(trials))


def _adaptive(spark, d):
    """Successive halving over step size, depth and penalty, the later settings proposed from the earlier ones."""
    space = {"learning_rate": tune.Uniform(0.05, 0.9, log=True), "max_depth": tune.Uniform(2, 5, integer=True), "l2": tune.Uniform(0.5, 50.0, log=True)}
    with reused(_labelled(spark, d, *WIDE[:12])) as df:
        _, trials = tune.adaptive_search(
            df, level_booster(WIDE[:12]), space, F.col("is_holdout"), rounds=2, per_round=4, rungs=(2, 4, 8)
        )
    return rounded(trials.withColumnRenamed("fold", "rung"))


def _wide_stack(spark, d):
    """Three kinds of boosters, each with the models of five folds grown together, and least squares on top."""
    settings = {"trees": 10, "learning_rate": 0.3, "patience": None}
    base = {
        "symmetric": symmetric_booster(WIDE, max_depth=4, max_bins=64, **settings),
        "level": level_booster(WIDE, max_depth=4, **settings),
        "leaf": leaf_booster(WIDE, max_leaves=12, max_bins=64, **settings),
    }
    with reused(_wide(spark, d)) as df:
        result = stack.stack_boosters(df.filter(~F.col("is_holdout")), df.filter("is_holdout"), base, FOLDS, "label")
    return _predictions(result.test)


def register(catalog: Catalog) -> None:
    add = catalog.add
    one = {"jobs": [(1, 1.0, RATE)]}
    add("V10_booster_grid", _grid, _grid_sql())
    add("S9_stump_log", _log, LOG_SQL)
    add("V8_stump_patience", _stopped, STOPPED_SQL)
    add("V9_staged_errors", _staged, STAGED_SQL)
    add("M10_warm_start", _warm_start, predictions_sql(STUMP, 4, **one))
    missing = ("total_rooms", "full_baths", "parking_capacity")
    add(
        "M10_missing_direction",
        _stumps(level_booster(missing, trees=2, max_depth=1, learning_rate=RATE)),
        predictions_sql(missing, 2, **one),
    )
    add(
        "M11_two_leaves",
        _stumps(leaf_booster(STUMP, trees=2, max_leaves=2, learning_rate=RATE, row_share=1.0, column_share=1.0, patience=None)),
        predictions_sql(STUMP, 2, jobs=[(1, 0.3, RATE)], l1=0.1, min_rows=20),
    )
    add(
        "M12_symmetric_stump",
        _stumps(symmetric_booster(STUMP, trees=2, max_depth=1, learning_rate=RATE, patience=None)),
        predictions_sql(STUMP, 2, jobs=[(1, 3.0, RATE)], learn_missing=False),
    )
    add("E11_category_subset", _stumps(_subset_booster()), _subset_sql())
    add("M7_unbagged_tree", _unbagged, predictions_sql(STUMP, 1, jobs=[(1, 0.0, 1.0)], min_rows=5))
    add("M8_two_rounds", _two_rounds, _two_rounds_sql())

    add("M7_forest_full", _holdout_scores(lambda df: Forest(WIDE, trees=20, categories=STRINGS).fit(df.filter(~F.col("is_holdout")))))
    add("M8_adaboost_full", _holdout_scores(lambda df: AdaBoostR2(WIDE, rounds=12).fit(df.filter(~F.col("is_holdout")))))
    add("M10_gbt_full", _fitted(level_booster(WIDE, trees=20, max_depth=5, learning_rate=0.3, l2=3.0)))
    add("M11_gbt_full", _fitted(leaf_booster(WIDE, categories=STRINGS, trees=15, max_leaves=31, learning_rate=0.3)))
    add("M12_gbt_full", _fitted(CategoryBooster(WIDE, STRINGS, booster=symmetric_booster((), trees=10, learning_rate=0.3, max_bins=64))))
    add("V10_booster_grid_full", _wide_grid)
    add("M14_stacking_full", _wide_stack)
    add("V12_adaptive_search", _adaptive)
