"""SQL of boosted one-split trees, the checks of the histogram boosters.

Rows that agree in all features have one prediction, so the SQL works on cells:
one row per combination of feature values and fold, with rows, sum and sum of
squares of the label.  Every job (held fold, penalty, learning rate) boosts on
its own copy of the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from tabloom.plans.registry import HASH_SQL, HOLDOUT_SQL, union_all, with_property

HOLDOUT_FOLD = f"CASE WHEN {HOLDOUT_SQL} THEN 1 ELSE 0 END"
FIVE_FOLDS = f"CAST({HASH_SQL} % 5 AS INTEGER)"


def data_cte(features: Sequence[str], fold: str) -> str:
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(features))
    return f"d AS (SELECT row_id, target, ln(1 + target) AS y, {fold} AS fold, {xs} FROM prop)"


def boosted_ctes(
    features: Sequence[str],
    rounds: int,
    jobs: Sequence[tuple[int, float, float]],
    fold: str = HOLDOUT_FOLD,
    l1: float = 0.0,
    min_rows: int = 1,
    learn_missing: bool = True,
) -> list[str]:
    """CTEs d, cells, jobs and r0, r1, ...: the cells of every job with the prediction p after that many rounds.

    A job is (held fold, penalty, learning rate).
    """
    xs = ", ".join(f"x{i}" for i in range(len(features)))
    rows = ", ".join(f"({j}, {k}, {l2!r}::DOUBLE, {rate!r}::DOUBLE)" for j, (k, l2, rate) in enumerate(jobs))
    ctes = [
        data_cte(features, fold),
        f"cells AS MATERIALIZED (SELECT {xs}, fold, CAST(COUNT(*) AS DOUBLE) AS n, SUM(y) AS s, SUM(y * y) AS q FROM d GROUP BY ALL)",
        f"jobs(j, k, l2, rate) AS (VALUES {rows})",
        f"r0 AS MATERIALIZED (SELECT j, k, l2, rate, {xs}, fold, n, s, q, SUM(CASE WHEN fold <> k THEN s END) OVER (PARTITION BY j) "
        "/ SUM(CASE WHEN fold <> k THEN n END) OVER (PARTITION BY j) AS p FROM cells, jobs)",
    ]
    for t in range(1, rounds + 1):
        ctes += [_best_split(t, len(features), l1, min_rows, learn_missing), _next_round(t, len(features))]
    return ctes


def _score(g: str, n: str, l1: float) -> str:
    shrunk = g if l1 == 0 else f"sign({g}) * greatest(abs({g}) - {l1!r}, 0)"
    return f"({shrunk}) * ({shrunk}) / ({n} + l2)"


def _leaf(g: str, n: str, l1: float) -> str:
    shrunk = g if l1 == 0 else f"sign({g}) * greatest(abs({g}) - {l1!r}, 0)"
    return f"-rate * ({shrunk}) / ({n} + l2)"


def _best_split(t: int, features: int, l1: float, min_rows: int, learn_missing: bool) -> str:
    """The split of each job with the largest gain: feature, cut (null: missing values against the rest), side of missing values."""
    sides = []
    for i in range(features):
        sums = (
            f"SELECT j, x{i} AS cut, SUM(n * p - s) AS g, SUM(n) AS n FROM r{t - 1} WHERE fold <> k GROUP BY j, x{i}"
        )
        sides.append(
            f"SELECT j, {i} AS f, cut, SUM(g) FILTER (cut IS NOT NULL) OVER w AS gl, SUM(n) FILTER (cut IS NOT NULL) OVER w AS nl, "
            "coalesce(SUM(g) FILTER (cut IS NULL) OVER (PARTITION BY j), 0) AS gm, coalesce(SUM(n) FILTER (cut IS NULL) OVER (PARTITION BY j), 0) AS nm "
            f"FROM ({sums}) WINDOW w AS (PARTITION BY j ORDER BY cut NULLS FIRST ROWS UNBOUNDED PRECEDING)"
        )
    toward = "SELECT j, f, cut, TRUE AS missing_left, coalesce(gl, 0) + gm AS gl, coalesce(nl, 0) + nm AS nl FROM sides"
    away = " UNION ALL SELECT j, f, cut, FALSE, gl, nl FROM sides WHERE cut IS NOT NULL AND nm > 0" if learn_missing else ""
    gain = f"{_score('gl', 'nl', l1)} + {_score('(g - gl)', '(n - nl)', l1)} - {_score('g', 'n', l1)}"
    return (
        f"b{t} AS MATERIALIZED (WITH sides AS ({union_all(sides)}), split AS ({toward}{away}), "
        f"total AS (SELECT j, l2, rate, SUM(n * p - s) AS g, SUM(n) AS n FROM r{t - 1} WHERE fold <> k GROUP BY j, l2, rate) "
        f"SELECT j, f, cut, missing_left, {_leaf('gl', 'nl', l1)} AS vl, {_leaf('(g - gl)', '(n - nl)', l1)} AS vr FROM split JOIN total USING (j) "
        f"WHERE nl >= {min_rows} AND n - nl >= {min_rows} "
        f"QUALIFY row_number() OVER (PARTITION BY j ORDER BY {gain} DESC, f, cut NULLS FIRST, missing_left DESC) = 1)"
    )


def _next_round(t: int, features: int) -> str:
    x = "CASE f " + " ".join(f"WHEN {i} THEN x{i}" for i in range(features)) + " END"
    xs = ", ".join(f"x{i}" for i in range(features))
    left = f"CASE WHEN {x} IS NULL THEN missing_left ELSE cut IS NOT NULL AND {x} <= cut END"
    return (
        f"r{t} AS MATERIALIZED (SELECT j, k, l2, rate, {xs}, fold, n, s, q, p + CASE WHEN {left} THEN vl ELSE vr END AS p "
        f"FROM r{t - 1} JOIN b{t} USING (j))"
    )


def curve_sql(rounds: int) -> str:
    """(j, iter, split, mse, r2) of every round from 0 on."""
    part = "CASE WHEN fold = k THEN 'validation' ELSE 'train' END"
    return union_all(
        [
            f"SELECT j, {t} AS iter, {part} AS split, SUM(q - 2 * p * s + n * p * p) / SUM(n) AS mse, "
            f"1 - SUM(q - 2 * p * s + n * p * p) / (SUM(q) - SUM(s) * SUM(s) / SUM(n)) AS r2 FROM r{t} GROUP BY j, {part}"
            for t in range(rounds + 1)
        ]
    )


def predictions_sql(features: Sequence[str], rounds: int, digits: int = 2, **settings) -> str:
    """Predictions of all rows on the original scale, by one job."""
    on = " AND ".join(["d.fold = c.fold", *[f"d.x{i} IS NOT DISTINCT FROM c.x{i}" for i in range(len(features))]])
    return with_property(
        f"SELECT d.row_id, round(exp(p) - 1, {digits}) AS prediction FROM d JOIN r{rounds} c ON {on}",
        *boosted_ctes(features, rounds, **settings),
    )
