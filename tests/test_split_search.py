import re

import numpy as np

from tabloom.operators import histtree
from tabloom.operators.histtree import Binning, Growth, Pair, SplitRules, TreeTask, _NumberCuts, _splits, candidates_of

BORDERS = ((0.5, 1.5), (), tuple(float(v) for v in range(9)))


def test_search_of_a_few_nodes_takes_no_more_tasks_than_cores(spark):
    tasks = [TreeTask(Growth("level", 2), SplitRules(), None, (0, 1, 2))]
    rows = spark.createDataFrame([], histtree.HISTOGRAM_SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = _splits(rows, Binning(("a", "b", "c"), BORDERS), tasks, [[Pair(0)]], [False])
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [int(n) for n in re.findall(r"RepartitionByExpression \[.*?\], (\d+)", plan)]
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism


def test_cuts_of_all_numbers_at_once_are_those_of_each():
    rng = np.random.default_rng(3)
    sizes = Binning(("a", "b", "c"), BORDERS).sizes
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for trial in range(60):
        rules = SplitRules(l2=float(trial % 2), min_rows=1 + trial % 4, learn_missing=trial % 3 > 0)
        rows = rng.poisson(1.0, starts[-1]).astype(float)
        sums = np.array([rows * rng.normal(size=starts[-1]).round(1), rows, rows])
        gain, cut, toward, left, total, _ = _NumberCuts.of(sizes).best(sums, rules)
        for k in range(len(sizes)):
            hist = sums[:, starts[k] : starts[k + 1]]
            gains, lefts, bins, sides, _ = candidates_of(hist, rules, False)
            c = histtree._first_best(gains, float(rules.score(*hist.sum(axis=1)[:2])))
            if not np.isfinite(gains[c]):
                assert not np.isfinite(gain[k])
                continue
            assert (cut[k], toward[k]) == (bins[c], sides[c])
            np.testing.assert_allclose([gain[k], *left[:, k]], [gains[c], *lefts[:, c]], rtol=1e-9, atol=1e-12)
