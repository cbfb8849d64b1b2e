"""What tasks hold at once stays bounded, and the registered learners run with their usual settings."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabloom.operators import boost, histtree
from tabloom.operators.boost import fit_together, level_booster
from tabloom.operators.histtree import Batch, Binning, Growth, Pair, SplitRules, Tree, TreeTask
from tabloom.plans import model_queries
from tabloom.session import reused

MODELS = 20


class Stop(Exception):
    pass


def test_blocks_stay_out_of_the_heap(spark, monkeypatch):
    df = spark.range(100_000).select(F.col("id").alias("row_id"), F.expr("id % 50 * 1.0D").alias("x"), F.expr("id * 0.5D").alias("label"))
    seen = []
    grow = boost.grow_trees

    def noted(table, *rest, **named):
        files = [pq.ParquetFile(p.removeprefix("file://")).metadata for p in table.inputFiles()]
        groups = [f.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
        seen.append((table.storageLevel.useMemory, max(groups, default=0)))
        return grow(table, *rest, **named)

    monkeypatch.setattr(boost, "grow_trees", noted)
    fit_together(df.coalesce(1), [level_booster(["x"], trees=2, max_depth=1)] * MODELS, [None] * MODELS)
    assert [memory for memory, _ in seen] == [False, False]
    assert seen[0][1] <= 10 << 20  # 17 MB in all


def test_reused_frames_stay_out_of_the_heap(spark):
    with reused(spark.range(5)) as kept:
        assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory


def test_a_pass_sketches_a_few_columns(spark, monkeypatch):
    columns = [f"x{i}" for i in range(30)]
    df = spark.range(200).select(*[((F.col("id") * (i + 3)) % 41).cast("double").alias(c) for i, c in enumerate(columns)])
    want = [Binning.fit(df, [c], 16).borders[0] for c in columns]
    widths, agg = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *exprs: widths.append(len(exprs)) or agg(self, *exprs))
    assert list(Binning.fit(df, columns, 16).borders) == want
    assert widths == [24, 24, 12]


def test_arrays_of_a_task_leave_it_in_small_batches(monkeypatch):
    monkeypatch.setattr(histtree, "SENT_BYTES", 4096, raising=False)
    binning = Binning(tuple("abcdef"), tuple(tuple(float(v) for v in range(30)) for _ in "abcdef"))
    batch = Batch(np.tile(np.arange(30, dtype=np.uint8)[:, None], 6), np.arange(30.0), np.zeros((30, 4)), np.arange(30), np.zeros(30, np.int32))
    tasks = [TreeTask(Growth(), SplitRules(), lambda b, m: (m - b.y, None, m - b.y), tuple(range(6)), model=m) for m in range(4)]

    class Table:
        def mapInArrow(self, fold, schema):
            return list(fold([batch.blocks()]))

    sent = histtree.histogram(Table(), binning, tasks, [Tree() for _ in tasks], [[Pair(0)] for _ in tasks], with_fit=True)
    assert sum(b.num_rows for b in sent) == 4 * 6 + 4  # the arrays and a fit per tree
    assert max(sum(len(v.as_py()) for v in b.column(5)) for b in sent) < 4096 + 1024


def test_category_booster_runs_with_its_usual_settings(spark, sf_dir, monkeypatch):
    seen = []

    def stop(self, df, is_validation=None, start_from=None):
        seen.append((self.trees, self.growth.max_depth, self.learning_rate, self.patience, self.max_bins))
        raise Stop

    monkeypatch.setattr(boost.Booster, "fit", stop)
    with pytest.raises(Stop):
        model_queries._category_boosted(spark, sf_dir)
    assert seen == [(1000, 6, 0.05, 50, 255)]


def test_all_models_run_with_their_usual_settings(spark, sf_dir, monkeypatch):
    usual, seen = model_queries.default_regressors, []

    def noted(columns, vector, label, trees=None, points=256):
        seen.append((len(columns), trees, points))
        return usual(columns, vector, label, trees, points)

    def stop(regressors, *rest):
        seen.append(len(regressors))
        raise Stop

    monkeypatch.setattr(model_queries, "default_regressors", noted)
    monkeypatch.setattr(model_queries, "fit_all", stop)
    with pytest.raises(Stop):
        model_queries._all_models(spark, sf_dir)
    assert seen == [(35, None, 256), 12]
