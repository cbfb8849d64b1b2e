import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.operators import histtree
from tabloom.operators.adaboost import AdaBoostR2
from tabloom.operators.histtree import Batch, Binning, binned_table, with_state

ROWS = 5000


def numbers(spark):
    rows = spark.range(ROWS).withColumnRenamed("id", "row_id").repartition(2, "row_id")
    return rows.select("row_id", F.expr("row_id % 97").alias("a"), F.expr("if(row_id % 5 = 0, null, row_id % 31)").alias("b"), F.expr("row_id * 0.5").alias("label"))


def rows_of(table, width):
    return [Batch.of(pa.RecordBatch.from_arrays(list(part.columns), names=part.schema.names), width) for part in table.toArrow().to_batches()]


def test_a_pass_is_handed_blocks_not_rows(spark):
    df = numbers(spark)
    binning = Binning.fit(df, ["a", "b"], 64)
    table = binned_table(df, binning, "label", "row_id", [1.0, 2.0])
    assert table.count() <= 8
    read = rows_of(with_state(table, 2, lambda batch: batch.state + batch.y[:, None]), 2)
    y, state = np.concatenate([b.y for b in read]), np.concatenate([b.state for b in read])
    assert sorted(y) == [i * 0.5 for i in range(ROWS)]
    assert (state == np.column_stack([y + 1.0, y + 2.0])).all()
    a = binning.matrix([y * 2 % 97, np.where(y * 2 % 5 == 0, np.nan, y * 2 % 31)])
    assert (np.concatenate([b.bins for b in read]) == a).all()


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(histtree, "BLOCK_BYTES", 4096)
    n, models = 1000, 64
    batch = Batch(np.zeros((n, 300), np.uint16), np.arange(n) * 1.0, np.zeros((n, models)), np.arange(n), np.zeros(n, np.int32))
    made = batch.blocks()
    assert max(sum(len(column[i].as_py()) for column in made.columns) for i in range(made.num_rows)) <= 4096
    back = Batch.of(made.slice(3), 300)
    assert back.bins.dtype == np.uint16 and list(back.y) == list(batch.y[3 * (n // made.num_rows + 1) :])


@pytest.mark.parametrize("ranges", [5000, 700])
def test_draws_do_not_depend_on_blocks(spark, monkeypatch, ranges):
    df = numbers(spark)
    booster = AdaBoostR2(["a", "b"], rounds=2, max_depth=2, resample=True, range_rows=ranges)
    whole = booster.fit(df)
    monkeypatch.setattr(histtree, "BLOCK_BYTES", 1024)
    small = booster.fit(df)
    assert [t.feature for t in whole.trees] == [t.feature for t in small.trees]
    assert [t.bin for t in whole.trees] == [t.bin for t in small.trees]
