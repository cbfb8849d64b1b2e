import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tabloom.functions import scalar
from tabloom.functions.splits import fold_number, in_holdout
from tabloom.operators import clean, encode, prepare, ranks, sets
from tabloom.roles import Roles, detect_target, first_columns
from tabloom.sources import sinks
from tabloom.sources.csv import read_csv
from tabloom.sources.store import load_or_fit
from tabloom.sources.tables import SourceNotFound, read_table
from tabloom.streaming.scoring import score_stream


def test_missing_sources_are_reported(spark, tmp_path):
    with pytest.raises(SourceNotFound):
        read_table(spark, str(tmp_path), "nothing")
    with pytest.raises(SourceNotFound):
        read_csv(spark, str(tmp_path / "nothing.csv"))
    assert sinks.read_results(spark, str(tmp_path / "none")).count() == 0


def test_csv_types_and_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,n,x,s,e\n1,5,1.5,None,NA\n2,NA,2,b,\n3,7,,NA,nan\n")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "n": "bigint", "x": "double", "s": "string", "e": "string"}
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(1, 5, 1.5, None, None), (2, None, 2.0, "b", None), (3, 7, None, None, None)]
    typed = read_csv(spark, str(tmp_path / "t.csv"), schema="id int, n double, x string, s string, e string")
    assert dict(typed.dtypes)["n"] == "double"


def test_roles_come_from_the_schema(prop):
    roles = Roles.from_schema(prop, ordinal=prepare.GRADED_COLUMNS | {"overall_quality": prepare.GRADES})
    assert set(roles.ordinal) == {"kitchen_quality", "exterior_quality", "basement_height"}
    assert "overall_quality" in roles.numeric and "row_id" not in roles.numeric
    assert detect_target(prop, ["price", "target"]) == "target" and detect_target(prop, ["price"]) is None
    assert first_columns(list("abcdefg")) == list("abcde")


def test_null_semantics(spark):
    df = spark.createDataFrame([(None, None), (60000.0, None), (60000.0, 1.0), (1.0, 1.0)], "land_area double, target double")
    assert clean.drop_cheap_large_plots(df).count() == 3
    x = spark.createDataFrame([(None, None), (-1.0, "None"), (2.0, "Y")], "x double, s string")
    c = F.col
    rows = x.select(
        scalar.positive_flag(c("x")), scalar.differs_flag(c("s"), "None"), scalar.equals_flag(c("s"), "Y"),
        scalar.at_least_zero(c("x")), scalar.sum_or_zero(c("x"), F.lit(1.0)), scalar.present_flag(c("x")),
    ).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 0, None, 0.0, 0), (0, 0, 0, 0.0, 0.0, 1), (1, 1, 1, 2.0, 3.0, 1)]
    months = spark.range(1, 13).select(scalar.season(c("id")).alias("s")).collect()
    assert [r["s"] for r in months] == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3


def test_sparse_columns_and_fence(prop):
    assert set(clean.sparse_columns(prop)) == {"fence", "pool_area", "low_quality_area", "extra_value"}
    kept = clean.drop_cheap_large_plots(prop)
    total = kept.select("ground_area", "upper_area", "basement_area").toPandas().fillna(0).sum(axis=1)
    fence = clean.fit_upper_fence(kept)
    assert (fence.q1, fence.q3) == tuple(total.quantile([0.25, 0.75]))


def test_splits_ignore_partitioning(prop):
    a = {tuple(r) for r in prop.select("row_id", in_holdout(), fold_number(5)).collect()}
    assert a == {tuple(r) for r in prop.repartition(9).select("row_id", in_holdout(), fold_number(5)).collect()}


def test_scaler_and_grades(spark):
    df = spark.createDataFrame([(1.0, 4.0, "Ex"), (3.0, 4.0, None), (5.0, 4.0, "??")], "x double, c double, g string")
    scaled = prepare.StandardScale(inputCols=["x", "c"]).fit(df).transform(df).toPandas()
    np.testing.assert_allclose(scaled["x"], (np.array([1, 3, 5]) - 3) / np.std([1, 3, 5]))
    assert list(scaled["c"]) == [0.0, 0.0, 0.0]
    graded = prepare.GradeEncoder(mappings={"g": prepare.GRADES}).transform(df)
    assert [r["g"] for r in graded.collect()] == [5, 0, 0]


def test_saved_preparation_equals_fresh_one_and_scores_a_stream(spark, prop, tmp_path):
    roles = Roles("row_id", "target", ("land_area", "year_built"), ("zone",), {"kitchen_quality": prepare.GRADES})
    path = str(tmp_path / "preparation")
    fresh = load_or_fit(path, prepare.preparation(roles), prop)
    again = load_or_fit(path, prepare.preparation(roles), prop.limit(0))
    want = {r["row_id"]: r["features"] for r in prepare.transform(fresh, prop, ["row_id"]).collect()}
    assert want == {r["row_id"]: r["features"] for r in prepare.transform(again, prop, ["row_id"]).collect()}
    assert all(sum(v.toArray()[3:]) <= 1 for v in want.values())
    prop.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(prop.schema).parquet(str(tmp_path / "in"))
    loaded = PipelineModel.load(path)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    score_stream(stream, lambda df: prepare.transform(loaded, df, ["row_id"]), out, mark).awaitTermination(90)
    assert {r["row_id"]: r["features"] for r in spark.read.parquet(out).collect()} == want


def test_level_codes_are_positions_among_sorted_levels(spark):
    values = [None if i % 3 == 0 else f"k{i % 7}" for i in range(60)] + [f"x{i * 7919 % 500:04}" for i in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, k string").repartition(7)
    order = sorted({v for v in values if v is not None})
    want = {(i, v, -1 if v is None else order.index(v)) for i, v in enumerate(values)}
    assert {tuple(r) for r in encode.category_codes(df, "k").collect()} == want


def test_ranks_within_groups_with_nulls_and_ties(spark):
    rows = [(None if i % 4 == 0 else i % 4, None if i % 10 == 0 else float(i * 37 % 50), i) for i in range(300)] + [(1, 3.0, 7)] * 50
    df = spark.createDataFrame(rows, "g int, v double, i long").repartition(6)
    found = ranks.with_rank(df, ["v"], "place", ["g"]).collect()
    assert sorted(map(repr, ((r["g"], r["v"], r["i"]) for r in found))) == sorted(map(repr, rows))
    for g in {r[0] for r in rows}:
        own = sorted((r for r in found if r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own))) and {r["place_of"] for r in own} == {len(own)}
        values = [(r["v"] is not None, r["v"] or 0.0) for r in own]
        assert values == sorted(values)
    assert ranks.with_rank(df.limit(0), ["v"]).count() == 0


def test_one_hot_positions_equal_dense_vectors(spark):
    rows = [(i, None if i % 5 == 0 else f"a{i % 3}", f"b{i % 4}") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, c string, d string")
    positions = ranks.level_positions(df, ["c", "d"])
    assert [(r["column_name"], r["level"]) for r in positions.orderBy("position").collect()] == [("c", f"a{k}") for k in range(3)] + [("d", f"b{k}") for k in range(4)]
    got = {r["row_id"]: r["indices"] for r in ranks.one_hot_positions(df, positions, ["c", "d"], "row_id").collect()}
    assert got == {i: [*([] if c is None else [int(c[1])]), 3 + int(d[1])] for i, c, d in rows}
    new = spark.createDataFrame([(1, "zz", None), (2, "a1", "b0")], "row_id long, c string, d string")
    assert {tuple(r["indices"]) for r in ranks.one_hot_positions(new, positions, ["c", "d"], "row_id").collect()} == {(), (1, 3)}


def test_qq_rows_are_all_points(spark):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else float(i * 17 % 40)) for i in range(90)], "row_id long, x double")
    rows = sorted(ranks.qq_rows(df, "x").collect(), key=lambda r: r["probability"])
    assert len(rows) == 80 and [r["sample_quantile"] for r in rows] == sorted(r["sample_quantile"] for r in rows)
    assert rows[0]["probability"] == 0.5 / 80 and abs(rows[39]["normal_quantile"] + rows[40]["normal_quantile"]) < 1e-12


def test_too_many_indicator_columns_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_INDICATOR_COLUMNS", 3)
    df = spark.range(9).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(ValueError):
        encode.sorted_levels(df, ["k"])


def test_target_statistics_of_a_hot_category_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(encode.TargetStatistics, "ROWS_PER_BUCKET", 5)
    df = spark.range(200).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 10 == 1, "rare").otherwise("hot").alias("k"),
        (F.col("id") % 17).cast("double").alias("target"),
    )
    statistics = encode.TargetStatistics.fit(df, "k")
    assert statistics._digits == 2
    got = {r["row_id"]: r["m"] for r in statistics.encode_training(df, "m").collect()}
    rows = df.withColumn("o", F.md5(F.col("row_id").cast("string").cast("binary"))).orderBy("o").collect()
    seen: dict = {}
    for r in rows:
        total, n = seen.get(r["k"], (0.0, 0))
        assert got[r["row_id"]] == pytest.approx((total + statistics.prior) / (n + 1))
        seen[r["k"]] = (total + r["target"], n + 1)
    levels = statistics.level_table(df)
    new = spark.createDataFrame([(1, "hot"), (2, None), (3, "new")], "row_id long, k string")
    encoded = {r["row_id"]: r["m"] for r in statistics.encode_new(new, levels, "m").collect()}
    for key, level in ((1, "hot"), (2, None)):
        total, n = seen[level]
        assert encoded[key] == pytest.approx((total + statistics.prior) / (n + 1))
    assert encoded[3] == pytest.approx(statistics.prior)


def test_union_align_and_results(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0, "x")], "row_id long, target double, s string")
    b = spark.createDataFrame([(2, "y", 5)], "row_id long, s string, extra int")
    both = sets.union_tagged(a, b)
    assert sets.split_back(both, "test").first()["target"] is None
    assert sets.align_schema(b, a).columns == a.columns and sets.align_schema(b, a).first()["target"] == 0.0
    path = str(tmp_path / "results")
    for name, error in (("m1", 3.0), ("m2", 2.0), ("m1", 1.0)):
        sinks.append_results(spark, path, [("run", name, error)])
    board = [tuple(r) for r in sinks.leaderboard(sinks.read_results(spark, path)).collect()]
    assert board == [(1, "m1", 1.0), (2, "m2", 2.0)]
