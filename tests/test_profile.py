import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions.moments import moment_table
from tabloom.operators import profile
from tabloom.operators.quantiles import exact_quantiles

COLUMNS = ["land_area", "ground_area", "target", "pool_area", "overall_quality"]
PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]


@pytest.fixture(scope="module")
def frame(prop):
    return prop.select(*COLUMNS).toPandas()


@pytest.mark.parametrize("direct_values,slices", [(10**9, 1000), (200, 10), (50, 3)])
def test_quantiles_equal_numpy_on_every_path(prop, frame, direct_values, slices):
    got = exact_quantiles(prop, {c: PROBABILITIES for c in COLUMNS}, direct_values=direct_values, slices=slices)
    for c in COLUMNS:
        want = frame[c].astype(float).quantile(PROBABILITIES).to_numpy()
        np.testing.assert_allclose(got[c], want, rtol=1e-12, err_msg=c)


def test_quantiles_of_hot_and_empty_columns(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id").cast("double")).alias("hot"),
        F.lit(None).cast("double").alias("empty"),
        F.lit(1.5).alias("constant"),
    )
    got = exact_quantiles(df, {c: [0.1, 0.5, 0.9] for c in df.columns}, direct_values=20, slices=4)
    hot = pd.Series([7.0 if i % 3 else float(i) for i in range(3000)]).quantile([0.1, 0.5, 0.9])
    assert got["hot"] == pytest.approx(list(hot))
    assert got["empty"] == [None, None, None]
    assert got["constant"] == [1.5, 1.5, 1.5]


def test_moments_equal_pandas_and_ignore_partitioning(spark, prop, frame):
    for df in (prop, prop.repartition(7)):
        rows = {r["column_name"]: r for r in profile.skewness(df, COLUMNS).collect()}
        tails = {r["column_name"]: r for r in profile.kurtosis(df, COLUMNS).collect()}
        for c in COLUMNS:
            assert rows[c]["skewness"] == pytest.approx(frame[c].astype(float).skew(), rel=1e-9)
            assert tails[c]["kurtosis"] == pytest.approx(frame[c].astype(float).kurt(), rel=1e-9)


def test_known_shape_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 10, 50)], "x double")
    row = profile.center_and_spread(df, ["x"]).first()
    assert row["skewness"] == pytest.approx(2.30228140, abs=1e-8)
    assert row["kurtosis"] == pytest.approx(5.37393756, abs=1e-8)
    assert row["std"] == pytest.approx(19.22151572, abs=1e-8)


def test_degenerate_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (1.0, None, float("nan"))], "c double, e double, n double")
    rows = {r["column_name"]: r for r in moment_table(df, ["c", "e", "n"]).collect()}
    assert (rows["c"]["n"], rows["e"]["n"], rows["n"]["n"]) == (2, 0, 1)
    assert all(r["skewness"] is None for r in profile.skewness(df, ["c", "e", "n"]).collect())
    assert profile.correlation_matrix(df.select("c", "n"), ["c", "n"]).first()["r"] is None
    counts = {r["column_name"]: (r["bin"], r["n"]) for r in profile.histogram(df, ["c", "e", "n"], 30).collect()}
    assert counts == {"c": (0, 2), "n": (0, 1)}


def test_correlations_equal_pandas(prop, frame):
    got = {(r["feature_1"], r["feature_2"]): r["r"] for r in profile.correlation_matrix(prop, COLUMNS).collect()}
    want = frame.astype(float).corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], rel=1e-9)


def test_density_integrates_to_one(prop):
    curve = profile.kde_curve(prop, "target").orderBy("x").toPandas()
    assert np.trapezoid(curve["density"], curve["x"]) == pytest.approx(1.0, abs=0.03)


def test_null_patterns_cover_every_row(prop):
    assert profile.null_patterns(prop).agg(F.sum("n")).first()[0] == prop.count()


def test_a_column_that_is_constant_where_the_other_is_known_has_no_correlation(spark):
    rows = spark.range(0, 300_000, 1, 7).select("id", F.expr("if(id % 5 = 0, null, id % 15 * 1.0D)").alias("a"))
    rows = rows.select("a", *[F.expr(f"if(id % 5 = 0, {k}.7D, 1.{k}D)").alias(f"b{k}") for k in range(1, 6)])
    found = {(r["feature_1"], r["feature_2"]): r["r"] for r in profile.correlation_matrix(rows, rows.columns).collect()}
    assert [found["a", f"b{k}"] for k in range(1, 6)] == [None] * 5
