"""Registered profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import profile, ranks, sets
from tabloom.plans.registry import COLUMNS, NUMBERS, STRINGS, Catalog, rounded, union_all, with_property
from tabloom.session import reused
from tabloom.sources.fixture import property_table
from tabloom.sources.tables import read_table

INTS = {
    "year_sold", "month_sold", "year_built", "year_remodel", "overall_quality", "overall_condition", "total_rooms",
    "full_baths", "half_baths", "parking_capacity", "parking_year", "basement_full_baths", "basement_half_baths",
    "guest_rooms", "kitchens", "lounges", "property_class",
}
DISTINCT_COLUMNS = ["zone", "road_type", "central_ac", "overall_quality"]
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
BIVARIATE = ["land_area", "ground_area", "upper_area", "basement_area", "terrace_area"]


def _dtype(name: str) -> str:
    if name == "row_id":
        return "bigint"
    if name in STRINGS:
        return "string"
    return "int" if name in INTS else "double"


def _eager(operator, columns):
    """A query over a column subset of the property table, kept for the operator's passes."""

    def run(spark, sf_dir):
        with reused(property_table(spark, sf_dir).select(*columns)) as kept:
            return rounded(operator(kept))

    return run


def _per_column_sql(template: str, columns=NUMBERS) -> str:
    """``template`` once per column as {c}, from a single pass over prop."""
    return union_all([template.format(c=c) for c in columns])


def _quartiles_cte(columns=NUMBERS) -> str:
    fields = ", ".join(
        f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS q2_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
        for c in columns
    )
    return f"qs AS (SELECT {fields} FROM prop)"


def _fence(c: str) -> tuple[str, str]:
    return (f"(q1_{c} - 1.5 * (q3_{c} - q1_{c}))", f"(q3_{c} + 1.5 * (q3_{c} - q1_{c}))")


def _histogram_sql(value: str, name: str, bins: int) -> str:
    return (
        f"SELECT '{name}' AS column_name, CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / {bins}), 6) AS bin_low, "
        f"COUNT(*) AS n FROM (SELECT lo, hi, CASE WHEN lo = hi THEN 0 ELSE least(floor((x - lo) * {bins} / (hi - lo)), "
        f"{bins} - 1) END AS b FROM (SELECT CAST({value} AS DOUBLE) AS x FROM prop) v, "
        f"(SELECT CAST(MIN({value}) AS DOUBLE) AS lo, CAST(MAX({value}) AS DOUBLE) AS hi FROM prop) r "
        f"WHERE x IS NOT NULL) t GROUP BY b, lo, hi"
    )


def register(catalog: Catalog) -> None:
    add = catalog.add

    counts = ", ".join(f"COUNT({c}) AS n_{c}" for c in COLUMNS)
    add(
        "S3_schema_info",
        lambda spark, d: profile.schema_info(property_table(spark, d)),
        with_property(
            union_all(
                [
                    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{_dtype(c)}' AS dtype, "
                    f"n_{c} AS non_null, n_rows FROM a"
                    for i, c in enumerate(COLUMNS, start=1)
                ]
            ),
            f"a AS (SELECT COUNT(*) AS n_rows, {counts} FROM prop)",
        ),
    )

    missing = union_all(
        [
            f"SELECT '{c}' AS column_name, n_rows - n_{c} AS missing_count, "
            f"(n_rows - n_{c}) / CAST(n_rows AS DOUBLE) * 100 AS percentage FROM a"
            for c in COLUMNS
        ]
    )
    add(
        "A1_missing_summary",
        lambda spark, d: rounded(profile.missing_summary(property_table(spark, d))),
        with_property(
            f"SELECT column_name, missing_count, round(percentage, 6) AS percentage FROM ({missing}) m "
            "WHERE missing_count > 0 ORDER BY missing_count DESC, column_name",
            f"a AS (SELECT COUNT(*) AS n_rows, {counts} FROM prop)",
        ),
    )

    add(
        "A2_describe",
        _eager(lambda df: profile.describe(df, NUMBERS), NUMBERS),
        with_property(
            _per_column_sql(
                "SELECT '{c}' AS column_name, COUNT({c}) AS n, round(AVG({c}), 6) AS mean, "
                "round(stddev_samp({c}), 6) AS std, round(CAST(MIN({c}) AS DOUBLE), 6) AS min, "
                "round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
                "round(quantile_cont({c}, 0.75), 6) AS q75, round(CAST(MAX({c}) AS DOUBLE), 6) AS max FROM prop"
            )
        ),
    )
    for key, name in (("A3_skewness", "skewness"), ("A4_kurtosis", "kurtosis")):
        add(
            key,
            lambda spark, d, f=getattr(profile, name): rounded(f(property_table(spark, d), NUMBERS)),
            with_property(
                _per_column_sql(
                    f"SELECT '{{c}}' AS column_name, round({name}(CAST({{c}} AS DOUBLE)), 6) AS {name} FROM prop"
                )
            ),
        )
    add(
        "A5_quantile",
        _eager(lambda df: profile.quantiles(df, NUMBERS, QUANTILES), NUMBERS),
        with_property(
            union_all(
                [
                    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability, "
                    f"round(CAST(quantile_cont({c}, {p}) AS DOUBLE), 6) AS value FROM prop"
                    for c in NUMBERS
                    for p in QUANTILES
                ]
            )
        ),
    )
    add(
        "A6_mean_median_std",
        _eager(lambda df: profile.center_and_spread(df, ["target"]), ["target"]),
        with_property(
            "SELECT 'target' AS column_name, round(AVG(target), 6) AS mean, round(median(target), 6) AS median, "
            "round(stddev_samp(target), 6) AS std, round(skewness(target), 6) AS skewness, "
            "round(kurtosis(target), 6) AS kurtosis FROM prop"
        ),
    )

    pairs = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
    all_r = ", ".join(f'corr({a}, {b}) AS "r{i}"' for i, (a, b) in enumerate(pairs))
    pair_cte = f"cs AS (SELECT {all_r} FROM prop)"
    matrix_sql = union_all(
        [
            f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, CASE WHEN isnan(\"r{i}\") THEN NULL ELSE round(\"r{i}\", 6) END AS r FROM cs"
            for i, (a, b) in enumerate(pairs)
        ]
    )
    add(
        "A7_corr_matrix",
        _eager(lambda df: profile.correlation_matrix(df, NUMBERS), NUMBERS),
        with_property(matrix_sql, pair_cte),
    )
    add(
        "A8_high_corr_pairs",
        _eager(lambda df: profile.high_correlations(df, NUMBERS), NUMBERS),
        with_property(f"SELECT * FROM ({matrix_sql}) m WHERE abs(r) > 0.7", pair_cte),
    )
    add(
        "A9_target_corr",
        lambda spark, d: rounded(profile.target_correlation(property_table(spark, d), BIVARIATE, "target")),
        with_property(
            _per_column_sql("SELECT '{c}' AS column_name, round(corr({c}, target), 6) AS r FROM prop", BIVARIATE)
        ),
    )

    texts = union_all([f"SELECT '{c}' AS column_name, {c} AS value FROM prop WHERE {c} IS NOT NULL" for c in STRINGS])
    frequencies = f"vc AS (SELECT column_name, value, COUNT(*) AS n FROM ({texts}) t GROUP BY column_name, value)"
    add(
        "A10_value_counts",
        lambda spark, d: rounded(profile.value_counts(property_table(spark, d), STRINGS)),
        with_property(
            "SELECT column_name, value, n, round(n / CAST(SUM(n) OVER (PARTITION BY column_name) AS DOUBLE), 6) AS share "
            "FROM vc ORDER BY column_name, n DESC, value",
            frequencies,
        ),
    )
    add(
        "A11_nunique",
        lambda spark, d: profile.distinct_counts(property_table(spark, d), STRINGS),
        with_property(
            _per_column_sql(
                "SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_values FROM prop", STRINGS
            )
        ),
    )
    add(
        "A12_mode",
        lambda spark, d: profile.modes(property_table(spark, d), STRINGS),
        with_property(
            "SELECT column_name, value, n FROM (SELECT *, row_number() OVER (PARTITION BY column_name "
            "ORDER BY n DESC, value) AS rn FROM vc) t WHERE rn = 1",
            frequencies,
        ),
    )
    add(
        "A12_mode_ties",
        lambda spark, d: profile.modes(read_table(spark, d, "part"), ["p_brand", "p_type"]),
        union_all(
            [
                f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS n FROM part "
                f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) t"
                for c in ("p_brand", "p_type")
            ]
        ),
    )
    add(
        "A13_histogram",
        _eager(lambda df: profile.histogram(df, NUMBERS, 30), NUMBERS),
        with_property(union_all([_histogram_sql(c, c, 30) for c in NUMBERS])),
    )
    add(
        "A14_kde_curve",
        _kde,
        with_property(
            "SELECT point, round(lo + point * ((hi - lo) / 199), 6) AS x, "
            "round(SUM(w * exp(-0.5 * ((lo + point * ((hi - lo) / 199) - c) / h) * "
            "((lo + point * ((hi - lo) / 199) - c) / h))) / (n * h * sqrt(2 * pi())) * 1e9, 3) AS density_1e9 "
            "FROM cells, (SELECT CAST(unnest(range(200)) AS INTEGER) AS point) g, s GROUP BY point, lo, hi, n, h",
            "s AS (SELECT COUNT(target) AS n, MIN(target) AS lo, MAX(target) AS hi, "
            "stddev_samp(target) * pow(COUNT(target), -0.2) AS h FROM prop)",
            "cells AS (SELECT CAST(COUNT(*) AS DOUBLE) AS w, AVG(target) AS c FROM prop, s WHERE target IS NOT NULL "
            "GROUP BY least(floor((target - lo) * 1024 / (hi - lo)), 1023))",
        ),
    )
    normal = profile.NormalDist()
    marks = [((i + 0.5) / 99, normal.inv_cdf((i + 0.5) / 99)) for i in range(99)]
    mark_list = ", ".join(f"({p!r}::DOUBLE, {z!r}::DOUBLE)" for p, z in marks)
    wanted = "[" + ", ".join(repr(p) for p, _ in marks) + "]"
    add(
        "A15_qq_rows",
        lambda spark, d: ranks.qq_rows(property_table(spark, d), "road_access_length").select(
            "row_id", F.round("probability", 9).alias("probability"), "sample_quantile"
        ),
        with_property(
            "SELECT row_id, round((row_number() OVER (ORDER BY road_access_length, row_id) - 0.5E0) / COUNT(*) OVER (), 9) AS probability, "
            "road_access_length AS sample_quantile FROM prop WHERE road_access_length IS NOT NULL"
        ),
    )
    add(
        "A15_qq_points",
        _eager(lambda df: profile.qq_points(df, "target"), ["target"]),
        with_property(
            "SELECT round(p, 6) AS probability, round(z, 6) AS normal_quantile, round(v, 6) AS sample_quantile, "
            "round(regr_slope(v, z) OVER (), 6) AS line_slope, round(regr_intercept(v, z) OVER (), 6) AS line_intercept, "
            "round(corr(v, z) OVER (), 6) AS line_r FROM pts",
            f"m AS (SELECT p, z, row_number() OVER (ORDER BY p) AS i FROM (VALUES {mark_list}) t(p, z))",
            f"qa AS (SELECT quantile_cont(target, {wanted}) AS a FROM prop)",
            "pts AS (SELECT p, z, a[i] AS v FROM m, qa)",
        ),
    )
    add(
        "A16_boxplot_stats",
        _eager(lambda df: profile.boxplot_stats(df, NUMBERS), NUMBERS),
        with_property(
            union_all(
                [
                    f"SELECT '{c}' AS column_name, round(CAST(q1_{c} AS DOUBLE), 6) AS q25, "
                    f"round(CAST(q2_{c} AS DOUBLE), 6) AS q50, round(CAST(q3_{c} AS DOUBLE), 6) AS q75, "
                    f"round(CAST(MIN({c}) FILTER ({c} >= {_fence(c)[0]} AND {c} <= {_fence(c)[1]}) AS DOUBLE), 6) "
                    f"AS whisker_low, "
                    f"round(CAST(MAX({c}) FILTER ({c} >= {_fence(c)[0]} AND {c} <= {_fence(c)[1]}) AS DOUBLE), 6) "
                    f"AS whisker_high, "
                    f"COUNT(*) FILTER ({c} < {_fence(c)[0]} OR {c} > {_fence(c)[1]}) AS outliers "
                    f"FROM prop, qs GROUP BY q1_{c}, q2_{c}, q3_{c}"
                    for c in NUMBERS
                ]
            ),
            _quartiles_cte(),
        ),
    )
    add(
        "P7_iqr_outlier_flag",
        _eager(lambda df: profile.outlier_counts(df, NUMBERS), NUMBERS),
        with_property(
            union_all(
                [
                    f"SELECT '{c}' AS column_name, round({_fence(c)[0]}, 6) AS lower_fence, "
                    f"round({_fence(c)[1]}, 6) AS upper_fence, "
                    f"COUNT(*) FILTER ({c} < {_fence(c)[0]} OR {c} > {_fence(c)[1]}) AS outliers, "
                    f"round(COUNT(*) FILTER ({c} < {_fence(c)[0]} OR {c} > {_fence(c)[1]}) "
                    f"/ CAST(COUNT(*) AS DOUBLE) * 100, 6) AS percentage "
                    f"FROM prop, qs GROUP BY q1_{c}, q3_{c}"
                    for c in NUMBERS
                ]
            ),
            _quartiles_cte(),
        ),
    )
    bits = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in COLUMNS)
    add(
        "A17_null_patterns",
        lambda spark, d: profile.null_patterns(property_table(spark, d).select(*COLUMNS)),
        with_property(
            "SELECT pattern, COUNT(*) AS n, CAST(length(replace(pattern, '1', '')) AS INTEGER) AS present "
            f"FROM (SELECT {bits} AS pattern FROM prop) t GROUP BY pattern"
        ),
    )
    add(
        "A18_scatter_sample",
        _eager(lambda df: profile.scatter_bins(df, "ground_area", "target"), ["ground_area", "target"]),
        with_property(
            "SELECT CAST(least(floor((ground_area - xl) * 40 / (xh - xl)), 39) AS INTEGER) AS x_bin, "
            "CAST(least(floor((target - yl) * 40 / (yh - yl)), 39) AS INTEGER) AS y_bin, COUNT(*) AS n "
            "FROM prop, (SELECT MIN(ground_area) AS xl, MAX(ground_area) AS xh, MIN(target) AS yl, "
            "MAX(target) AS yh FROM prop) r WHERE ground_area IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2"
        ),
    )
    add(
        "A19_log_distribution",
        _eager(lambda df: profile.log_histogram(df, "target", 50), ["target"]),
        with_property(_histogram_sql("ln(1 + target)", "target", 50)),
    )
    whole = [c for c in COLUMNS if c != "row_id"]
    add(
        "U3_duplicate_count_all",
        lambda spark, d: profile.duplicate_count(property_table(spark, d).select(*whole)),
        with_property(
            "SELECT CAST(COUNT(*) - (SELECT COUNT(*) FROM "
            f"(SELECT DISTINCT {', '.join(whole)} FROM prop) u) AS BIGINT) AS duplicates FROM prop"
        ),
    )
    add(
        "U4_drop_duplicates_all",
        lambda spark, d: sets.drop_duplicates(property_table(spark, d).select(*whole)),
        with_property(f"SELECT DISTINCT {', '.join(whole)} FROM prop"),
    )
    columns = ", ".join(DISTINCT_COLUMNS)
    add(
        "U3_duplicate_count",
        lambda spark, d: profile.duplicate_count(property_table(spark, d).select(*DISTINCT_COLUMNS)),
        with_property(
            "SELECT CAST(COUNT(*) - (SELECT COUNT(*) FROM "
            f"(SELECT DISTINCT {columns} FROM prop) u) AS BIGINT) AS duplicates FROM prop"
        ),
    )
    add(
        "U4_drop_duplicates",
        lambda spark, d: sets.drop_duplicates(property_table(spark, d).select(*DISTINCT_COLUMNS)),
        with_property(f"SELECT DISTINCT {columns} FROM prop"),
    )
    add(
        "T1_sort_desc",
        lambda spark, d: profile.value_counts(property_table(spark, d), ["zone"])
        .select("value", "n")
        .orderBy(F.desc("n"), "value"),
        with_property("SELECT zone AS value, COUNT(*) AS n FROM prop GROUP BY zone ORDER BY n DESC, value"),
    )
    add(
        "T2_head_n",
        lambda spark, d: profile.head_rows(property_table(spark, d), "row_id", 5),
        with_property("SELECT * FROM prop ORDER BY row_id LIMIT 5"),
    )


def _kde(spark, sf_dir):
    with reused(property_table(spark, sf_dir).select("target")) as kept:
        curve = profile.kde_curve(kept, "target")
    return curve.select(
        "point", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e9, 3).alias("density_1e9")
    )
