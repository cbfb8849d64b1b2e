"""Registered cleaning, set and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.scalar import at_least_zero, update_where
from tabloom.functions.splits import holdout_split, in_holdout
from tabloom.operators import clean, sets
from tabloom.plans.registry import COLUMNS, HOLDOUT_SQL, NUMBERS, Catalog, rounded, union_all, with_property
from tabloom.session import reused
from tabloom.sources.fixture import property_table

THREE_AREAS = "(COALESCE(ground_area, 0) + COALESCE(upper_area, 0) + COALESCE(basement_area, 0))"
PLOTS_CTE = "p5 AS (SELECT * FROM prop WHERE NOT COALESCE(land_area > 50000 AND target < 200000, FALSE))"
FENCE_CTE = f"q AS (SELECT quantile_cont({THREE_AREAS}, 0.25) AS q1, quantile_cont({THREE_AREAS}, 0.75) AS q3 FROM p5)"
CLEAN_CTE = f"cleaned AS (SELECT p5.* FROM p5, q WHERE {THREE_AREAS} <= q3 + 3 * (q3 - q1))"
SPARSE = ("fence", "pool_area", "low_quality_area", "extra_value")  # what the 0.95 threshold drops


def _train_test(spark, sf_dir):
    """Training rows, and test rows without target and without the rows of one zone."""
    train, test = holdout_split(property_table(spark, sf_dir))
    return train, test.filter("zone <> 'MACHINERY'").drop("target")


def register(catalog: Catalog) -> None:
    add = catalog.add

    add(
        "P1_drop_columns",
        lambda spark, d: clean.drop_columns(property_table(spark, d), ["row_id", "target", "fence", "not_there"]),
        with_property(
            "SELECT " + ", ".join(c for c in COLUMNS if c not in ("row_id", "target", "fence")) + " FROM prop"
        ),
    )

    exempt = set(clean.ZERO_EXEMPT)
    numeric = {"row_id", *NUMBERS} - exempt
    rates = union_all(
        [
            f"SELECT '{c}' AS column_name, AVG(CASE WHEN {c} IS NULL THEN 1.0E0 ELSE 0.0E0 END) AS null_rate, "
            + (f"AVG(CASE WHEN {c} = 0 THEN 1.0E0 ELSE 0.0E0 END)" if c in numeric else "CAST(NULL AS DOUBLE)")
            + " AS zero_rate FROM prop"
            for c in COLUMNS
        ]
    )
    add(
        "P4_drop_sparse_cols",
        lambda spark, d: rounded(clean.sparsity(property_table(spark, d))),
        with_property(
            "SELECT column_name, round(null_rate, 6) AS null_rate, round(zero_rate, 6) AS zero_rate, "
            "CASE WHEN null_rate >= 0.95 THEN 'missing' WHEN zero_rate >= 0.95 THEN 'zero' ELSE 'keep' END AS verdict "
            f"FROM ({rates}) r"
        ),
    )
    add(
        "P4_kept_columns",
        lambda spark, d: clean.drop_sparse_columns(property_table(spark, d)),
        with_property("SELECT " + ", ".join(c for c in COLUMNS if c not in SPARSE) + " FROM prop"),
    )
    add(
        "P5_domain_outlier",
        lambda spark, d: clean.drop_cheap_large_plots(property_table(spark, d)),
        with_property("SELECT * FROM p5", PLOTS_CTE),
    )
    add(
        "P6_iqr_outlier_upper",
        lambda spark, d: clean.remove_outliers(property_table(spark, d)),
        with_property("SELECT * FROM cleaned", PLOTS_CTE, FENCE_CTE, CLEAN_CTE),
    )
    add(
        "P8_conditional_update",
        lambda spark, d: property_table(spark, d).select(
            "row_id",
            update_where(
                F.col("year_remodel") == F.col("year_built"),
                F.col("year_sold") - F.col("year_built"),
                F.col("year_sold") - F.col("year_remodel"),
            ).alias("years"),
        ),
        with_property(
            "SELECT row_id, CASE WHEN year_remodel = year_built THEN year_sold - year_built "
            "ELSE year_sold - year_remodel END AS years FROM prop"
        ),
    )
    add(
        "P9_where_clip",
        lambda spark, d: property_table(spark, d).select(
            "row_id",
            at_least_zero(F.col("year_sold") - F.col("year_remodel")).alias("years"),
            at_least_zero(F.col("basement_area") - 1000).alias("basement_over_1000"),
        ),
        with_property(
            "SELECT row_id, CASE WHEN year_sold - year_remodel < 0 THEN 0 ELSE year_sold - year_remodel END AS years, "
            "CASE WHEN basement_area - 1000 < 0 THEN 0 ELSE basement_area - 1000 END AS basement_over_1000 FROM prop"
        ),
    )

    def align(spark, d):
        train, test = _train_test(spark, d)
        return sets.align_schema(test.withColumn("extra", F.lit(1)).drop("kitchens"), train)

    add(
        "P10_align_schema",
        align,
        with_property(
            "SELECT "
            + ", ".join(
                "CAST(0 AS INTEGER) AS kitchens" if c == "kitchens"
                else "CAST(0 AS DOUBLE) AS target" if c == "target"
                else c
                for c in COLUMNS
            )
            + f" FROM prop WHERE {HOLDOUT_SQL} AND zone <> 'MACHINERY'"
        ),
    )
    add(
        "P11_not_null_filter",
        lambda spark, d: clean.not_null(property_table(spark, d).select("row_id", "land_area"), "land_area"),
        with_property("SELECT row_id, land_area FROM prop WHERE land_area IS NOT NULL"),
    )

    add(
        "U1_union_tagged",
        lambda spark, d: sets.union_tagged(*_train_test(spark, d)),
        with_property(
            f"SELECT *, 'train' AS split FROM prop WHERE NOT {HOLDOUT_SQL} UNION ALL "
            "SELECT * REPLACE (CAST(NULL AS DOUBLE) AS target), 'test' AS split FROM prop "
            f"WHERE {HOLDOUT_SQL} AND zone <> 'MACHINERY'"
        ),
    )
    add(
        "U2_split_back",
        lambda spark, d: sets.split_back(sets.union_tagged(*_train_test(spark, d)), "test").drop("target"),
        with_property(f"SELECT * EXCLUDE (target) FROM prop WHERE {HOLDOUT_SQL} AND zone <> 'MACHINERY'"),
    )
    def join_target(spark, d):
        prop = property_table(spark, d)
        features = prop.drop("target")
        return sets.attach_target(features, prop.select("row_id", "target").filter(~in_holdout()))

    add("J1_attach_target", join_target, with_property(f"SELECT * FROM prop WHERE NOT {HOLDOUT_SQL}"))

    def join_models(spark, d):
        with reused(property_table(spark, d).select("row_id", "overall_quality", "ground_area")) as prop:
            quality = prop.select("row_id", (F.col("overall_quality") * 9000.0).alias("prediction"))
            area = prop.filter("ground_area IS NOT NULL").select(
                "row_id", (F.col("ground_area") * 45.0).alias("prediction")
            )
            return sets.join_predictions({"by_quality": quality, "by_area": area})

    add(
        "J2_join_predictions",
        join_models,
        with_property(
            "SELECT row_id, overall_quality * 9000.0E0 AS by_quality, ground_area * 45.0E0 AS by_area FROM prop"
        ),
    )
