"""Registered imputation, encoding and scaling queries."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tabloom.functions.splits import in_holdout
from tabloom.operators import encode, prepare, ranks
from tabloom.plans.registry import HOLDOUT_SQL, Catalog, rounded, with_property
from tabloom.roles import Roles
from tabloom.session import reused, shared_path
from tabloom.sources.fixture import property_table
from tabloom.sources.store import load_or_fit

GAPS = ["land_area", "basement_area", "road_access_length", "facade_area", "parking_year", "basement_full_baths"]
SCALED = ["land_area", "ground_area", "overall_quality", "parking_area"]
NOMINAL = ["zone", "road_type", "kitchen_quality"]
LEVELS = {
    "zone": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "road_type": ["F", "O", "P"],
    "kitchen_quality": ["Ex", "Fa", "Gd", "TA"],
}
TRAIN_CTE = f"tr AS (SELECT * FROM prop WHERE NOT {HOLDOUT_SQL})"


def _tagged(df):
    return df.withColumn("split", F.when(in_holdout(), "test").otherwise("train"))


def _fit_transform(estimator, df, fit_on=None):
    return estimator.fit(df if fit_on is None else fit_on).transform(df)


def _imputed_sql(scope: str) -> str:
    """Nulls of GAPS filled with the medians of the training rows, of the own part, or of all rows."""
    medians = ", ".join(f"median({c}) AS m_{c}" for c in GAPS)
    filled = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), CAST(m_{c} AS DOUBLE)) AS {c}" for c in GAPS)
    if scope == "self":
        return with_property(
            f"SELECT row_id, {filled} FROM t JOIN m ON t.h = m.h",
            f"t AS (SELECT *, {HOLDOUT_SQL} AS h FROM prop)",
            f"m AS (SELECT h, {medians} FROM t GROUP BY h)",
        )
    source = "tr" if scope == "train" else "prop"
    return with_property(f"SELECT row_id, {filled} FROM prop, m", TRAIN_CTE, f"m AS (SELECT {medians} FROM {source})")


def _median_impute(scope):
    def run(spark, d):
        with reused(_tagged(property_table(spark, d).select("row_id", *GAPS))) as df:
            model = prepare.MedianImputer(inputCols=GAPS, tagCol="split", fitScope=scope).fit(df)
        return model.transform(_tagged(property_table(spark, d).select("row_id", *GAPS))).drop("split")

    return run


def _one_hot(spark, d):
    df = property_table(spark, d).select("row_id", *NOMINAL)
    train = df.filter(~in_holdout() & (F.col("zone") != "MACHINERY"))
    hot = Pipeline(stages=prepare.one_hot_stages(NOMINAL)).fit(train).transform(df)
    values = {c: vector_to_array(f"{c}_onehot") for c in NOMINAL}
    seen = LEVELS | {"zone": [z for z in LEVELS["zone"] if z != "MACHINERY"]}
    columns = [
        F.get(values[c], F.lit(i)).cast("int").alias(f"{c}_{level}")
        for c in NOMINAL
        for i, level in enumerate(seen[c])
    ]
    return hot.select("row_id", *columns, *[F.size(values[c]).alias(f"{c}_width") for c in NOMINAL])


def _indicator_sql(columns, drop_first, null_column) -> str:
    parts = []
    for c in columns:
        for level in LEVELS[c][1 if drop_first else 0 :]:
            parts.append(f"CASE WHEN {c} IS NOT DISTINCT FROM '{level}' THEN 1 ELSE 0 END AS \"{c}_{level}\"")
        if null_column:
            parts.append(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS \"{c}_nan\"")
    return with_property("SELECT row_id, " + ", ".join(parts) + " FROM prop")


def _indicators(drop_first, null_column):
    def run(spark, d):
        df = property_table(spark, d).select("row_id", *NOMINAL)
        return encode.indicator_columns(df, encode.sorted_levels(df, NOMINAL), drop_first, null_column)

    return run


def _scaled_sql(source: str, where: str = "") -> str:
    fits = ", ".join(f"AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED)
    values = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in SCALED)
    return with_property(
        f"SELECT row_id, {values} FROM prop, f {where}", TRAIN_CTE, f"f AS (SELECT {fits} FROM {source})"
    )


def _scale_all(spark, d):
    df = property_table(spark, d).select("row_id", *SCALED)
    return rounded(_fit_transform(prepare.StandardScale(inputCols=SCALED), df))


def _scale_from_train(spark, d):
    df = property_table(spark, d).select("row_id", *SCALED)
    model = prepare.StandardScale(inputCols=SCALED).fit(df.filter(~in_holdout()))
    return rounded(model.transform(df.filter(in_holdout())))


PREPARED_NUMERIC = ["land_area", "basement_area", "overall_quality"]
PREPARED_ROLES = Roles(
    id="row_id",
    target="target",
    numeric=tuple(PREPARED_NUMERIC),
    nominal=("zone", "road_type"),
    ordinal={"kitchen_quality": prepare.GRADES, "basement_height": prepare.HEIGHT_GRADES},
)


def _prepared_columns(prepared):
    """The vector as named columns, in vector order: grades, numbers, levels."""
    names = [*PREPARED_ROLES.ordinal, *PREPARED_NUMERIC] + [
        f"{c}_{level}" for c in PREPARED_ROLES.nominal for level in LEVELS[c]
    ]
    x = vector_to_array("features")
    return prepared.select("row_id", *[F.round(F.get(x, F.lit(i)), 6).alias(n) for i, n in enumerate(names)])


def _prepare_input(spark, d):
    return property_table(spark, d).select(
        "row_id", *PREPARED_NUMERIC, *PREPARED_ROLES.nominal, *PREPARED_ROLES.ordinal
    )


def _column_transformer(spark, d):
    with reused(_prepare_input(spark, d)) as df:
        model = prepare.preparation(PREPARED_ROLES).fit(df.filter(~in_holdout()))
    return _prepared_columns(prepare.transform(model, _prepare_input(spark, d), ["row_id"]))


def _cached_preparation(spark, d):
    """Fit and save on the first call, load on the second; the loaded one transforms."""
    path = shared_path(spark, "preparation")
    with reused(_prepare_input(spark, d).filter(~in_holdout())) as train:
        load_or_fit(path, prepare.preparation(PREPARED_ROLES), train)
    loaded = PipelineModel.load(path)
    return _prepared_columns(prepare.transform(loaded, _prepare_input(spark, d), ["row_id"]))


def _prepared_sql() -> str:
    grade = (
        "CASE COALESCE({c}, 'None') WHEN 'Ex' THEN 5 WHEN 'Gd' THEN 4 WHEN 'TA' THEN 3 WHEN 'Fa' THEN 2 "
        "WHEN 'Po' THEN 1 ELSE 0 END"
    )
    graded = list(PREPARED_ROLES.ordinal)
    filled = [f"COALESCE({c}, (SELECT median({c}) FROM tr)) AS {c}" for c in PREPARED_NUMERIC]
    ranks = [f"{grade.format(c=c)} AS {c}" for c in graded]
    numbers = graded + PREPARED_NUMERIC
    fits = ", ".join(f"AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in numbers)
    values = [f"round((v.{c} - m_{c}) / s_{c}, 6) AS {c}" for c in numbers]
    values += [
        f"CASE WHEN {c} = '{level}' THEN 1.0E0 ELSE 0.0E0 END AS \"{c}_{level}\""
        for c in PREPARED_ROLES.nominal
        for level in LEVELS[c]
    ]
    return with_property(
        f"SELECT row_id, {', '.join(values)} FROM v, f",
        TRAIN_CTE,
        f"v AS (SELECT row_id, zone, road_type, {', '.join(filled + ranks)} FROM prop)",
        f"f AS (SELECT {fits} FROM v WHERE NOT {HOLDOUT_SQL})",
    )


def _native_categories(spark, d):
    numeric = ["overall_quality", "year_built", "month_sold"]
    with reused(property_table(spark, d).select("row_id", "target", "zone", "road_type", *numeric)) as df:
        tree = DecisionTreeRegressor(labelCol="target", maxDepth=4, maxBins=64, seed=42)
        stages = [*prepare.native_category_stages(["zone", "road_type"], numeric), tree]
        model = Pipeline(stages=stages).fit(df.filter(~in_holdout()))
    scored = model.transform(property_table(spark, d).select("row_id", "zone", "road_type", *numeric))
    return scored.select("row_id", "prediction")


def _target_statistics(spark, d):
    with reused(property_table(spark, d).select("row_id", "zone", "target")) as df:
        statistics = encode.TargetStatistics.fit(df, "zone", unit=0.01)
    df = property_table(spark, d).select("row_id", "zone", "target")
    return rounded(statistics.encode_training(df, "zone_mean").select("row_id", "zone_mean"))


def _target_statistics_new(spark, d):
    train = property_table(spark, d).select("row_id", "zone", "target").filter(
        ~in_holdout() & (F.col("zone") != "MACHINERY")
    )
    statistics = encode.TargetStatistics.fit(train, "zone", unit=0.01)
    new = property_table(spark, d).select("row_id", "zone").filter(in_holdout())
    return rounded(statistics.encode_new(new, statistics.level_table(train), "zone_mean"))


def register(catalog: Catalog) -> None:
    add = catalog.add
    add("E1_impute_median", _median_impute("train"), _imputed_sql("train"))
    add("E2_impute_fit_scope", _median_impute("self"), _imputed_sql("self"))
    add("E2_impute_union_scope", _median_impute("union"), _imputed_sql("union"))

    context = ["row_id", "parking_year", "pool_area", "facade_area", "land_area"]

    def impute_context(spark, d):
        df = property_table(spark, d).select(*context, "year_built")
        filled = prepare.ContextImputer().transform(df).drop("year_built")
        return _fit_transform(prepare.MedianImputer(inputCols=["land_area"]), filled)

    add(
        "E3_impute_context",
        impute_context,
        with_property(
            "SELECT row_id, COALESCE(parking_year, year_built) AS parking_year, COALESCE(pool_area, 0) AS pool_area, "
            "COALESCE(facade_area, 0) AS facade_area, "
            "COALESCE(land_area, (SELECT median(land_area) FROM prop)) AS land_area FROM prop"
        ),
    )
    texts = ["kitchen_quality", "fence", "basement_type2"]
    add(
        "E4_impute_constant",
        lambda spark, d: prepare.FillValues(values={c: "MISSING" for c in texts}).transform(
            property_table(spark, d).select("row_id", *texts)
        ),
        with_property("SELECT row_id, " + ", ".join(f"COALESCE({c}, 'MISSING') AS {c}" for c in texts) + " FROM prop"),
    )
    add(
        "E5_impute_mode",
        lambda spark, d: _fit_transform(
            prepare.ModeImputer(inputCols=texts), property_table(spark, d).select("row_id", *texts)
        ),
        with_property(
            "SELECT row_id, "
            + ", ".join(
                f"COALESCE({c}, (SELECT {c} FROM prop WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY COUNT(*) DESC, {c} LIMIT 1)) AS {c}"
                for c in texts
            )
            + " FROM prop"
        ),
    )
    graded = ["kitchen_quality", "exterior_quality", "basement_height"]
    add(
        "E6_ordinal_map",
        lambda spark, d: prepare.GradeEncoder(
            mappings={c: prepare.GRADED_COLUMNS[c] for c in graded}
        ).transform(property_table(spark, d).select("row_id", *graded)),
        with_property(
            "SELECT row_id, "
            + ", ".join(
                f"CASE {c} WHEN 'Ex' THEN 5 WHEN 'Gd' THEN 4 WHEN 'TA' THEN 3 WHEN 'Fa' THEN 2 WHEN 'Po' THEN 1 "
                f"ELSE 0 END AS {c}"
                for c in graded
            )
            + " FROM prop"
        ),
    )
    seen = LEVELS | {"zone": [z for z in LEVELS["zone"] if z != "MACHINERY"]}
    add(
        "E7_one_hot_ignore",
        _one_hot,
        with_property(
            "SELECT row_id, "
            + ", ".join(
                f"CASE WHEN {c} IS NOT DISTINCT FROM '{level}' THEN 1 ELSE 0 END AS \"{c}_{level}\""
                for c in NOMINAL
                for level in seen[c]
            )
            + ", "
            + ", ".join(f"CAST({len(seen[c])} AS INTEGER) AS {c}_width" for c in NOMINAL)
            + " FROM prop"
        ),
    )
    add("E8_dummies_drop_first", _indicators(True, False), _indicator_sql(NOMINAL, True, False))
    add("E9_dummies_with_na", _indicators(False, True), _indicator_sql(NOMINAL, False, True))

    def codes(spark, d):
        df = property_table(spark, d).select("row_id", "zone", "kitchen_quality")
        return encode.category_codes(encode.category_codes(df, "zone"), "kitchen_quality")

    def code_sql(c):
        return (
            f"(SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code "
            f"FROM (SELECT DISTINCT {c} FROM prop WHERE {c} IS NOT NULL) u)"
        )

    add(
        "E10_category_codes",
        codes,
        with_property(
            "SELECT row_id, zone, kitchen_quality, COALESCE(a.code, -1) AS zone_code, "
            "COALESCE(b.code, -1) AS kitchen_quality_code FROM prop "
            f"LEFT JOIN {code_sql('zone')} a ON a.v = zone LEFT JOIN {code_sql('kitchen_quality')} b "
            "ON b.v = kitchen_quality"
        ),
    )
    sparse = [*NOMINAL, "year_built"]

    def sparse_levels(spark, d):
        df = property_table(spark, d).select("row_id", *sparse)
        found = ranks.one_hot_positions(df, ranks.level_positions(df, sparse), sparse, "row_id")
        return found.select("row_id", F.explode("indices").alias("position"))

    pairs = " UNION ALL ".join(f"SELECT row_id, {i} AS c, CAST({c} AS VARCHAR) AS v FROM prop WHERE {c} IS NOT NULL" for i, c in enumerate(sparse))
    add(
        "E7_sparse_levels",
        sparse_levels,
        with_property(
            "SELECT row_id, position FROM pairs JOIN (SELECT c, v, row_number() OVER (ORDER BY c, v) - 1 AS position FROM "
            "(SELECT DISTINCT c, v FROM pairs) u) l USING (c, v)",
            f"pairs AS ({pairs})",
        ),
    )
    add("E11_native_category", _native_categories)
    add("E12_standard_scale", _scale_all, _scaled_sql("prop"))
    add("E13_column_transformer", _column_transformer, _prepared_sql())

    def polynomial(spark, d):
        df = property_table(spark, d).select("row_id", "overall_quality", "land_area").na.fill(0.0)
        model = Pipeline(stages=prepare.polynomial_stages(["overall_quality", "land_area"])).fit(df)
        x = vector_to_array("features")
        names = ["q", "qq", "a", "qa", "aa"]
        return model.transform(df).select("row_id", *[F.get(x, F.lit(i)).alias(n) for i, n in enumerate(names)])

    add(
        "E14_poly_features",
        polynomial,
        with_property(
            "SELECT row_id, q, q * q AS qq, a, q * a AS qa, a * a AS aa FROM (SELECT row_id, "
            "CAST(overall_quality AS DOUBLE) AS q, COALESCE(land_area, 0) AS a FROM prop) t"
        ),
    )
    add("E15_unify_scale", _scale_from_train, _scaled_sql("tr", f"WHERE {HOLDOUT_SQL}"))
    add("S8_prep_cache", _cached_preparation, _prepared_sql())

    units = "CAST(round(target / 0.01) AS BIGINT)"
    prior = f"(SELECT SUM({units}) * 0.01 / COUNT(*) FROM prop)"
    order = "(ORDER BY md5(CAST(row_id AS VARCHAR)), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    over = order.replace("(ORDER", "(PARTITION BY zone ORDER")
    add(
        "W2_ordered_target_stats",
        _target_statistics,
        with_property(
            f"SELECT row_id, round((COALESCE(SUM({units}) OVER {over}, 0) * 0.01E0 + {prior}) / "
            f"(COUNT(*) OVER {over} + 1), 6) AS zone_mean FROM prop"
        ),
    )
    add(
        "W2_target_stats_new_rows",
        _target_statistics_new,
        with_property(
            "SELECT row_id, zone, round((COALESCE(t, 0) * 0.01E0 + p) / (COALESCE(n, 0) + 1), 6) AS zone_mean "
            "FROM prop LEFT JOIN l USING (zone), "
            f"(SELECT SUM({units}) * 0.01E0 / COUNT(*) AS p FROM lt) g WHERE {HOLDOUT_SQL}",
            TRAIN_CTE,
            "lt AS (SELECT * FROM tr WHERE zone <> 'MACHINERY')",
            f"l AS (SELECT zone, SUM({units}) AS t, COUNT(*) AS n FROM lt GROUP BY zone)",
        ),
    )


