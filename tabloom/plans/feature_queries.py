"""Registered scalar-function and feature-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import scalar
from tabloom.functions.features import FEATURE_SETS
from tabloom.plans.registry import COLUMNS, Catalog, rounded, with_property
from tabloom.sources.fixture import property_table

ROOMS = "(total_rooms + 1e-6)"
BUILDING = "(ground_area + upper_area + 1e-6)"
TOTAL = "(basement_area + ground_area + upper_area)"
BATHS = "(full_baths + 0.5E0 * half_baths + basement_full_baths + 0.5E0 * basement_half_baths)"
FACILITIES = "(basement_area + guest_rooms + lounges + kitchens)"


def _flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


POOL, TERRACE = _flag("pool_area > 0"), _flag("terrace_area > 0")
COOLED, FENCED = _flag("central_ac = 'Y'"), _flag("fence IS DISTINCT FROM 'None'")
PARKED, EXTRA, BASEMENT = _flag("parking_area > 0"), _flag("extra_value > 0"), _flag("basement_area > 0")
AMENITIES = f"({POOL} + {FENCED} + {TERRACE} + {PARKED} + {COOLED})"
RENOVATED = "(year_sold - year_remodel)"

# The SQL of every feature, as plain text per name.
SQL = {
    "total_area": TOTAL,
    "land_to_building_ratio": f"land_area / {BUILDING}",
    "low_quality_area_ratio": "low_quality_area / (usable_area + 1e-6)",
    "pool_to_land_ratio": "pool_area / (land_area + 1e-6)",
    "total_baths": BATHS,
    "avg_room_size": f"usable_area / {ROOMS}",
    "guest_room_ratio": f"guest_rooms / {ROOMS}",
    "rooms_with_kitchens": "total_rooms + kitchens",
    "parking_per_room": f"parking_capacity / {ROOMS}",
    "parking_area_per_car": "parking_area / (parking_capacity + 1e-6)",
    "property_age": "year_sold - year_built",
    "years_since_renovation": RENOVATED,
    "season_sold": "(month_sold - 1) // 3",
    "exterior_ratio": f"facade_area / {BUILDING}",
    "road_access_per_land": "road_access_length / (land_area + 1e-6)",
    "has_basement": BASEMENT,
    "has_pool": POOL,
    "has_extra_facility": EXTRA,
    "has_second_basement_facility": _flag("basement_type2 IS NOT NULL"),
    "has_enclosed_veranda": _flag("enclosed_veranda_area > 0"),
    "has_terrace": TERRACE,
    "total_facilities": FACILITIES,
    "basement_facilities_area": "basement_area1 + basement_area2",
    "basement_to_total": f"basement_area / ({TOTAL} + 1e-6)",
    "usable_area_per_room": "usable_area / (total_rooms + kitchens + 1e-6)",
    "bathrooms_per_room": f"{BATHS} / {ROOMS}",
    "age_since_renovation": f"CASE WHEN {RENOVATED} < 0 THEN 0 ELSE {RENOVATED} END",
    "amenities_count": AMENITIES,
    "area_per_facility": f"usable_area / ({FACILITIES} + 1e-6)",
    "basement_unfinished_ratio": "basement_unfinished_area / (basement_area + 1e-6)",
    "kitchens_per_room": f"kitchens / {ROOMS}",
    "road_access_per_room": f"road_access_length / {ROOMS}",
    "parking_to_facade": "parking_area / (facade_area + 1e-6)",
    "total_area_per_room": f"{TOTAL} / {ROOMS}",
    "bathrooms_per_kitchen": f"{BATHS} / (kitchens + 1e-6)",
    "age_per_room": f"(year_sold - year_built) / {ROOMS}",
    "renovation_ratio": f"{RENOVATED} / (year_sold - year_built + 1e-6)",
    "facade_per_total_area": f"facade_area / ({TOTAL} + 1e-6)",
    "has_any_facility": _flag(f"{POOL} + {TERRACE} + {BASEMENT} + {EXTRA} > 0"),
    "luxury_features_count": f"{AMENITIES} + guest_rooms + lounges",
}
OUTDOOR = "COALESCE(terrace_area + open_veranda_area + enclosed_veranda_area + screen_porch_area, 0)"
CORE_SQL = {
    "total_outdoor_area": OUTDOOR,
    "total_baths": f"COALESCE({BATHS}, 0)",
    "overall_score": "(overall_quality + overall_condition) / 2",
    "age": "year_sold - year_built",
    "years_since_remodel": "CASE WHEN year_remodel = year_built THEN year_sold - year_built "
    f"WHEN {RENOVATED} < 0 THEN 0 ELSE {RENOVATED} END",
    "quality_x_ground": "overall_quality * ground_area",
    "total_area": f"COALESCE(ground_area + upper_area + parking_area + {OUTDOOR}, 0)",
}
FEW_AMENITIES = f"({POOL} + {TERRACE} + {COOLED})"


def _set_sql(name: str) -> str:
    feature_set = FEATURE_SETS[name]()
    texts = SQL | (CORE_SQL if name == "core" else {}) | ({"amenities_count": FEW_AMENITIES} if name == "few" else {})
    kept = [c for c in COLUMNS if c not in feature_set.dropped]
    return with_property(
        "SELECT " + ", ".join(kept + [f"{texts[f]} AS {f}" for f in feature_set.names]) + " FROM prop"
    )


def register(catalog: Catalog) -> None:
    add = catalog.add

    def expressions(columns):
        """Columns are built when the query runs: names are listed without a session."""
        return lambda spark, d: property_table(spark, d).select("row_id", *columns())

    c = F.col
    add(
        "F1_log1p_target",
        lambda spark, d: rounded(
            property_table(spark, d).select("row_id", scalar.log_target(c("target")).alias("y")), 9
        ),
        with_property("SELECT row_id, round(ln(1 + target), 9) AS y FROM prop"),
    )
    add(
        "F2_expm1_back",
        lambda spark, d: rounded(
            property_table(spark, d).select(
                "row_id", scalar.target_from_log(scalar.log_target(c("target"))).alias("target")
            ),
            3,
        ),
        with_property("SELECT row_id, round(exp(ln(1 + target)) - 1, 3) AS target FROM prop"),
    )
    add(
        "F3_safe_ratio",
        expressions(lambda: [scalar.safe_ratio(c("usable_area"), c("total_rooms")).alias("ratio")]),
        with_property(f"SELECT row_id, usable_area / {ROOMS} AS ratio FROM prop"),
    )
    add(
        "F4_presence_flag",
        expressions(lambda: [scalar.positive_flag(c("basement_area")).alias("positive"),
            scalar.present_flag(c("basement_type2")).alias("present")]),
        with_property(
            f"SELECT row_id, {BASEMENT} AS positive, {_flag('basement_type2 IS NOT NULL')} AS present FROM prop"
        ),
    )
    add(
        "F5_flag_or",
        expressions(lambda: [scalar.any_flag(
                *[scalar.positive_flag(c(n)) for n in ("pool_area", "terrace_area", "basement_area", "extra_value")]
            ).alias("any_flag")]),
        with_property(
            f"SELECT row_id, greatest({POOL}, {TERRACE}, {BASEMENT}, {EXTRA}) AS any_flag FROM prop"
        ),
    )
    add(
        "F6_not_equal_flag",
        expressions(lambda: [scalar.differs_flag(c("fence"), "None").alias("fenced"),
            scalar.differs_flag(c("fence"), "MnPrv").alias("other_fence")]),
        with_property(
            f"SELECT row_id, {FENCED} AS fenced, {_flag('fence IS DISTINCT FROM ' + chr(39) + 'MnPrv' + chr(39))} "
            "AS other_fence FROM prop"
        ),
    )
    add(
        "F7_season",
        expressions(lambda: [scalar.season(c("month_sold")).alias("season")]),
        with_property("SELECT row_id, (month_sold - 1) // 3 AS season FROM prop"),
    )
    add(
        "F8_sum_then_fill",
        expressions(lambda: [scalar.sum_or_zero(c("terrace_area"), c("open_veranda_area"), c("screen_porch_area")).alias("total")]),
        with_property(
            "SELECT row_id, COALESCE(terrace_area + open_veranda_area + screen_porch_area, 0) AS total FROM prop"
        ),
    )
    keys = {
        "core": "F9_feature_set_core",
        "few": "F10_feature_set_few",
        "compact": "F11_feature_set_v2",
        "wide": "F12_feature_set_wide",
        "full": "F13_feature_set_all",
    }
    for name, key in keys.items():
        add(
            key,
            lambda spark, d, build=FEATURE_SETS[name]: build().apply(property_table(spark, d)),
            lambda name=name: _set_sql(name),
        )
