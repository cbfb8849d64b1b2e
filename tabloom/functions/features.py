"""Feature sets over the property table.

A set is a list of layers.  A layer holds expressions that need only the
columns of the table and of earlier layers, and becomes one projection, so no
expression is repeated inside another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalar import (
    any_flag,
    at_least_zero,
    differs_flag,
    equals_flag,
    positive_flag,
    present_flag,
    safe_ratio,
    season,
    sum_or_zero,
    update_where,
)

# Column names of the wide source table and the names used here.
SOURCE_NAMES = {
    "Id": "row_id",
    "HotelValue": "target",
    "LandArea": "land_area",
    "GroundFloorArea": "ground_area",
    "UpperFloorArea": "upper_area",
    "BasementTotalSF": "basement_area",
    "BasementFacilitySF1": "basement_area1",
    "BasementFacilitySF2": "basement_area2",
    "BasementUnfinishedSF": "basement_unfinished_area",
    "UsableArea": "usable_area",
    "LowQualityArea": "low_quality_area",
    "TerraceArea": "terrace_area",
    "OpenVerandaArea": "open_veranda_area",
    "EnclosedVerandaArea": "enclosed_veranda_area",
    "ScreenPorchArea": "screen_porch_area",
    "ParkingArea": "parking_area",
    "ParkingCapacity": "parking_capacity",
    "ParkingConstructionYear": "parking_year",
    "SwimmingPoolArea": "pool_area",
    "FacadeArea": "facade_area",
    "RoadAccessLength": "road_access_length",
    "ExtraFacilityValue": "extra_value",
    "FullBaths": "full_baths",
    "HalfBaths": "half_baths",
    "BasementFullBaths": "basement_full_baths",
    "BasementHalfBaths": "basement_half_baths",
    "TotalRooms": "total_rooms",
    "GuestRooms": "guest_rooms",
    "Kitchens": "kitchens",
    "Lounges": "lounges",
    "OverallQuality": "overall_quality",
    "OverallCondition": "overall_condition",
    "ConstructionYear": "year_built",
    "RenovationYear": "year_remodel",
    "YearSold": "year_sold",
    "MonthSold": "month_sold",
    "PropertyClass": "property_class",
    "KitchenQuality": "kitchen_quality",
    "ExteriorQuality": "exterior_quality",
    "ExteriorCondition": "exterior_condition",
    "HeatingQuality": "heating_quality",
    "LoungeQuality": "lounge_quality",
    "ParkingQuality": "parking_quality",
    "ParkingCondition": "parking_condition",
    "PoolQuality": "pool_quality",
    "BasementCondition": "basement_condition",
    "BasementExposure": "basement_exposure",
    "BasementHeight": "basement_height",
    "BasementFacilityType2": "basement_type2",
    "LandElevation": "land_elevation",
    "LandSlope": "land_slope",
    "BoundaryFence": "fence",
    "CentralAC": "central_ac",
}

# Columns that the core set replaces by its sums and ages.
CORE_INPUTS_DROPPED = (
    "ground_area",
    "upper_area",
    "year_built",
    "year_remodel",
    "full_baths",
    "half_baths",
    "basement_full_baths",
    "basement_half_baths",
    "basement_area1",
    "basement_area2",
    "terrace_area",
    "open_veranda_area",
    "enclosed_veranda_area",
    "screen_porch_area",
)

Layer = Mapping[str, Column]


def with_source_names(df: DataFrame) -> DataFrame:
    """Rename the columns of a source table to the names used here; others stay."""
    return df.withColumnsRenamed({old: new for old, new in SOURCE_NAMES.items() if old in df.columns})


@dataclass(frozen=True)
class FeatureSet:
    layers: Sequence[Layer]
    dropped: Sequence[str] = ()

    @property
    def names(self) -> list[str]:
        return [name for layer in self.layers for name in layer]

    def apply(self, df: DataFrame) -> DataFrame:
        for layer in self.layers:
            df = df.withColumns(dict(layer))
        return df.drop(*self.dropped)


def _c(name: str) -> Column:
    return F.col(name)


def _baths() -> Column:
    return (
        _c("full_baths") + 0.5 * _c("half_baths") + _c("basement_full_baths") + 0.5 * _c("basement_half_baths")
    )


def _building() -> Column:
    return _c("ground_area") + _c("upper_area")


def _total_area() -> Column:
    return _c("basement_area") + _c("ground_area") + _c("upper_area")


def _fenced() -> Column:
    return differs_flag(_c("fence"), "None")


def _cooled() -> Column:
    return equals_flag(_c("central_ac"), "Y")


def core_features() -> FeatureSet:
    """Aggregated areas, baths, scores and ages; the summed inputs go."""
    age = _c("year_sold") - _c("year_built")
    since = at_least_zero(_c("year_sold") - _c("year_remodel"))
    return FeatureSet(
        layers=(
            {
                "total_outdoor_area": sum_or_zero(
                    _c("terrace_area"), _c("open_veranda_area"), _c("enclosed_veranda_area"), _c("screen_porch_area")
                ),
                "total_baths": F.coalesce(_baths(), F.lit(0.0)),
                "overall_score": (_c("overall_quality") + _c("overall_condition")) / 2,
                "age": age,
                "years_since_remodel": update_where(_c("year_remodel") == _c("year_built"), age, since),
                "quality_x_ground": _c("overall_quality") * _c("ground_area"),
            },
            {
                "total_area": sum_or_zero(
                    _c("ground_area"), _c("upper_area"), _c("parking_area"), _c("total_outdoor_area")
                ),
            },
        ),
        dropped=CORE_INPUTS_DROPPED,
    )


def few_features() -> FeatureSet:
    """Eight features."""
    return FeatureSet(
        layers=(
            {
                "total_area": _total_area(),
                "total_baths": _baths(),
                "avg_room_size": safe_ratio(_c("usable_area"), _c("total_rooms")),
                "has_pool": positive_flag(_c("pool_area")),
                "has_terrace": positive_flag(_c("terrace_area")),
                "property_age": _c("year_sold") - _c("year_built"),
                "years_since_renovation": _c("year_sold") - _c("year_remodel"),
            },
            {"amenities_count": _c("has_pool") + _c("has_terrace") + _cooled()},
        )
    )


def compact_features() -> FeatureSet:
    """Five features."""
    amenities = (
        positive_flag(_c("pool_area"))
        + _fenced()
        + positive_flag(_c("terrace_area"))
        + positive_flag(_c("parking_area"))
        + _cooled()
    )
    return FeatureSet(
        layers=(
            {
                "total_area": _total_area(),
                "total_baths": _baths(),
                "avg_room_size": safe_ratio(_c("usable_area"), _c("total_rooms")),
                "guest_room_ratio": safe_ratio(_c("guest_rooms"), _c("total_rooms")),
                "amenities_count": amenities,
            },
        )
    )


def _shared_base() -> dict[str, Column]:
    """First layer of the two large sets: needs table columns only."""
    return {
        "total_area": _total_area(),
        "land_to_building_ratio": safe_ratio(_c("land_area"), _building()),
        "low_quality_area_ratio": safe_ratio(_c("low_quality_area"), _c("usable_area")),
        "pool_to_land_ratio": safe_ratio(_c("pool_area"), _c("land_area")),
        "total_baths": _baths(),
        "avg_room_size": safe_ratio(_c("usable_area"), _c("total_rooms")),
        "guest_room_ratio": safe_ratio(_c("guest_rooms"), _c("total_rooms")),
        "rooms_with_kitchens": _c("total_rooms") + _c("kitchens"),
        "parking_per_room": safe_ratio(_c("parking_capacity"), _c("total_rooms")),
        "parking_area_per_car": safe_ratio(_c("parking_area"), _c("parking_capacity")),
        "property_age": _c("year_sold") - _c("year_built"),
        "years_since_renovation": _c("year_sold") - _c("year_remodel"),
        "season_sold": season(_c("month_sold")),
        "exterior_ratio": safe_ratio(_c("facade_area"), _building()),
        "road_access_per_land": safe_ratio(_c("road_access_length"), _c("land_area")),
        "has_basement": positive_flag(_c("basement_area")),
        "has_pool": positive_flag(_c("pool_area")),
        "has_extra_facility": positive_flag(_c("extra_value")),
        "has_second_basement_facility": present_flag(_c("basement_type2")),
        "has_enclosed_veranda": positive_flag(_c("enclosed_veranda_area")),
        "has_terrace": positive_flag(_c("terrace_area")),
        "total_facilities": _c("basement_area") + _c("guest_rooms") + _c("lounges") + _c("kitchens"),
        "basement_facilities_area": _c("basement_area1") + _c("basement_area2"),
    }


def _shared_next() -> dict[str, Column]:
    """Second layer of the two large sets: needs the first."""
    return {
        "basement_to_total": safe_ratio(_c("basement_area"), _c("total_area")),
        "usable_area_per_room": safe_ratio(_c("usable_area"), _c("rooms_with_kitchens")),
        "bathrooms_per_room": safe_ratio(_c("total_baths"), _c("total_rooms")),
        "age_since_renovation": at_least_zero(_c("years_since_renovation")),
        "amenities_count": _c("has_pool")
        + _fenced()
        + _c("has_terrace")
        + positive_flag(_c("parking_area"))
        + _cooled(),
        "area_per_facility": safe_ratio(_c("usable_area"), _c("total_facilities")),
    }


def wide_features() -> FeatureSet:
    """Thirty features."""
    base = _shared_base() | {
        "basement_unfinished_ratio": safe_ratio(_c("basement_unfinished_area"), _c("basement_area"))
    }
    return FeatureSet(layers=(base, _shared_next()))


def full_features() -> FeatureSet:
    """Thirty-nine features."""
    base = _shared_base() | {
        "kitchens_per_room": safe_ratio(_c("kitchens"), _c("total_rooms")),
        "road_access_per_room": safe_ratio(_c("road_access_length"), _c("total_rooms")),
        "parking_to_facade": safe_ratio(_c("parking_area"), _c("facade_area")),
    }
    following = _shared_next() | {
        "total_area_per_room": safe_ratio(_c("total_area"), _c("total_rooms")),
        "bathrooms_per_kitchen": safe_ratio(_c("total_baths"), _c("kitchens")),
        "age_per_room": safe_ratio(_c("property_age"), _c("total_rooms")),
        "renovation_ratio": safe_ratio(_c("years_since_renovation"), _c("property_age")),
        "facade_per_total_area": safe_ratio(_c("facade_area"), _c("total_area")),
        "has_any_facility": any_flag(
            _c("has_pool"), _c("has_terrace"), _c("has_basement"), _c("has_extra_facility")
        ),
    }
    last = {"luxury_features_count": _c("amenities_count") + _c("guest_rooms") + _c("lounges")}
    return FeatureSet(layers=(base, following, last))


FEATURE_SETS = {
    "core": core_features,
    "few": few_features,
    "compact": compact_features,
    "wide": wide_features,
    "full": full_features,
}
