"""Registered queries: a Spark plan each, with an equivalent SQL text where there is one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.fixture import PROPERTY_SQL

Query = Callable[[SparkSession, str], DataFrame]

STRINGS = [
    "kitchen_quality", "zone", "road_type", "fence", "central_ac", "basement_type2", "basement_height",
    "exterior_quality",
]
NUMBERS = [
    "year_sold", "month_sold", "year_built", "year_remodel", "overall_quality", "overall_condition", "land_area",
    "ground_area", "upper_area", "basement_area", "terrace_area", "pool_area", "total_rooms", "full_baths",
    "half_baths", "usable_area", "low_quality_area", "basement_unfinished_area", "basement_area1",
    "basement_area2", "open_veranda_area", "enclosed_veranda_area", "screen_porch_area", "parking_area",
    "parking_capacity", "parking_year", "facade_area", "road_access_length", "extra_value", "basement_full_baths",
    "basement_half_baths", "guest_rooms", "kitchens", "lounges", "property_class", "target",
]
COLUMNS = [
    "row_id", "year_sold", "month_sold", "year_built", "year_remodel", "overall_quality", "overall_condition",
    "land_area", "ground_area", "upper_area", "basement_area", "terrace_area", "pool_area", "total_rooms",
    "full_baths", "half_baths", "kitchen_quality", "zone", "road_type", "fence", "central_ac", "usable_area",
    "low_quality_area", "basement_unfinished_area", "basement_area1", "basement_area2", "open_veranda_area",
    "enclosed_veranda_area", "screen_porch_area", "parking_area", "parking_capacity", "parking_year",
    "facade_area", "road_access_length", "extra_value", "basement_full_baths", "basement_half_baths",
    "guest_rooms", "kitchens", "lounges", "basement_type2", "basement_height", "exterior_quality",
    "property_class", "target",
]

HASH_SQL = "CAST(concat('0x', substr(md5(CAST(row_id AS VARCHAR)), 1, 8)) AS BIGINT)"
HOLDOUT_SQL = f"({HASH_SQL} % 10000 < 2000)"


@dataclass
class Catalog:
    runs: dict[str, Query] = field(default_factory=dict)
    checks: dict[str, str | Callable[[], str]] = field(default_factory=dict)

    def add(self, name: str, run: Query, sql: str | Callable[[], str] | None = None) -> None:
        """``sql`` may be a function where its text needs a session to be made."""
        if name in self.runs:
            raise ValueError(f"{name} is registered twice")
        self.runs[name] = run
        if sql is not None:
            self.checks[name] = sql


def with_property(body: str, *ctes: str) -> str:
    """``body`` as a SQL query that sees the property table as ``prop``."""
    parts = [f"prop AS ({PROPERTY_SQL.strip()})", *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def union_all(rows: Sequence[str]) -> str:
    return "\nUNION ALL ".join(rows)


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """The frame with its double columns (or the named ones) rounded."""
    pick = set(names) if names else {n for n, t in df.dtypes if t == "double"}
    return df.select(*[_round(n, digits) if n in pick else F.col(n) for n in df.columns])


def _round(name: str, digits: int) -> Column:
    return F.round(F.col(name), digits).alias(name)
