"""Column roles, taken from the schema alone (no job runs here)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def detect_target(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column of ``df``."""
    present = set(df.columns)
    return next((name for name in candidates if name in present), None)


def first_columns(names: Sequence[str], n: int = 5) -> list[str]:
    """The first ``n`` column names, for reports that look at a few columns only."""
    return list(names[:n])


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in a fit."""

    id: str
    target: str
    numeric: tuple[str, ...]
    nominal: tuple[str, ...]
    ordinal: dict[str, dict[str, int]] = field(default_factory=dict)

    @classmethod
    def from_schema(
        cls,
        df: DataFrame,
        id: str = "row_id",
        target: str = "target",
        ordinal: dict[str, dict[str, int]] | None = None,
    ) -> Roles:
        """Strings in ``ordinal`` are graded, other strings nominal, numbers numeric.

        ``ordinal`` may name columns that are absent; a numeric column stays
        numeric even if it is named there.
        """
        strings = string_columns(df, (id, target))
        graded = {c: m for c, m in (ordinal or {}).items() if c in strings}
        return cls(
            id=id,
            target=target,
            numeric=tuple(numeric_columns(df, (id, target))),
            nominal=tuple(c for c in strings if c not in graded),
            ordinal=graded,
        )
