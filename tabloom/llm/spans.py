"""Spans in texts: their order, digest and text form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<kind:int,start:int,end:int>>"


def joined(spans: Column, kinds: Sequence[str], by_start: bool) -> Column:
    """``kind:start:end`` of each span, comma-joined: by kind and start, or by start and kind."""
    first, second = ("start", "kind") if by_start else ("kind", "start")
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x[first], x[second], x["end"], x["kind"].alias("k"), x["start"].alias("s"))))
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def overlaps(start: int, end: int, spans: Sequence[tuple[int, int, int]]) -> bool:
    return any(start < e and s < end for _, s, e in spans)
