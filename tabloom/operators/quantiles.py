"""Exact quantiles with linear interpolation, at any table size.

Spark's ``percentile`` is exact, but keeps every distinct value of all columns in
one task.  Here a column is narrowed down around each wanted rank:

* one pass folds the values into small weighted samples, merged like the digits
  of a binary counter, and a sample gives two values between which the rank very
  probably lies;
* the next pass counts exactly what lies below, between and above them, and where
  little is expected between, the values in between come along, counted by
  value, into one task per rank, which reads the rank off.

What a pass finds is exact, so a rank that lies elsewhere, or among too many
values, is looked for again in the part it is known to lie in.  All columns share
every pass; two passes do for most tables, and more for larger ones, each
leaving about a fiftieth of the values.  Only counts and the wanted values reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import MERGE_WAYS

DIRECT_VALUES = 50_000  # values of a column that one task puts in order
SLICES = 1000  # values in a sample
CHUNK = 65_536  # values that a task samples at once
SAMPLE_SCHEMA = "k int, way int, n bigint, value binary, weight binary"
PART_SCHEMA = "k int, value double, below bigint, n bigint"
RANK_SCHEMA = "k int, below bigint, inside bigint, rank bigint, value double"


def number(column: str) -> Column:
    """The column as a double, with NaN as null."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def exact_quantiles(
    df: DataFrame,
    probabilities: Mapping[str, Sequence[float]],
    direct_values: int = DIRECT_VALUES,
    slices: int = SLICES,
) -> dict[str, list[float | None]]:
    """The wanted quantiles of each column, null and NaN left out.

    ``probabilities`` maps a column to its probabilities.  ``direct_values`` is how many values one task puts
    in order, ``slices`` the size of a sample.
    """
    wanted = {c: [float(p) for p in ps] for c, ps in probabilities.items() if len(ps)}
    if not wanted:
        return {}
    samples = _samples(df, [Part(c, -math.inf, math.inf, 0, 0, ()) for c in wanted], slices)
    counts = {c: s.n for c, s in zip(wanted, samples, strict=True)}
    waiting = []
    for (c, ps), sample in zip(wanted.items(), samples, strict=True):
        ranks = {r for p in ps for r in _ranks(p, counts[c])}
        if ranks:
            waiting.append((Part(c, -math.inf, math.inf, 0, counts[c], tuple(sorted(ranks))), sample))
    found: dict[tuple[str, int], float] = {}
    while waiting:
        brackets = [b for part, sample in waiting for b in _brackets(part, sample, direct_values, slices)]
        parts = _looked_up(df, brackets, found)
        waiting = list(zip(parts, _samples(df, parts, slices), strict=True)) if parts else []
    return {c: [_interpolate(found, c, p, counts[c]) for p in ps] for c, ps in wanted.items()}


def _ranks(p: float, n: int) -> set[int]:
    if n == 0:
        return set()
    position = p * (n - 1)
    return {math.floor(position), math.ceil(position)}


def _interpolate(found: Mapping[tuple[str, int], float], column: str, p: float, n: int) -> float | None:
    if n == 0:
        return None
    position = p * (n - 1)
    lower, upper = math.floor(position), math.ceil(position)
    a, b = found[column, lower], found[column, upper]
    return a if lower == upper else (upper - position) * a + (position - lower) * b


@dataclass(frozen=True)
class Part:
    """The values of a column from ``low`` to ``high``, how many there are and lie below, and the ranks wanted from them."""

    column: str
    low: float
    high: float
    below: int
    size: int
    ranks: tuple[int, ...]

    def pick(self, x: np.ndarray) -> np.ndarray:
        return x[(x >= self.low) & (x <= self.high)]


@dataclass(frozen=True)
class Sample:
    """Values in ascending order with weights that add up to ``n``."""

    n: int
    value: np.ndarray
    weight: np.ndarray

    def thinned(self, size: int) -> Sample:
        """At most ``size`` values, evenly spaced by weight."""
        if len(self.value) <= size:
            return self
        at = np.searchsorted(self.weight.cumsum(), (np.arange(size) + 0.5) * (self.n / size))
        return Sample(self.n, self.value[np.minimum(at, len(self.value) - 1)], np.full(size, self.n / size))

    def plus(self, other: Sample) -> Sample:
        value, weight = np.concatenate([self.value, other.value]), np.concatenate([self.weight, other.weight])
        order = np.argsort(value, kind="stable")
        return Sample(self.n + other.n, value[order], weight[order])


NOTHING = Sample(0, np.empty(0), np.empty(0))


def _samples(df: DataFrame, parts: Sequence[Part], slices: int) -> list[Sample]:
    """A sample of the values of each part, with their exact number."""
    size = 2 * slices
    columns, at = _columns(parts)

    def fold(batches):
        levels: list[dict[int, Sample]] = [{} for _ in parts]  # as in a binary counter: one sample per power of two
        held: list[list[np.ndarray]] = [[] for _ in parts]

        def carry(k: int) -> None:
            value = np.sort(np.concatenate(held[k]))
            held[k] = []
            sample, level = Sample(len(value), value, np.ones(len(value))).thinned(size), 0
            while level in levels[k]:
                sample = sample.plus(levels[k].pop(level)).thinned(size)
                level += 1
            levels[k][level] = sample

        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
            for k, part in enumerate(parts):
                held[k].append(part.pick(x[at[part.column]]))
                if sum(map(len, held[k])) >= CHUNK:
                    carry(k)
        for k in range(len(parts)):
            if held[k]:
                carry(k)
        yield _sample_batch([(k, reduce(Sample.plus, own.values(), NOTHING).thinned(size)) for k, own in enumerate(levels)])

    def merge(group: pa.Table) -> pa.Table:
        rows = zip(group.column("n").to_pylist(), group.column("value").to_pylist(), group.column("weight").to_pylist())
        total = reduce(Sample.plus, (Sample(n, np.frombuffer(v), np.frombuffer(w)) for n, v, w in rows), NOTHING)
        return pa.Table.from_batches([_sample_batch([(group.column("k")[0].as_py(), total.thinned(size))])])

    way = F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)).cast("int")
    partial = df.select(*[number(c).alias(c) for c in columns]).mapInArrow(fold, SAMPLE_SCHEMA).withColumn("way", way)
    some = partial.groupBy("k", "way").applyInArrow(merge, SAMPLE_SCHEMA)
    result = [NOTHING] * len(parts)
    for row in some.groupBy("k").applyInArrow(merge, SAMPLE_SCHEMA).collect():  # one row per part
        result[row["k"]] = Sample(row["n"], np.frombuffer(row["value"]), np.frombuffer(row["weight"]))
    return result


def _columns(parts: Sequence[Part]) -> tuple[list[str], dict[str, int]]:
    columns = sorted({p.column for p in parts})
    return columns, {c: i for i, c in enumerate(columns)}


def _sample_batch(rows: Sequence[tuple[int, Sample]]) -> pa.RecordBatch:
    columns = [
        pa.array([k for k, _ in rows], pa.int32()),
        pa.array([0] * len(rows), pa.int32()),
        pa.array([s.n for _, s in rows], pa.int64()),
        pa.array([s.value.tobytes() for _, s in rows], pa.binary()),
        pa.array([s.weight.tobytes() for _, s in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["k", "way", "n", "value", "weight"])


@dataclass(frozen=True)
class Bracket:
    """Two values between which ranks of a part are expected, and whether the values between them come along."""

    part: Part
    low: float
    high: float
    ranks: tuple[int, ...]
    listed: bool


def _brackets(part: Part, sample: Sample, direct_values: int, slices: int) -> list[Bracket]:
    if part.size <= direct_values:
        return [Bracket(part, part.low, part.high, part.ranks, True)]
    upto = sample.weight.cumsum()
    margin = part.size * (0.002 + 4.0 / slices) + 1.0
    ends: dict[tuple[float, float], list[int]] = {}
    for rank in part.ranks:
        place = rank - part.below
        first = int(np.searchsorted(upto, place - margin)) - 1
        last = int(np.searchsorted(upto, place + margin)) + 1
        low = float(sample.value[first]) if first >= 0 else part.low
        high = float(sample.value[last]) if last < len(upto) else part.high
        if (low, high) == (part.low, part.high):  # too coarse to narrow it down: part it at one value
            low = high = float(sample.value[min(int(np.searchsorted(upto, place)), len(upto) - 1)])
        ends.setdefault((low, high), []).append(rank)
    result = []
    for (low, high), ranks in ends.items():
        expected = sample.weight[(sample.value >= low) & (sample.value <= high)].sum()
        result.append(Bracket(part, low, high, tuple(ranks), low < high and expected <= direct_values))
    return result


def _looked_up(df: DataFrame, brackets: Sequence[Bracket], found: dict[tuple[str, int], float]) -> list[Part]:
    """Note the values of the ranks that lie in their brackets; the parts to look in for the others."""
    brackets = list(brackets)
    columns, at = _columns([b.part for b in brackets])

    def fold(batches):
        below, inside = np.zeros(len(brackets), dtype=np.int64), np.zeros(len(brackets), dtype=np.int64)
        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]
            ks, values, counts = [], [], []
            for k, b in enumerate(brackets):
                own = b.part.pick(x[at[b.part.column]])
                between = own[(own >= b.low) & (own <= b.high)]
                below[k] += np.count_nonzero(own < b.low)
                inside[k] += len(between)
                if b.listed and len(between):
                    value, n = np.unique(between, return_counts=True)
                    ks.append(np.full(len(value), k, dtype=np.int32))
                    values.append(value)
                    counts.append(n)
            if ks:
                n = np.concatenate(counts)
                columns_ = [np.concatenate(ks), np.concatenate(values), np.zeros(len(n), dtype=np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns_], names=["k", "value", "below", "n"])
        none = pa.nulls(len(brackets), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(brackets)), pa.int32()), none, pa.array(below), pa.array(inside)], names=["k", "value", "below", "n"]
        )

    def read_off(group: pa.Table) -> pa.Table:
        k = group.column("k")[0].as_py()
        b = brackets[k]
        value, below, n = (group.column(c).to_numpy() for c in ("value", "below", "n"))
        counts = np.isnan(value)
        before, inside = b.part.below + int(below[counts].sum()), int(n[counts].sum())
        order = np.argsort(value[~counts], kind="stable")
        value, upto = value[~counts][order], n[~counts][order].cumsum()
        read = []
        for rank in b.ranks:
            known = before <= rank < before + inside and (b.listed or b.low == b.high)
            hit = b.low if not b.listed else value[np.searchsorted(upto, rank - before, side="right")] if known else None
            read.append(float(hit) if known else None)
        size = len(read)
        columns_ = [pa.array([v] * size, t) for v, t in ((k, pa.int32()), (before, pa.int64()), (inside, pa.int64()))]
        columns_ += [pa.array(b.ranks, pa.int64()), pa.array(read, pa.float64())]
        return pa.table(columns_, names=["k", "below", "inside", "rank", "value"])

    numbers = df.select(*[number(c).alias(c) for c in columns]).mapInArrow(fold, PART_SCHEMA)
    left: dict[Part, list[int]] = {}
    for row in numbers.groupBy("k").applyInArrow(read_off, RANK_SCHEMA).collect():  # one row per rank
        b = brackets[row["k"]]
        part, rank, below, upto = b.part, row["rank"], row["below"], row["below"] + row["inside"]
        if row["value"] is not None:
            found[part.column, rank] = row["value"]
        elif rank < below:
            low = Part(part.column, part.low, float(np.nextafter(b.low, -math.inf)), part.below, below - part.below, ())
            left.setdefault(low, []).append(rank)
        elif rank >= upto:
            high = Part(part.column, float(np.nextafter(b.high, math.inf)), part.high, upto, part.below + part.size - upto, ())
            left.setdefault(high, []).append(rank)
        else:
            left.setdefault(Part(part.column, b.low, b.high, below, upto - below, ()), []).append(rank)
    return [Part(p.column, p.low, p.high, p.below, p.size, tuple(sorted(ranks))) for p, ranks in left.items()]
