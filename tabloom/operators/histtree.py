"""Regression trees grown from distributed histograms, any number of them at once.

Feature values are cut into bins once, of a byte each or of two where more than
255 are asked for.  The binned rows lie in blocks, many in a row of the table: a pass
hands a task bytes as they are, not rows one by one.  A growing step is one Spark job for
all trees that grow together (folds, settings, members of a forest):

* every task routes its rows down each unfinished tree and sums gradients into
  one array per (tree, node, feature);
* one shuffle brings the arrays of a (tree, node, feature) together, where they
  are added up element by element.  Only the smaller child of a split is summed
  from rows; the other is its parent's array minus this one, and the parent's
  array comes through the same shuffle;
* the best split of the feature is found right there, so the driver receives one
  short row per (node, feature) and never an array.

What is shuffled depends on nodes, features and bins, not on the number of rows,
and a node that holds most rows costs no more than an empty one.  The arrays of a
task stay within ``HISTOGRAM_BYTES``; more nodes than that are done in several passes.

Deep trees have many nodes with few rows.  A task may say from how many rows on
a node is worth an array in every task; the rows of a smaller node come together
in one task, which grows the rest of the tree below it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.splits import row_hash
from tabloom.operators.quantiles import number
from tabloom.session import release, write_and_reread

BINNED_SCHEMA = "bins binary, y binary, state binary, u binary, fold binary"  # a block of rows in each
ROW_SCHEMA = "bins binary, y double, state binary, u bigint, fold int"
HISTOGRAM_SCHEMA = "tree int, grp int, feature int, node int, kind int, data binary"
SPLIT_SCHEMA = (
    "tree int, node int, feature int, data binary, gain double, bin int, missing_left boolean, subset binary, "
    "g double, h double, n double, g_left double, h_left double, n_left double"
)
HISTOGRAM_BYTES = 64 << 20
BLOCK_BYTES = 256 << 10  # of a block: small enough for many of them in an Arrow batch or a row group
TRAIN, VALIDATION = 0, 1
ROWS, PARENT, FIT = 0, 1, 2  # kinds of histogram rows: summed from rows, a parent's, errors of the model so far
# Writer's settings for blocks: a task that reads holds a row group in the JVM, twice while its columns grow, and the
# writer measures only every hundred rows, which are 25 MB of blocks.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}
SEARCH_BYTES = 256 << 10  # what each task of the scan sends to a task of the split search
SKETCHES = 12  # of a task at a time: each takes about 7 MB of the heap
SENT_BYTES = 4 << 20  # of arrays in one Arrow batch
CHAIN = 3  # tables of arrays that are kept one on top of the other; the next one is written out
ROWS_AT_ONCE = 256  # rows that a task hands on together
TIE = 1e-11  # gains this close, relative to the node's score, count as equal


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    """Nodes in arrays; the children of a node are ``left`` and ``left + 1``.

    A row goes left where its bin is at most ``bin``, or, in a node with a
    ``subset``, where its bin is one of it.  A missing value (bin 0) goes left
    where ``missing_left`` says so.  ``feature`` is -1 in a leaf, whose output is ``value``.
    """

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    subset: list[tuple[int, ...]] = field(default_factory=lambda: [()])

    def split(self, node: int, feature: int, bin: int, missing_left: bool = True, subset: Sequence[int] = ()) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.bin[node], self.left[node] = feature, bin, first
        self.missing_left[node], self.subset[node] = missing_left, tuple(subset)
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(0.0)
            self.missing_left.append(True)
            self.subset.append(())
        return first, first + 1

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node each row of the bin matrix ends in."""
        feature, cut, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        missing_left = np.array(self.missing_left)
        chosen = [v for v, s in enumerate(self.subset) if s and feature[v] >= 0]
        place = np.full(len(feature), -1)
        place[chosen] = np.arange(len(chosen))
        member = np.zeros((len(chosen), 1 + max((max(self.subset[v]) for v in chosen), default=0)), dtype=bool)
        for i, v in enumerate(chosen):
            member[i, list(self.subset[v])] = True
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            f = feature[node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            if not len(rows):
                break
            at, value = node[rows], bins[rows, f]
            goes_left = np.where(value == 0, missing_left[at], value <= cut[at])
            if chosen:
                by_set = np.flatnonzero(place[at] >= 0)
                known = np.minimum(value[by_set], member.shape[1] - 1)
                goes_left[by_set] = member[place[at[by_set]], known] & (known == value[by_set])
            node[rows] = left[at] + ~goes_left
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.route(bins)]


# ---------------------------------------------------------------- bins


@dataclass(frozen=True)
class Binning:
    """How raw columns become bins.  Bin 0 is for missing values.

    A number is in bin k up to border k.  Level k of a category, the k-th most
    frequent, is in bin k; rarer and unseen levels share the last bin.  Levels are
    known by a 64-bit hash, at most ``max_bins`` per column, so no labels are kept.
    """

    columns: tuple[str, ...]
    borders: tuple[tuple[float, ...], ...]
    categories: tuple[str, ...] = ()
    levels: tuple[tuple[int, ...], ...] = ()

    @classmethod
    def fit(
        cls, df: DataFrame, columns: Sequence[str], max_bins: int = 64, accuracy: int = 10_000, categories: Sequence[str] = ()
    ) -> Binning:
        """Borders at evenly spaced quantiles: one bounded sketch per column, those of ``SKETCHES`` columns in a pass.

        A column with few distinct values gets a border at each of them.
        """
        if not 2 <= max_bins <= 65_535:
            raise ValueError("max_bins must lie between 2 and 65535")
        steps = [i / (max_bins - 1) for i in range(1, max_bins)]
        accuracy = max(accuracy, 4 * max_bins)
        borders = []
        for first in range(0, len(columns), SKETCHES):
            part = columns[first : first + SKETCHES]
            row = df.agg(
                *[F.approx_percentile(number(c), steps, accuracy).alias(f"q{i}") for i, c in enumerate(part)],
                *[F.max(number(c)).alias(f"m{i}") for i, c in enumerate(part)],
            ).first()
            for i in range(len(part)):
                found = sorted(set(row[f"q{i}"] or []))
                borders.append(tuple(b for b in found if b < row[f"m{i}"]))
        levels = _frequent_levels(df, categories, max_bins - 1) if categories else ()
        return cls(tuple(columns), tuple(borders), tuple(categories), levels)

    @property
    def sizes(self) -> list[int]:
        return [len(b) + 2 for b in self.borders] + [len(v) + 2 for v in self.levels]

    @property
    def width(self) -> int:
        return len(self.columns) + len(self.categories)

    def is_category(self, feature: int) -> bool:
        return feature >= len(self.columns)

    def inputs(self) -> list[Column]:
        """What `matrix` takes: numbers as doubles, categories as hashes of their text."""
        return [number(c) for c in self.columns] + [level_hash(c) for c in self.categories]

    def matrix(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Bin numbers of the input columns, one row per row; a missing category is masked or 0."""
        kind = np.uint8 if max(self.sizes, default=0) <= 256 else np.uint16
        result = np.empty((len(columns[0]) if columns else 0, self.width), dtype=kind)
        for i, border in enumerate(self.borders):
            found = np.searchsorted(np.array(border), columns[i], side="left") + 1
            result[:, i] = np.where(np.isnan(columns[i]), 0, found)
        for i, hashes in enumerate(self.levels, start=len(self.columns)):
            known = np.array(hashes, dtype=np.int64)
            order = np.argsort(known)
            at = np.minimum(np.searchsorted(known[order], columns[i]), max(len(known) - 1, 0))
            hit = known[order][at] == columns[i] if len(known) else np.zeros(len(columns[i]), dtype=bool)
            code = order[at] + 1 if len(known) else np.zeros(len(columns[i]), dtype=np.int64)
            result[:, i] = np.where(columns[i] == 0, 0, np.where(hit, code, len(known) + 1))
        return result


def level_hash(column: str) -> Column:
    """A non-zero hash of a category's text, 0 where it is missing."""
    hashed = F.xxhash64(F.col(column).cast("string"))
    return F.when(F.col(column).isNull(), F.lit(0)).when(hashed == 0, F.lit(1)).otherwise(hashed).cast("bigint")


def _frequent_levels(df: DataFrame, categories: Sequence[str], most: int) -> tuple[tuple[int, ...], ...]:
    """The hashes of the most frequent levels of each category, all counted in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), level_hash(c).alias("level")) for i, c in enumerate(categories)]))
    counts = df.select(pairs.alias("p")).filter("p.level <> 0").groupBy("p.c", "p.level").count()
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("count"), "level"))
    kept = counts.withColumn("place", place).filter(F.col("place") <= most)
    found: list[list[int]] = [[] for _ in categories]
    for row in kept.orderBy("c", "place").collect():
        found[row["c"]].append(row["level"])
    return tuple(tuple(v) for v in found)


def binned_table(
    df: DataFrame,
    binning: Binning,
    label: str,
    key: str,
    starts: Sequence[float],
    fold: Column | None = None,
    trees: Sequence[Sequence[Tree]] = (),
    blocks: bool = True,
) -> DataFrame:
    """The bins of the labelled rows as bytes, label, state (a number per model), key hash and fold, in blocks.

    A model's state begins at its start plus the outputs of ``trees`` it has already.  Without ``blocks``
    there is one row per labelled row, for `in_blocks` to put together.
    """
    source = df.filter(F.col(label).isNotNull()).select(
        *[c.alias(f"x{i}") for i, c in enumerate(binning.inputs())],
        F.col(label).cast("double").alias("y"),
        row_hash(key).alias("u"),
        (F.lit(TRAIN) if fold is None else F.coalesce(fold.cast("int"), F.lit(-1))).alias("fold"),
    )
    d, begin = binning.width, np.array(starts, dtype=np.float64)

    def encode(batches):
        for batch in batches:
            bins = binning.matrix([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)])
            state = np.tile(begin, (batch.num_rows, 1))
            for m, own in enumerate(trees):
                for tree in own:
                    state[:, m] += tree.predict(bins)
            y, u, folds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (d, d + 1, d + 2))
            made = Batch(bins, y, state, u, folds)
            yield made.blocks() if blocks else made.rows()

    return source.mapInArrow(encode, BINNED_SCHEMA if blocks else ROW_SCHEMA)


def in_blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows of a `binned_table` without blocks, in blocks of rows that follow each other."""

    def pack(batches):
        for arrow in batches:
            yield Batch.of_rows(arrow, width).blocks()

    return rows.mapInArrow(pack, BINNED_SCHEMA)


def encoded_row_bytes(width: int) -> int:
    """At most what a row that `binned_table` reads takes in an Arrow batch."""
    return 8 * width + 40


def bytes_column(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    fixed = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(d * matrix.itemsize), n, [None, pa.py_buffer(np.ascontiguousarray(matrix))]
    )
    return fixed.cast(pa.binary())


def _matrix_of(column: pa.Array, n: int) -> np.ndarray:
    """The bytes of the values of a binary column, one after the other."""
    kind = np.int32 if pa.types.is_binary(column.type) else np.int64
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1] if n else np.zeros(1, int)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if n else np.empty(0, np.uint8)


@dataclass
class Batch:
    """The rows of some blocks as numpy arrays; ``state`` has a column per model."""

    bins: np.ndarray
    y: np.ndarray
    state: np.ndarray
    u: np.ndarray
    fold: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, width: int) -> Batch:
        """The rows of all blocks of an Arrow batch."""
        y, u, fold = (_numbers_of(batch.column(i), kind) for i, kind in ((1, np.float64), (3, np.int64), (4, np.int32)))
        return cls._shaped(batch, width, y, u, fold)

    @classmethod
    def of_rows(cls, batch: pa.RecordBatch, width: int) -> Batch:
        """The rows of an Arrow batch of a table without blocks."""
        return cls._shaped(batch, width, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4)))

    @classmethod
    def _shaped(cls, batch: pa.RecordBatch, width: int, y: np.ndarray, u: np.ndarray, fold: np.ndarray) -> Batch:
        n, data = len(y), _matrix_of(batch.column(0), batch.num_rows)
        if len(data) > n * width:
            data = np.frombuffer(data.tobytes(), dtype=np.uint16)
        state = _numbers_of(batch.column(2), np.float64)
        return cls(data.reshape(n, width), y, state.reshape(n, -1 if n else 0), u, fold)

    def blocks(self) -> pa.RecordBatch:
        """The rows in blocks of at most ``BLOCK_BYTES``."""
        n = len(self.y)
        row_bytes = self.bins.itemsize * self.bins.shape[1] + 8 * self.state.shape[1] + 20
        edges = np.append(np.arange(0, n, max(1, BLOCK_BYTES // row_bytes)), n)
        parts = (self.bins, self.y.astype(np.float64), self.state, self.u.astype(np.int64), self.fold.astype(np.int32))
        columns = [_block_column(part, edges) for part in parts]
        return pa.RecordBatch.from_arrays(columns, names=["bins", "y", "state", "u", "fold"])

    def rows(self) -> pa.RecordBatch:
        columns = [bytes_column(self.bins), pa.array(self.y), bytes_column(self.state), pa.array(self.u), pa.array(self.fold)]
        return pa.RecordBatch.from_arrays(columns, names=["bins", "y", "state", "u", "fold"])


def _numbers_of(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers in a binary column, one value after the other; copied, as they need not lie at even addresses."""
    return np.frombuffer(_matrix_of(column, len(column)).tobytes(), dtype=kind)


def _block_column(part: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The rows between the edges, as bytes."""
    row_bytes = part.itemsize * int(np.prod(part.shape[1:]))
    offsets = (edges * row_bytes).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part))])


def with_state(table: DataFrame, width: int, change: Callable[[Batch], np.ndarray]) -> DataFrame:
    """The table with the state that ``change`` gives for a batch."""

    def update(batches):
        for arrow in batches:
            batch = Batch.of(arrow, width)
            batch.state = change(batch)
            yield batch.blocks()

    return table.mapInArrow(update, BINNED_SCHEMA)


def written_blocks(table: DataFrame, label: str) -> DataFrame:
    """Blocks written out, so that no executor loss costs more than a read.

    They are read where they lie.  In Spark's cache they would fill the heap that the tasks need.
    """
    return write_and_reread(table, label, **ROW_GROUPS)


def kept_blocks(table: DataFrame) -> DataFrame:
    """Blocks kept on the executors' disks until the next version is made of them."""
    return table.persist(StorageLevel.DISK_ONLY)


def uniform_draw(u: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1) per row, from its key hash, the seed and the step."""
    # Multipliers and shifts of the splitmix64 finaliser.
    with np.errstate(over="ignore"):
        z = u.astype(np.uint64) + np.uint64((seed * 1_000_003 + step + 1) % 2**32) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


# ---------------------------------------------------------------- split search


@dataclass(frozen=True)
class SplitRules:
    """What a split must satisfy and how it is scored.

    ``min_gain`` is compared with the whole gain (the scores of the sides minus
    that of the node; reported gains are half of that).  With ``prune_after``
    a split may gain less as long as a split below it makes up for it: subtrees
    without enough gain are folded back from the bottom.  ``learn_missing``
    scores missing values on both sides.  A category's levels are ordered by
    gradient over weight plus ``category_smooth`` and cut as a subset; levels
    with fewer than ``category_rows`` rows stay on the right, and
    ``category_l2`` is added to the penalty of such a split.
    """

    l2: float = 1.0
    l1: float = 0.0
    min_gain: float = 0.0
    min_weight: float = 0.0
    min_rows: int = 1
    min_split_rows: int = 2
    noise: float = 0.0
    seed: int = 42
    prune_after: bool = False
    learn_missing: bool = False
    category_smooth: float = 10.0
    category_rows: int = 1
    category_l2: float = 0.0

    def shrunk(self, g: np.ndarray) -> np.ndarray:
        return g if self.l1 == 0 else np.sign(g) * np.maximum(np.abs(g) - self.l1, 0.0)

    def score(self, g, h, extra: float = 0.0):
        weight = np.asarray(h) + self.l2 + extra
        s = self.shrunk(np.asarray(g))
        return np.where(weight > 0, s * s / np.where(weight > 0, weight, 1.0), 0.0)

    def leaf(self, g: float, h: float) -> float:
        """The output of a leaf with gradient sum g and weight sum h."""
        return 0.0 if h + self.l2 <= 0 else float(-self.shrunk(np.float64(g)) / (h + self.l2))


@dataclass(frozen=True)
class Split:
    """Best split of a node, with the sums of the node and of its left side."""

    node: int
    gain: float
    feature: int
    bin: int
    g: float
    h: float
    n: float
    g_left: float
    h_left: float
    n_left: float
    missing_left: bool = True
    subset: tuple[int, ...] = ()


def _gains(total: np.ndarray, left: np.ndarray, rules: SplitRules, row_rules: bool, extra: float = 0.0) -> np.ndarray:
    """Half the gain of each candidate whose left sums are the columns of ``left``; -inf where a rule is broken."""
    g, h, n = total
    gl, hl, nl = left
    gain = 0.5 * (rules.score(gl, hl, extra) + rules.score(g - gl, h - hl, extra) - rules.score(g, h))
    if row_rules:
        broken = (nl < rules.min_rows) | (n - nl < rules.min_rows) | (hl < rules.min_weight) | (h - hl < rules.min_weight)
        gain = np.where(broken | (n < rules.min_split_rows), -np.inf, gain)
    return gain


def candidates_of(hist: np.ndarray, rules: SplitRules, category: bool, row_rules: bool = True):
    """All splits of a node on one feature: (gains, left sums, bins, missing_left, subsets or None).

    ``hist`` holds gradient, weight and rows per bin.
    """
    total = hist.sum(axis=1)
    if category:
        return _subset_candidates(hist, total, rules)
    left = hist.cumsum(axis=1)[:, :-1]
    bins, toward = np.arange(left.shape[1]), np.ones(left.shape[1], dtype=bool)
    if rules.learn_missing and hist[2, 0] > 0 and left.shape[1] > 1:
        left = np.concatenate([left, left[:, 1:] - hist[:, :1]], axis=1)
        toward = np.concatenate([toward, np.zeros(len(bins) - 1, dtype=bool)])
        bins = np.concatenate([bins, bins[1:]])
    return _gains(total, left, rules, row_rules), left, bins, toward, None


def _subset_candidates(hist: np.ndarray, total: np.ndarray, rules: SplitRules):
    """Levels in the order of their gradient ratio, cut everywhere, from both ends."""
    movable = np.flatnonzero(hist[2, 1:-1] >= max(rules.category_rows, 1)) + 1  # missing, rare and unseen stay right
    ratio = hist[0, movable] / (hist[1, movable] + rules.category_smooth)
    order = movable[np.argsort(ratio, kind="stable")]
    ends = [order, order[::-1]]
    lefts = [hist[:, e].cumsum(axis=1) for e in ends]
    left = np.concatenate(lefts, axis=1)
    subsets = [tuple(sorted(int(v) for v in e[: k + 1])) for e in ends for k in range(len(e))]
    gains = _gains(total, left, rules, True, rules.category_l2)
    gains = np.where(left[2] < total[2], gains, -np.inf)
    return gains, left, np.zeros(len(subsets), dtype=int), np.zeros(len(subsets), dtype=bool), subsets


def _first_best(gains: np.ndarray, scale: float) -> int:
    best = gains.max()
    return int(np.argmax(gains >= best - TIE * (abs(scale) + abs(best)))) if np.isfinite(best) else int(np.argmax(gains))


def _noise(rules: SplitRules, step: int, feature: int, bins: int) -> np.ndarray:
    return rules.noise * np.random.default_rng([rules.seed, step, feature]).normal(size=bins)


Gradients = Callable[[Batch, np.ndarray], tuple[np.ndarray, np.ndarray | None, np.ndarray]]


@dataclass(frozen=True)
class Growth:
    """Shape of a tree.

    ``level`` splits every node of a level on its own, ``symmetric`` all of them
    on one (feature, bin), and ``leaf`` the leaf with the largest gain until
    ``max_leaves`` are there.
    """

    mode: str = "level"
    max_depth: int = 6
    max_leaves: int = 31

    def __post_init__(self):
        if self.mode not in ("level", "symmetric", "leaf"):
            raise ValueError(f"unknown growth mode {self.mode}")


@dataclass(frozen=True)
class TreeTask:
    """One tree to grow.

    ``gradients`` gives gradient, weight (None for ones) and residual of the rows
    of a batch, from the batch and the state of model ``model``.  Rows of fold ``held``
    take no part; they are the validation rows.
    """

    growth: Growth
    rules: SplitRules
    gradients: Gradients
    features: tuple[int, ...]
    model: int = 0
    held: int | None = None
    step: int = 0
    local_rows: int = 0  # nodes with at most so many rows are finished in one task each; for ``level`` growth


@dataclass(frozen=True)
class Pair:
    """A child to sum from rows, its sibling and their parent; -1 for the root's."""

    built: int
    sibling: int = -1
    parent: int = -1


def histogram(
    table: DataFrame,
    binning: Binning,
    tasks: Sequence[TreeTask],
    trees: Sequence[Tree],
    wanted: Sequence[Sequence[Pair]],
    with_fit: bool = False,
) -> DataFrame:
    """One array per input split and (tree, node, feature), of gradients, weights and rows per bin.

    With ``with_fit``, one more row per tree carries the squared residuals and row
    counts of training and validation rows.  Nodes without a row of the split are left out.
    """
    width, sizes = binning.width, binning.sizes
    tasks, trees, wanted = list(tasks), list(trees), [list(w) for w in wanted]
    slots = []
    for tree, pairs in zip(trees, wanted, strict=True):
        slot = np.full(len(tree.feature), -1)
        slot[[p.built for p in pairs]] = np.arange(len(pairs))
        slots.append(slot)

    def fold(batches):
        sums = [{f: np.zeros((3, len(w) * sizes[f])) for f in t.features} for t, w in zip(tasks, wanted, strict=True)]
        fit = np.zeros((len(tasks), 4))
        for arrow in batches:
            batch = Batch.of(arrow, width)
            for i, task in enumerate(tasks):
                g, h, residual = task.gradients(batch, batch.state[:, task.model])
                held = batch.fold == (-2 if task.held is None else task.held)
                if with_fit:
                    for part, of in ((0, ~held), (2, held)):
                        fit[i, part : part + 2] += (np.dot(residual[of], residual[of]), of.sum())
                if not wanted[i]:
                    continue
                slot = slots[i][trees[i].route(batch.bins)]
                pick = np.flatnonzero((slot >= 0) & ~held if h is None else (slot >= 0) & ~held & (h > 0))
                if not len(pick):
                    continue
                base, g = slot[pick], g[pick]
                h = None if h is None else h[pick]
                bins = np.ascontiguousarray(batch.bins[pick].T)  # a feature's bins side by side
                at = np.empty(len(pick), dtype=np.int64)
                for f, into in sums[i].items():
                    np.multiply(base, sizes[f], out=at)
                    at += bins[f]
                    rows = np.bincount(at, minlength=into.shape[1])
                    into[0] += np.bincount(at, weights=g, minlength=into.shape[1])
                    into[1] += rows if h is None else np.bincount(at, weights=h, minlength=into.shape[1])
                    into[2] += rows
        rows, held = [], 0
        for i, task in enumerate(tasks):
            shared = task.growth.mode == "symmetric"
            for f, into in sums[i].items():
                for pair, of in zip(wanted[i], into.reshape(3, len(wanted[i]), sizes[f]).transpose(1, 0, 2), strict=True):
                    if of[2].any():
                        rows.append((i, 0 if shared else pair.parent, f, pair.built, ROWS, of.tobytes()))
                        held += of.nbytes
                        if held >= SENT_BYTES:
                            yield _histogram_batch(rows)
                            rows, held = [], 0
            if with_fit:
                rows.append((i, -2, -1, -1, FIT, fit[i].tobytes()))
        yield _histogram_batch(rows)

    return table.mapInArrow(fold, HISTOGRAM_SCHEMA)


def _histogram_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int32()] * 5 + [pa.binary()]
    names = ["tree", "grp", "feature", "node", "kind", "data"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def candidate_splits(table: DataFrame, binning: Binning, task: TreeTask) -> DataFrame:
    """Every split of the root with its gain and sums: (feature, bin, missing_left, gain, g_left, h_left, n_left)."""
    sizes, rules = binning.sizes, task.rules
    category = [binning.is_category(f) for f in range(binning.width)]

    def listed(group: pa.Table) -> pa.Table:
        f = group.column("feature")[0].as_py()
        hist = _summed(group.column("data").combine_chunks()).reshape(3, sizes[f])
        gains, left, bins, toward, _ = candidates_of(hist, rules, category[f])
        columns = [pa.array(np.full(len(gains), f, dtype=np.int32)), pa.array(bins.astype(np.int32)), pa.array(toward), pa.array(gains)]
        names = ["feature", "bin", "missing_left", "gain", "g_left", "h_left", "n_left"]
        return pa.table(columns + [pa.array(v) for v in left], names=names)

    schema = "feature int, bin int, missing_left boolean, gain double, g_left double, h_left double, n_left double"
    return histogram(table, binning, [task], [Tree()], [[Pair(0)]]).groupBy("feature").applyInArrow(listed, schema)


def _summed(data: pa.Array) -> np.ndarray:
    """The element-wise sum of arrays of doubles."""
    return np.frombuffer(_matrix_of(data, len(data)).tobytes(), dtype=np.float64).reshape(len(data), -1).sum(axis=0)


def _splits(
    rows: DataFrame, binning: Binning, tasks: Sequence[TreeTask], wanted: Sequence[Sequence[Pair]], keep: Sequence[bool]
) -> DataFrame:
    """Sums, siblings and the best split of each (tree, node, feature), in one shuffle."""
    sizes = binning.sizes
    category = [binning.is_category(f) for f in range(binning.width)]
    tasks, keep = list(tasks), list(keep)
    pairs: dict[tuple[int, int], list[Pair]] = {}
    for i, own in enumerate(wanted):
        for pair in own:
            pairs.setdefault((i, 0 if tasks[i].growth.mode == "symmetric" else pair.parent), []).append(pair)

    def best(i: int, grp: int, f: int, sums: dict[tuple[int, int], np.ndarray]) -> list[tuple]:
        """The rows of one (tree, group of nodes, feature) from its sums by (kind, node)."""
        if f < 0:
            return _fit_rows(i, sums[FIT, -1])
        task = tasks[i]
        hists = _children(sums, pairs[i, grp], sizes[f])
        found = []
        if task.growth.mode == "symmetric":
            found = _shared_split(hists, f, task, category[f])
        else:
            for node, hist in hists.items():
                gains, left, bins, toward, subsets = candidates_of(hist, task.rules, category[f])
                total = hist.sum(axis=1)
                if not len(gains):
                    found.append((node, f, -np.inf, 0, True, b"", *total, 0.0, 0.0, 0.0))
                    continue
                k = _first_best(gains, float(task.rules.score(total[0], total[1])))
                subset = np.array(subsets[k], dtype=np.uint16).tobytes() if subsets is not None else b""
                found.append((node, f, gains[k], int(bins[k]), bool(toward[k]), subset, *total, *left[:, k]))
        data = [hists[row[0]].tobytes() if keep[i] else b"" for row in found]
        return [(i, row[0], row[1], d, *row[2:]) for row, d in zip(found, data, strict=True)]

    def search(batches):
        """Rows come in the order of their keys, so one key's sums are held at a time."""
        key, sums, out = None, {}, []
        for batch in batches:
            ids = np.column_stack([batch.column(i).to_numpy() for i in range(5)])  # tree, grp, feature, node, kind
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(ids)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                own = tuple(ids[begin].tolist())
                if own[:3] != key:
                    if key is not None:
                        out += best(*key, sums)
                    key, sums = own[:3], {}
                part = _summed(batch.column(5).slice(begin, end - begin))
                at = (own[4], own[3])
                sums[at] = sums[at] + part if at in sums else part
                if len(out) >= ROWS_AT_ONCE:
                    yield _split_batch(out)
                    out = []
        if key is not None:
            out += best(*key, sums)
        yield _split_batch(out)

    keys = ["tree", "grp", "feature"]
    parts = _search_parts(rows, binning, tasks, pairs)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "kind", "node").mapInArrow(search, SPLIT_SCHEMA)


def _search_parts(rows: DataFrame, binning: Binning, tasks: Sequence[TreeTask], pairs: dict[tuple[int, int], list[Pair]]) -> int:
    """Into how many tasks the search goes: by the bytes a task of the scan sends, as few as the cores for a few nodes.

    Each task starts a Python worker, which for the arrays of a few nodes takes longer than the search.
    """
    spark = rows.sparkSession
    sent = sum(24 * binning.sizes[f] * len(own) for (i, _), own in pairs.items() for f in tasks[i].features)
    groups = sum(len(tasks[i].features) for i, _ in pairs) + len(tasks)
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), HISTOGRAM_BYTES // SEARCH_BYTES)
    return max(1, min(max(spark.sparkContext.defaultParallelism, -(-sent // SEARCH_BYTES)), groups, most))


def _children(sums: dict[tuple[int, int], np.ndarray], pairs: Sequence[Pair], bins: int) -> dict[int, np.ndarray]:
    """The arrays of built nodes and, by subtraction from the parent's, of their siblings."""
    result, nothing = {}, np.zeros(3 * bins)
    for pair in pairs:
        built = sums.get((ROWS, pair.built), nothing).reshape(3, bins)
        result[pair.built] = built
        if pair.sibling >= 0:
            other = sums.get((PARENT, pair.parent), nothing).reshape(3, bins) - built
            result[pair.sibling] = np.where(other[2] > 0, other, 0.0)  # no rounding where no row is left
    return result


def _shared_split(hists: dict[int, np.ndarray], f: int, task: TreeTask, category: bool) -> list[tuple]:
    """The cut of one feature with the largest gain over all nodes together."""
    if category:
        raise ValueError("symmetric trees take categories as numbers")
    found = {v: candidates_of(h, task.rules, False, row_rules=False) for v, h in hists.items()}
    totals = sum(gains for gains, *_ in found.values())
    if task.rules.noise > 0:
        totals = totals + _noise(task.rules, task.step, f, len(totals))
    scale = sum(float(task.rules.score(*h.sum(axis=1)[:2])) for h in hists.values())
    k = _first_best(totals, scale)
    return [
        (v, f, totals[k], int(found[v][2][k]), bool(found[v][3][k]), b"", *hists[v].sum(axis=1), *found[v][1][:, k])
        for v in hists
    ]


def _fit_rows(tree: int, values: np.ndarray) -> list[tuple]:
    """Squared residuals and rows of training (g, h) and validation (g_left, h_left)."""
    return [(tree, -1, -1, b"", 0.0, 0, True, b"", values[0], values[1], 0.0, values[2], values[3], 0.0)]


def _split_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int32(), pa.bool_(), pa.binary()] + [pa.float64()] * 6
    names = [part.split()[0] for part in SPLIT_SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


# ---------------------------------------------------------------- growth


@dataclass
class Fit:
    """Squared residuals and row counts of both parts, before the tree."""

    sse: dict[int, float] = field(default_factory=dict)
    n: dict[int, float] = field(default_factory=dict)


class _Grower:
    """One growing tree: which nodes it wants to know the best split of, and what it does with the answers."""

    def __init__(self, task: TreeTask):
        self.task, self.growth, self.rules = task, task.growth, task.rules
        self.tree = Tree()
        self.gain: dict[int, float] = {}
        self.wanted: list[Pair] = [Pair(0)]

    @property
    def keeps(self) -> bool:
        """Whether the arrays of the nodes asked for may be needed for their children."""
        return True

    def enough(self, s: Split | None) -> bool:
        if s is None or not np.isfinite(s.gain):
            return False
        scale = abs(float(self.rules.score(s.g, s.h)))
        return 2 * s.gain > (0.0 if self.rules.prune_after else self.rules.min_gain) + TIE * scale

    def begin(self, found: dict[int, Split]) -> None:
        if 0 in found:
            self.tree.value[0] = self.rules.leaf(found[0].g, found[0].h)

    def apply(self, s: Split) -> tuple[int, int]:
        left, right = self.tree.split(s.node, s.feature, s.bin, s.missing_left, s.subset)
        self.tree.value[left] = self.rules.leaf(s.g_left, s.h_left)
        self.tree.value[right] = self.rules.leaf(s.g - s.g_left, s.h - s.h_left)
        self.gain[s.node] = s.gain
        return left, right

    @staticmethod
    def pair(s: Split, left: int, right: int) -> Pair:
        """The child with fewer rows is summed."""
        return Pair(left, right, s.node) if s.n_left <= s.n - s.n_left else Pair(right, left, s.node)

    def result(self) -> Tree:
        return self.tree


class _LevelGrower(_Grower):
    def __init__(self, task: TreeTask):
        super().__init__(task)
        self.depth = 0
        self.wanted = [Pair(0)] if self.growth.max_depth > 0 else []
        self.local: dict[int, int] = {}  # nodes to finish locally, and how many levels they may still grow

    @property
    def keeps(self) -> bool:
        return self.depth + 1 < self.growth.max_depth

    def take(self, found: dict[int, Split]) -> None:
        if self.depth == 0:
            self.begin(found)
        pairs = []
        for node in sorted(v for p in self.wanted for v in (p.built, p.sibling) if v >= 0):
            s = found.get(node)
            if self.enough(s):
                left, right = self.apply(s)
                if max(s.n_left, s.n - s.n_left) > self.task.local_rows:
                    pairs.append(self.pair(s, left, right))
                elif self.depth + 1 < self.growth.max_depth:
                    self.local.update({left: self.growth.max_depth - self.depth - 1, right: self.growth.max_depth - self.depth - 1})
        self.depth += 1
        self.wanted = pairs if self.depth < self.growth.max_depth else []

    def graft(self, node: int, below: Tree) -> None:
        """Put a subtree in the place of a leaf."""
        queue = [(0, node)]
        while queue:
            old, new = queue.pop(0)
            if below.feature[old] < 0:
                continue
            pair = self.tree.split(new, below.feature[old], below.bin[old], below.missing_left[old], below.subset[old])
            for child, place in zip((below.left[old], below.left[old] + 1), pair, strict=True):
                self.tree.value[place] = below.value[child]
                queue.append((child, place))

    def result(self) -> Tree:
        if self.rules.prune_after and self.rules.min_gain > 0:
            return _pruned(self.tree, self.gain, self.rules.min_gain)
        return self.tree


class _SymmetricGrower(_LevelGrower):
    """All nodes of a level take one split, those without rows too."""

    def __init__(self, task: TreeTask):
        super().__init__(task)
        self.open = [0]

    def take(self, found: dict[int, Split]) -> None:
        if self.depth == 0:
            self.begin(found)
        known = next((found[v] for v in self.open if v in found), None)
        if known is None or not 2 * known.gain > self.rules.min_gain:
            self.wanted = []
            return
        pairs, children = [], []
        for node in self.open:
            s = found.get(node) or Split(node, known.gain, known.feature, known.bin, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
            left, right = self.apply(s)
            children += [left, right]
            if s.n > 0:
                pairs.append(self.pair(s, left, right))
        self.open = children
        self.depth += 1
        self.wanted = pairs if self.depth < self.growth.max_depth else []


class _LeafGrower(_Grower):
    """Best-first growth in about as many passes as the tree is deep.

    ``tree`` holds every split that was ever worth making.  Each round replays
    best-first growth with the gains known so far and asks, in one pass, for all
    children of the replayed splits that are still unknown.  When none is left, the
    replay is what strict one-leaf-at-a-time growth gives.
    """

    def __init__(self, task: TreeTask):
        super().__init__(task)
        self.known: dict[int, Split] = {}
        self.children: dict[int, tuple[int, int]] = {}
        self.depth = {0: 0}
        self.picked: list[int] = []

    def take(self, found: dict[int, Split]) -> None:
        if not self.known:
            self.begin(found)
        for pair in self.wanted:
            for node in (pair.built, pair.sibling):
                if node >= 0:
                    self.known[node] = found.get(node) or Split(node, float("-inf"), -1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        self.picked = self._replay()
        self.wanted = []
        for node in self.picked:
            if node in self.children:
                continue
            s = self.known[node]
            pair = self.children[node] = self.apply(s)
            for child in pair:
                self.depth[child] = self.depth[node] + 1
            if self.depth[node] + 1 < self.growth.max_depth:
                self.wanted.append(self.pair(s, *pair))

    def _replay(self) -> list[int]:
        leaves, picked = [0], []
        while len(leaves) < self.growth.max_leaves:
            able = [v for v in leaves if self.enough(self.known.get(v)) and self.depth[v] < self.growth.max_depth]
            if not able:
                break
            best = max(able, key=lambda v: (self.known[v].gain, -v))
            picked.append(best)
            leaves.remove(best)
            # children not made yet are unknown, and get places of their own
            leaves += self.children.get(best, (-2 * best - 1, -2 * best - 2))
        return picked

    def result(self) -> Tree:
        return _restricted(self.tree, set(self.picked))


GROWERS = {"level": _LevelGrower, "symmetric": _SymmetricGrower, "leaf": _LeafGrower}


def _pruned(tree: Tree, gain: dict[int, float], min_gain: float) -> Tree:
    """Splits whose children are leaves and whose gain is too small are undone, until none is left."""
    kept = {v for v, f in enumerate(tree.feature) if f >= 0}
    for node in sorted(kept, reverse=True):  # children come after their parent
        first = tree.left[node]
        if first not in kept and first + 1 not in kept and 2 * gain[node] < min_gain:
            kept.discard(node)
    return _restricted(tree, kept)


def _restricted(tree: Tree, kept: set[int]) -> Tree:
    """The tree of the kept splits only, renumbered."""
    result = Tree(value=[tree.value[0]])
    queue = [(0, 0)]
    while queue:
        old, new = queue.pop(0)
        if old in kept:
            pair = result.split(new, tree.feature[old], tree.bin[old], tree.missing_left[old], tree.subset[old])
            for child, place in zip((tree.left[old], tree.left[old] + 1), pair, strict=True):
                result.value[place] = tree.value[child]
                queue.append((child, place))
    return result


def grow_trees(
    table: DataFrame,
    binning: Binning,
    tasks: Sequence[TreeTask],
    with_fit: bool = False,
    stop_if: Callable[[int, Fit], bool] | None = None,
) -> list[Tree | None]:
    """Grow one tree per task; a pass over the rows handles all open nodes of all of them.

    ``stop_if`` sees (task number, fit of the model so far) after the first pass, and
    ends that tree there, as None, by returning true.
    """
    growers = [GROWERS[t.growth.mode](t) for t in tasks]
    stopped: set[int] = set()
    where: dict[tuple[int, int], DataFrame] = {}
    kept: dict[int, tuple[DataFrame, int]] = {}
    first = True
    try:
        while first or any(g.wanted for i, g in enumerate(growers) if i not in stopped):
            answers: list[dict[int, Split]] = [{} for _ in tasks]
            for wanted in _portions(growers, binning, stopped):
                rows = histogram(table, binning, tasks, [g.tree for g in growers], wanted, with_fit=first and with_fit)
                for i, fit in _one_pass(rows, binning, tasks, wanted, growers, where, kept, answers):
                    if stop_if is not None and stop_if(i, fit):
                        stopped.add(i)
            for i, grower in enumerate(growers):
                if i not in stopped and grower.wanted:
                    grower.take(answers[i])
            first = False
        _finish_locally(table, binning, tasks, growers)
    finally:
        for df, _ in kept.values():
            release(df)
    return [None if i in stopped else g.result() for i, g in enumerate(growers)]


def _finish_locally(table: DataFrame, binning: Binning, tasks: Sequence[TreeTask], growers: Sequence[_Grower]) -> None:
    """Grow what is left below small nodes, a task per node, and graft it on."""
    local = [getattr(g, "local", {}) for g in growers]
    if not any(local):
        return
    width, tasks = binning.width, list(tasks)
    trees = [g.tree for g in growers]

    def send(batches):
        for arrow in batches:
            batch = Batch.of(arrow, width)
            for i, task in enumerate(tasks):
                if not local[i]:
                    continue
                g, h, _ = task.gradients(batch, batch.state[:, task.model])
                h = np.ones(len(g)) if h is None else h
                node = trees[i].route(batch.bins)
                held = batch.fold == (-2 if task.held is None else task.held)
                pick = np.flatnonzero(np.isin(node, list(local[i])) & ~held & (h > 0))
                if len(pick):
                    columns = [
                        pa.array(np.full(len(pick), i, dtype=np.int32)),
                        pa.array(node[pick].astype(np.int32)),
                        bytes_column(batch.bins[pick]),
                        pa.array(g[pick]),
                        pa.array(h[pick]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "bins", "g", "h"])

    def grow(group: pa.Table) -> pa.Table:
        i, root = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        raw = np.concatenate([_matrix_of(c, len(c)) for c in group.column("bins").chunks])
        bins = (raw if len(raw) == len(group) * width else np.frombuffer(raw.tobytes(), dtype=np.uint16)).reshape(-1, width)
        g, h = group.column("g").to_numpy(), group.column("h").to_numpy()
        order = np.lexsort((h, g, *bins.T))  # sums do not depend on the order of arrival
        below = _grown_locally(bins[order], g[order], h[order], binning, tasks[i], local[i][root])
        subsets = [list(v) for v in below.subset]
        columns = [below.feature, below.bin, below.left, below.value, below.missing_left, subsets]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]
        n = len(below.feature)
        place = [pa.array([i] * n, pa.int32()), pa.array([root] * n, pa.int32()), pa.array(range(n), pa.int32())]
        names = ["tree", "root", "place", "feature", "bin", "left", "value", "missing_left", "subset"]
        return pa.table(place + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    sent = table.mapInArrow(send, "tree int, node int, bins binary, g double, h double")
    schema = "tree int, root int, place int, feature int, bin int, left int, value double, missing_left boolean, subset array<int>"
    found: dict[tuple[int, int], Tree] = {}
    for row in sorted(sent.groupBy("tree", "node").applyInArrow(grow, schema).collect(), key=lambda r: (r["tree"], r["root"], r["place"])):
        tree = found.setdefault((row["tree"], row["root"]), Tree([], [], [], [], [], []))
        for name in ("feature", "bin", "left", "value", "missing_left"):
            getattr(tree, name).append(row[name])
        tree.subset.append(tuple(row["subset"]))
    for (i, root), below in sorted(found.items()):
        growers[i].graft(root, below)


def _grown_locally(bins: np.ndarray, g: np.ndarray, h: np.ndarray, binning: Binning, task: TreeTask, depth: int) -> Tree:
    """The level-wise tree of the rows of one node."""
    grower = _LevelGrower(TreeTask(Growth("level", depth), task.rules, task.gradients, task.features))
    tree, sizes = grower.tree, binning.sizes
    starts = np.concatenate([[0], np.cumsum([sizes[f] for f in task.features])])
    flat = bins[:, list(task.features)].astype(np.int64) + starts[:-1]
    numbers = _NumberCuts.of([sizes[f] for f in task.features if not binning.is_category(f)])
    level = [(0, np.arange(len(g)))]
    for _ in range(depth):
        below = []
        for node, rows in level:
            if len(rows) < max(task.rules.min_split_rows, 2 * task.rules.min_rows):
                continue
            at = flat[rows].ravel()
            wide = [None if w is None else np.repeat(w[rows], flat.shape[1]) for w in (g, h, None)]
            sums = np.array([np.bincount(at, weights=w, minlength=starts[-1]) for w in wide])
            best = _best_local(node, sums, starts, numbers, binning, task)
            if not grower.enough(best):
                continue
            first, second = grower.apply(best)
            value = bins[rows, best.feature]
            goes_left = np.isin(value, best.subset) if best.subset else np.where(value == 0, best.missing_left, value <= best.bin)
            below += [(first, rows[goes_left]), (second, rows[~goes_left])]
        level = below
    return tree


@dataclass(frozen=True)
class _NumberCuts:
    """Where the arrays of all numbers lie, one below the other and filled up with bins of no rows, and which cuts they have."""

    place: np.ndarray  # of each bin in the arrays side by side; the last one, a zero, where there is no such bin
    valid: np.ndarray  # cuts that send missing values left, then those that send them right
    bins: np.ndarray

    @classmethod
    def of(cls, sizes: Sequence[int]) -> _NumberCuts:
        size, most = np.array(sizes, dtype=np.int64)[:, None], max(sizes, default=2)
        bins = np.arange(most)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        place = np.where(bins < size, starts[:-1, None] + bins, starts[-1])
        return cls(place, np.concatenate([bins[:-1] < size - 1, bins[1:-1] < size - 1], axis=1), np.concatenate([bins[:-1], bins[1:-1]]))

    def best(self, sums: np.ndarray, rules: SplitRules):
        """Per number: gain, bin, missing_left, left sums and sums of its best cut, as `candidates_of` and `_first_best` find it."""
        count, most = self.place.shape
        hist = np.concatenate([sums, np.zeros((3, 1))], axis=1)[:, self.place]
        total, left = hist.sum(axis=2), hist.cumsum(axis=2)[:, :, :-1]
        valid = self.valid
        if rules.learn_missing:
            left = np.concatenate([left, left[:, :, 1:] - hist[:, :, :1]], axis=2)
            valid = valid & ((np.arange(valid.shape[1]) < most - 1) | (hist[2, :, :1] > 0))
        else:
            valid = valid[:, : most - 1]
        gains = np.where(valid, _gains(total[:, :, None], left, rules, True), -np.inf)
        highest = gains.max(axis=1)
        able = np.isfinite(highest)
        scale = np.abs(rules.score(total[0], total[1]))
        least = np.where(able, highest - TIE * (scale + np.abs(np.where(able, highest, 0.0))), -np.inf)
        cut = np.argmax(gains >= least[:, None], axis=1)
        rows = np.arange(count)
        return gains[rows, cut], self.bins[cut], cut < most - 1, left[:, rows, cut], total, scale


def _best_local(node: int, sums: np.ndarray, starts: np.ndarray, numbers: _NumberCuts, binning: Binning, task: TreeTask) -> Split | None:
    """The best split of a node from its arrays of all features side by side; numbers are searched in one go."""
    count, rules, best = len(numbers.place), task.rules, None
    if count:
        gain, cut, toward, left, totals, scales = numbers.best(sums[:, : starts[count]], rules)
    for k, f in enumerate(task.features):
        if k < count:
            found = gain[k], cut[k], totals[:, k], left[:, k], toward[k], ()
            scale = float(scales[k])
        else:
            hist = sums[:, starts[k] : starts[k + 1]]
            gains, lefts, cuts, sides, subsets = candidates_of(hist, rules, True)
            if not len(gains):
                continue
            total = hist.sum(axis=1)
            scale = abs(float(rules.score(total[0], total[1])))
            c = _first_best(gains, scale)
            found = gains[c], cuts[c], total, lefts[:, c], sides[c], subsets[c]
        if np.isfinite(found[0]) and (best is None or found[0] > best.gain + TIE * (scale + abs(best.gain))):
            best = Split(node, float(found[0]), f, int(found[1]), *map(float, found[2]), *map(float, found[3]), bool(found[4]), found[5])
    return best


def _portions(growers: Sequence[_Grower], binning: Binning, stopped: set[int]) -> list[list[list[Pair]]]:
    """The wanted nodes, in portions whose arrays fit a task.  A symmetric level is not parted."""
    sizes = binning.sizes
    portions: list[list[list[Pair]]] = [[[] for _ in growers]]
    held = 0
    for i, grower in enumerate(growers):
        if i in stopped or not grower.wanted:
            continue
        node_bytes = 24 * sum(sizes[f] for f in grower.task.features)
        lots = [grower.wanted] if grower.growth.mode == "symmetric" else [[p] for p in grower.wanted]
        for lot in lots:
            if held and held + node_bytes * len(lot) > HISTOGRAM_BYTES:
                portions.append([[] for _ in growers])
                held = 0
            portions[-1][i] += lot
            held += node_bytes * len(lot)
    return portions


def _one_pass(rows, binning, tasks, wanted, growers, where, kept, answers):
    """Run one pass, note the best splits in ``answers``, and yield the fits that came with it."""
    parents: dict[int, tuple[DataFrame, list[int]]] = {}
    for i, own in enumerate(wanted):
        for pair in own:
            if pair.parent >= 0:
                source = where[i, pair.parent]
                parents.setdefault(id(source), (source, []))[1].append(i << 32 | pair.parent)
    frames = [rows]
    shared = [i for i, t in enumerate(tasks) if t.growth.mode == "symmetric"]
    for source, keys in parents.values():
        key = F.shiftleft(F.col("tree").cast("bigint"), 32) + F.col("node")
        group = F.when(F.col("tree").isin(shared), F.lit(0)).otherwise(F.col("node")) if shared else F.col("node")
        frames.append(
            source.filter(key.isin(keys)).select(
                "tree", group.cast("int").alias("grp"), "feature", "node", F.lit(PARENT).alias("kind"), "data"
            )
        )
    keeps = [g.keeps for g in growers]
    result = _splits(reduce(DataFrame.unionByName, frames), binning, tasks, wanted, keeps)
    if any(k and w for k, w in zip(keeps, wanted, strict=True)):
        above = 1 + max((kept[k][1] for k in parents), default=0)
        if above < CHAIN:
            result = result.persist(StorageLevel.DISK_ONLY)
        else:
            result, above = write_and_reread(result, "histograms"), 0
        kept[id(result)] = result, above
    found = result.drop("data").collect()
    for row in sorted(found, key=lambda r: (r["tree"], r["node"], r["feature"])):
        i, node = row["tree"], row["node"]
        if node < 0:
            yield i, Fit({TRAIN: row["g"], VALIDATION: row["g_left"]}, {TRAIN: row["h"], VALIDATION: row["h_left"]})
            continue
        where[i, node] = result
        best = answers[i].get(node)
        scale = float(tasks[i].rules.score(row["g"], row["h"]))
        if best is None or row["gain"] > best.gain + TIE * (abs(scale) + abs(best.gain) if np.isfinite(best.gain) else 0.0):
            subset = tuple(int(v) for v in np.frombuffer(row["subset"], dtype=np.uint16))
            sums = [row[c] for c in ("g", "h", "n", "g_left", "h_left", "n_left")]
            answers[i][node] = Split(node, row["gain"], row["feature"], row["bin"], *sums, row["missing_left"], subset)
