"""A Merkle manifest of a document table: a digest, a proof and a check per row.

A leaf is the digest of a row.  The leaves of a language, ascending by doc_id,
are hashed in runs of eight into the nodes of the next level, until one node,
the subroot, is left; the subroots are hashed in the same way into the root.

Levels are built with windows.  A node has its place in its group, so its slot
in its run and the length of the run are known; lag and lead columns at the
fixed offsets 1 to 7 hold its neighbours, and those outside the run are masked
out by slot and run length.  What is left are the siblings, and the node in
slot 0 of each run hashes the parent.  A window spans ``BLOCK`` nodes, a whole
number of runs, so a language that holds most rows is spread over many tasks.

Places are exact and need no task that sees a whole language: rows are ranged
by group and order, numbered within their partition, and shifted by the number
of rows that the group has in earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.text import picked
from tabloom.session import write_and_reread

WAYS = 8  # nodes of a run
BLOCK = 64 * WAYS  # nodes of a window
# Fixed value: Spark numbers the rows of partition p from p * 2^33.
PARTITION_BITS = 33

NO_SIBLINGS = "CAST(array() AS array<struct<left:string,right:string>>)"


def field(value: Column) -> Column:
    """A value with its length in front: ``-`` for null, else bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The digest of a row with ``text`` for its text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def merkle_manifest(docs: DataFrame, copy: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and path of every row of ``docs``, and whether a copy of its text still belongs to the root.

    Takes doc_id, text, lang, source and n_chars; further columns are left
    aside.  ``copy`` is the text to check, an expression over these columns
    (by default the text itself).  Returns one row per row: doc_id, leaf,
    subroot, root, path (siblings left and right of the node, from the leaf's
    level up to the root's), folded_root and verified.

    A null is a value of its own in every column: a missing lang is one more
    group, before all others, and rows without doc_id come first.  Rows under
    one doc_id are ordered by their leaf; equal rows are leaves beside each
    other.  An empty table gives no rows.
    """
    own = picked(docs, "doc_id", "text", "lang", "source", "n_chars")
    leaves = write_and_reread(
        own.select(
            F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"),
            "doc_id",
            leaf_of(F.col("text")).alias("h"),
            leaf_of(F.col("text") if copy is None else copy).alias("copy"),
        ),
        "merkle-leaves",
    )
    levels, subroots = _levels(_placed(leaves, "doc_id", "h"))
    tops, roots = _levels(_placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), "h"), "lang"))
    over = _descended(tops, roots.select("g", F.col("h").alias("root"), F.expr(NO_SIBLINGS).alias("path")))
    over = over.select(F.col("lang").alias("g"), F.col("h").alias("subroot"), "root", "path")
    found = _descended(levels, write_and_reread(over, "merkle-subroots"))
    return found.select(
        "doc_id",
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        "path",
        folded(F.col("path"), F.col("copy")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """The nodes with their rank in their group ``g`` and the group's size ``n``.

    Equal nodes are told apart by where they were read, so that any number of
    them can be spread; which of them comes first does not matter.
    """
    spread = nodes.withColumn("_tie", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange("g", *order, "_tie").sortWithinPartitions("g", *order, "_tie").drop("_tie")
    laid = write_and_reread(ranged.withColumn("_place", F.monotonically_increasing_id()), "merkle-order")
    laid = laid.withColumn("_part", F.shiftright("_place", PARTITION_BITS))
    parts = laid.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_place").alias("first"))
    group = Window.partitionBy("g")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        "g",
        "_part",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
        F.sum("rows").over(group).alias("n"),
    )
    placed = laid.join(shifts, ["g", "_part"])
    return placed.withColumn("rank", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """The nodes with the digests left and right of them in their run."""
    block = Window.partitionBy("g", F.floor(F.col("rank") / BLOCK)).orderBy("rank")
    slot = F.col("rank") % WAYS
    length = F.least(F.lit(WAYS).cast("long"), F.col("n") - (F.col("rank") - slot))
    offsets = range(1, WAYS)
    left = [F.when(slot >= k, F.lag("h", k).over(block)) for k in reversed(offsets)]
    right = [F.when(slot + k < length, F.lead("h", k).over(block)) for k in offsets]
    return nodes.select("*", F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))


def _parents(level: DataFrame) -> DataFrame:
    """The next level: first children hash their run; what is alone in its group stays as it is."""
    first = level.filter(F.col("rank") % WAYS == 0)
    return first.select(
        "g",
        F.when(F.col("n") > 1, F.sha2(F.concat("h", "right"), 256)).otherwise(F.col("h")).alias("h"),
        (F.col("rank") / WAYS).cast("long").alias("rank"),
        F.ceil(F.col("n") / WAYS).alias("n"),
    )


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels from the leaves up, each written once, and the last node of every group."""
    levels = [write_and_reread(_with_siblings(nodes), "merkle-level")]
    longest = levels[0].agg(F.max("n")).first()[0] or 0
    while longest > WAYS:
        levels.append(write_and_reread(_with_siblings(_parents(levels[-1])), "merkle-level"))
        longest = -(-longest // WAYS)
    return levels, _parents(levels[-1]).select("g", "h")


def _descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with the columns of their group in ``tops``, their level's siblings put before its path."""
    carried = [c for c in tops.columns if c not in ("g", "path")]
    above = tops.withColumn("rank", F.lit(0).cast("long"))
    for level in reversed(levels):
        over = above.select("g", F.col("rank").alias("_run"), F.col("path").alias("_path"), *carried)
        siblings = F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.expr(NO_SIBLINGS))
        below = level.withColumn("_run", (F.col("rank") / WAYS).cast("long")).join(over, ["g", "_run"])
        above = below.withColumn("path", F.concat(siblings, "_path")).drop("_run", "_path", "left", "right")
    return above
