"""What the corpus operators share: words, lines and the columns they take."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that part words, as a class for Java, Python and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
SPACE_BYTES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator works on, so that no further column can clash with its own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def whole_text(name: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def lots(batch: pa.RecordBatch, most_bytes: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most_bytes`` in the named column, or one row with more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def lookup_key(docs: DataFrame, *content: str) -> Column:
    """What the verdict on a row is looked up by: its doc_id, and for a row without one the ``content`` it is judged by.

    Rows without doc_id thus share a verdict only where it is the same one.
    """
    parts = [F.sha2(whole_text(f"`{c}`"), 256) for c in content]
    own = F.when(docs["doc_id"].isNull(), F.sha2(F.concat(*parts), 256))
    return F.struct(docs["doc_id"].alias("id"), own.alias("content"))


def same_key(key: Column, other: Column) -> Column:
    """Whether two keys of `lookup_key` are one."""
    return key["id"].eqNullSafe(other["id"]) & key["content"].eqNullSafe(other["content"])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text: what stands between white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def matched(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """Inner join of large rows with one row per key.

    A further key that is made of the others lets neither side keep the
    partitioning it has, so adaptive execution may split a partition that one
    key fills.
    """
    extra = F.xxhash64(*on)
    return left.withColumn("_spread", extra).join(right.withColumn("_spread", extra), [*on, "_spread"]).drop("_spread")
