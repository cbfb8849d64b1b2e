"""Best-fit packing of documents into sequences of fixed length, under conflicts.

Documents are dealt into shards of about ``SHARD_DOCS`` by a hash, so copies and
the documents of one source spread over all shards, and each shard is packed by
itself, longest piece first: the fit is the best within a shard, not over all.  Open bins stand in the order of their residual
space.  A piece looks up the tightest bin that has room and goes on to the next
larger residual until a bin has no conflict.  A bin's conflicts are bitmaps: one
of duplicate clusters, and one per permitted document of a source.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.text import ascii_lower, whole_text, words_of
from tabloom.session import write_and_reread

CAPACITY = 2048
PER_SOURCE = 4
SHARD_DOCS = 2000
EQUAL_ROWS = 16


class OpenBins:
    """Bins by residual space, with a bitmap of the residuals that occur."""

    def __init__(self, capacity: int, per_source: int):
        self.at = [[] for _ in range(capacity + 1)]
        self.present = 0
        self.per_source = per_source
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def open(self) -> int:
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        return len(self.clusters) - 1

    def fits(self, bin_: int, source: int, cluster: int) -> bool:
        return not (self.clusters[bin_] >> cluster & 1 or self.sources[bin_][-1] >> source & 1)

    def find(self, length: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Residual and bin: the tightest that has room and no conflict; the oldest of equals."""
        left = self.present >> length
        residual = length
        while left:
            step = (left & -left).bit_length() - 1
            residual += step
            for bin_ in self.at[residual]:
                if self.fits(bin_, source, cluster):
                    return residual, bin_
            left >>= step + 1
            residual += 1
        return None

    def put(self, bin_: int, before: int | None, residual: int, source: int, cluster: int) -> None:
        if before is not None:
            self.at[before].remove(bin_)
            if not self.at[before]:
                self.present &= ~(1 << before)
        self.clusters[bin_] |= 1 << cluster
        planes = self.sources[bin_]
        planes[next(i for i, plane in enumerate(planes) if not plane >> source & 1)] |= 1 << source
        self.at[residual].append(bin_)
        self.at[residual].sort()
        self.present |= 1 << residual


def pack(lengths, sources, clusters, capacity: int = CAPACITY, per_source: int = PER_SOURCE):
    """(row, piece, bin, start, length) of every piece; rows are taken longest first, equal ones in their order.

    A row longer than a bin fills whole bins of its own; its last piece is packed like others.
    """
    out, bins = [], OpenBins(capacity, per_source)
    number: dict = {}
    code = [(number.setdefault(("s", s), len(number)), number.setdefault(("c", c), len(number))) for s, c in zip(sources, clusters)]
    rest = []
    for row, length in enumerate(lengths):
        full = length // capacity
        for piece in range(full):
            out.append((row, piece, bins.open(), 0, capacity))
        if length % capacity or not length:
            rest.append((length % capacity, row, full))
    for length, row, piece in sorted(rest, key=lambda x: (-x[0], x[1])):
        source, cluster = code[row]
        hit = bins.find(length, source, cluster)
        before, bin_ = hit if hit else (None, bins.open())
        space = capacity if before is None else before
        out.append((row, piece, bin_, capacity - space, length))
        bins.put(bin_, before, space - length, source, cluster)
    return out


def text_cluster(text: Column) -> Column:
    """A cluster of copies: equal words in lower case."""
    return F.xxhash64(F.array_join(words_of(ascii_lower(text)), " "))


def _salted(shaped: DataFrame) -> DataFrame:
    """The rows with a salt.

    Copies differ in doc_id and so in their shard.  Rows that agree in all that is hashed, such as rows without
    doc_id and text, would pile up in one; more than ``EQUAL_ROWS`` of them are told apart by their place in the table.
    """
    keys = ["doc_id", "n", "cluster"]
    many = shaped.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > EQUAL_ROWS)
    same = many.select(F.xxhash64(*keys).alias("key"), "rows").groupBy("key").agg(F.max("rows").alias("rows"))
    marked = shaped.withColumn("key", F.xxhash64(*keys)).withColumn("place", F.monotonically_increasing_id())
    salt = F.when(F.col("rows").isNotNull(), F.xxhash64("place")).otherwise(F.lit(0))
    joined = marked.join(same, "key", "left")
    return joined.withColumn("salt", salt).drop("key", "place", "rows")


def pack_documents(
    docs: DataFrame,
    length: Column | None = None,
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """A row per piece: doc_id, piece, shard, bin, bin_start, doc_start, n_tokens.

    ``length`` defaults to the number of words and ``cluster`` to copies of the
    text.  A missing or empty text is a piece of length 0 that goes where it
    has no conflict.  A missing source or doc_id is a value like others.  Rows
    repeated under one doc_id are packed singly, and as copies never share a
    bin.  An empty table gives an empty result.
    """
    shaped = docs.select(
        F.col("doc_id"),
        F.coalesce("source", F.lit("")).alias("source"),
        (F.size(words_of(whole_text())) if length is None else length).cast("long").alias("n"),
        (text_cluster(whole_text()) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
    )
    shaped = write_and_reread(shaped, "packing-shapes")
    shards = max(1, math.ceil(shaped.count() / shard_docs))
    dealt = _salted(shaped).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "cluster", "salt"), F.lit(shards)).cast("long"))
    dealt = dealt.drop("salt")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(key, rows):
        rows = rows.sort_values(["doc_id", "n", "cluster", "source"], na_position="first", kind="stable").reset_index(drop=True)
        made = pd.DataFrame(
            pack(rows["n"].tolist(), rows["source"].tolist(), rows["cluster"].tolist(), capacity, per_source),
            columns=["row", "piece", "bin", "bin_start", "n_tokens"],
        )
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].take(made["row"]).array,
                "piece": made["piece"],
                "shard": key[0],
                "bin": made["bin"],
                "bin_start": made["bin_start"],
                "doc_start": made["piece"] * capacity,
                "n_tokens": made["n_tokens"],
            }
        )

    schema = f"doc_id {kind}, piece long, shard long, bin long, bin_start long, doc_start long, n_tokens long"
    return dealt.groupBy("shard").applyInPandas(one, schema)
