"""Line dedup: lines that many documents share are dropped from all of them but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.text import ascii_lower, matched, picked, whole_text

MIN_DOCS = 2
MIN_CHARS = 10
STRIP = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, by position."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(STRIP)))


def _hashes(keys: Column) -> Column:
    """A 128-bit hash for each key; null for one that is too short to count."""
    return F.transform(
        keys, lambda x: F.when(F.length(x) >= MIN_CHARS, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b")))
    )


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Each row of ``docs`` with its text rid of shared lines, and n_lines and n_dropped.

    Lines are exploded and hashed; a hash that at least ``min_docs`` documents
    hold is dropped everywhere but in the smallest doc_id.  Counting a hash adds
    up partial counts of tasks, so a line of a third of all documents is no
    burden.  Only the places of lines to drop travel back to the documents, so a text
    of any number of lines is put together in one walk.

    A missing or empty text is one empty line.  Rows repeated under one doc_id
    are one document where two documents are asked for, and count singly above
    that; they get the same treatment.  Rows without doc_id stay as they are.
    An empty table gives an empty result.
    """
    own = picked(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    hashes = _hashes(line_keys(whole_text()))
    # distinct texts rather than hashes: sets of strings are hashed, those of structs compared one by one
    distinct = F.array_distinct(F.filter(line_keys(whole_text()), lambda x: F.length(x) >= MIN_CHARS))
    held = own.select("doc_id", F.explode(_hashes(distinct)).alias("h"))
    shared = (
        held.groupBy(F.col("h.a").alias("ha"), F.col("h.b").alias("hb"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        .where((F.col("n") >= min_docs) & (F.col("keeper") < F.col("last")))
        .select("ha", "hb", "keeper")
    )
    placed = own.select("doc_id", _content().alias("content"), F.posexplode(hashes).alias("at", "h")).where("h IS NOT NULL")
    drops = (
        matched(placed.select("doc_id", "content", "at", F.col("h.a").alias("ha"), F.col("h.b").alias("hb")), shared, "ha", "hb")
        .where("doc_id <> keeper")
        .groupBy("doc_id", "content")
        .agg(F.collect_set("at").alias("at"))
    )
    drop, count, gone, rest = (_unused(docs, name) for name in ("_drop", "_lines", "_gone", "_rest"))
    sides = drops.select(F.col("doc_id").alias("_id"), "content", F.col("at").alias(drop))
    joined = docs.join(sides, (docs["doc_id"] == sides["_id"]) & (_content(docs["text"]) == sides["content"]), "left")
    lines = F.split(whole_text(), "\n")
    # the lines are bound to a name, so that they are split once and not for every place
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    put = F.transform(F.array(lines), lambda split: F.array_join(F.transform(kept, lambda at: split[at]), "\n"))[0]
    out = joined.select(
        *[docs[f"`{c}`"] for c in docs.columns],
        F.size(lines).cast("long").alias(count),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias(gone),
        F.when(F.col(drop).isNull(), F.col("text")).otherwise(put).alias(rest),
    )
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        F.col(rest).alias("text"),
        F.col(count).alias("n_lines"),
        F.col(gone).alias("n_dropped"),
    )


def _content(text: Column | None = None) -> Column:
    """Tells rows under one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(F.col("text") if text is None else text, F.lit("")))


def _unused(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
