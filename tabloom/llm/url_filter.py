"""URL filters: host and path rules, then exact membership by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the unlisted keys that level 1 lets
through, level 3 the listed keys that level 2 lets through, and so on until a
level lets nothing wrong through.  Over the complete universe of keys the walk
through the levels is then exact, and urls are judged without a join: the
filters are all a task needs.

The list is a table; its keys meet the universe when the filters are built.  Filters are built in tasks: each ORs its keys into words of 64 bits, words are
merged by their place.  Keys are cut into shards by hash so that the filters of
one pass hold at most ``PASS_BYTES``; a longer list takes more passes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.bloom import BITS_PER_KEY, filter_of, passes
from tabloom.llm.text import ascii_lower
from tabloom.session import write_and_reread

PASS_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty where it has no ``://`` or is missing."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def walk(levels: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys are listed: the parity of the first level that refuses a key."""
    listed = np.zeros(len(a), bool)
    alive = np.arange(len(a))
    for k, words in enumerate(levels):
        alive = alive[passes(words, a[alive], b[alive], k)]
        listed[alive] = k % 2 == 0
    return listed


def _alive(keys: DataFrame, levels, listed: bool) -> DataFrame:
    """Keys of one kind that every level so far lets through."""
    held = keys.sparkSession.sparkContext.broadcast(levels)

    def pick(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            ok = np.ones(len(a), bool)
            for k, words in enumerate(held.value):
                ok &= passes(words, a, b, k)
            yield batch.filter(pa.array(ok))

    rows = keys.where(F.col("listed") == listed).select("a", "b")
    return rows.mapInArrow(pick, "a bigint, b bigint") if levels else rows


def build_cascade(keys: DataFrame) -> list[np.ndarray]:
    """The levels for a universe of keys (a, b, listed)."""
    levels: list[np.ndarray] = []
    while True:
        wrong = _alive(keys, levels, listed=len(levels) % 2 == 0)
        n = wrong.count()
        if n == 0:
            return levels
        levels.append(filter_of(wrong, n, len(levels)))


def listed_flags(rows: DataFrame, key: str, is_listed: Column | DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``rows`` with a column ``listed``: whether the row's key is a listed one.

    The universe is every key in ``rows``.  ``is_listed`` is a table of any size
    whose first column holds the listed keys, repeated or unseen ones too, or a condition over the
    column ``key``; either meets every key of the universe once, when the filters are built.  A
    missing key is the empty key, in ``rows`` and in the list.
    """
    name = F.coalesce(F.col(key), F.lit(""))
    hashed = rows.withColumn("_a", F.xxhash64(F.lit("a"), name)).withColumn("_b", F.xxhash64(F.lit("b"), name))
    universe = rows.select(name.alias(key)).distinct()
    if isinstance(is_listed, DataFrame):
        own = is_listed.select(F.coalesce(F.col(f"`{is_listed.columns[0]}`"), F.lit("")).alias(key)).distinct()
        told = universe.join(own.withColumn("listed", F.lit(True)), key, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        told = universe.withColumn("listed", is_listed)
    halves = [F.xxhash64(F.lit(side), F.col(key)).alias(side) for side in "ab"]
    keys = write_and_reread(told.select(*halves, "listed"), "url-keys")
    # Any level holds part of one kind of keys: the larger kind bounds it, and four of the largest bound all.
    larger = keys.groupBy("listed").count().agg(F.max("count")).first()[0] or 0
    shards = max(1, math.ceil(4 * larger * BITS_PER_KEY / 8 / pass_bytes))
    parts = []
    for shard in range(shards):
        own = keys.where(F.pmod("a", F.lit(shards)) == shard)
        held = rows.sparkSession.sparkContext.broadcast(build_cascade(own))

        @F.pandas_udf("boolean")
        def listed(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(walk(held.value, a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)))

        parts.append(hashed.where(F.pmod("_a", F.lit(shards)) == shard).withColumn("listed", listed("_a", "_b")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("_a", "_b")


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], is_listed: Column | DataFrame) -> DataFrame:
    """Host, path, rule and verdict of each page.

    ``is_listed`` is a table of listed hosts, or a condition over the column ``host``.  A
    missing url has an empty host, which no rule fits.  Repeated rows are
    judged alike, and an empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    flagged = listed_flags(rows, "host", is_listed)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return flagged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")
