"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Every passage of every document is a query.  Passages are word windows that
overlap by half and are twice as long as the longest item, so an item that
occurs anywhere lies whole in one of them.  Impacts are divided by the item's
score for itself: 1 means that a passage has all words of the item, and the
threshold is a share of that.

The index is small next to the corpus and goes to the tasks in shards of at
most ``SHARD_BYTES`` of item text; more items mean more shards, each a pass.

A passage is judged in two steps that lose nothing.  Terms whose impacts add up
to little in every item are set apart; a passage can only reach the threshold
for an item if its other terms bring the rest, and these sums are taken for all
passages of a batch at once.  Passages that remain run block-max WAND over all
their terms.  What it retrieves is verified: both the question and the answer
of the item must be in the passage as runs of words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.text import lookup_key, picked, same_key, whole_text
from tabloom.session import write_and_reread

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.6
RUN = 5
BLOCK = 16
SHARD_BYTES = 8 << 20
BATCH_CHARS = 4 << 20
PARTS = r"[^\pL\pN]+"


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case terms of texts one after the other, and the place where each text begins, with the end."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), PARTS)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    flat, owner = flat.filter(real), owner.filter(real).to_numpy()
    return flat, np.searchsorted(owner, np.arange(len(texts) + 1))


def terms_of(text: str) -> list[str]:
    return split_terms(pa.array([text], pa.string()))[0].to_pylist()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Terms of an item's question and of its answer: the last sentence, or the last third of a single one."""
    sentences = [t for t in (terms_of(s) for s in re.split(r"(?<=[.?!])\s+|\n", text)) if t]
    if len(sentences) > 1:
        return [t for s in sentences[:-1] for t in s], sentences[-1]
    whole = sentences[0] if sentences else []
    cut = len(whole) - len(whole) // 3
    return whole[:cut], whole[cut:]


def runs_of(terms: list[str], size: int = RUN) -> set[tuple[str, ...]]:
    size = min(size, len(terms))
    return {tuple(terms[i : i + size]) for i in range(len(terms) - size + 1)} if size else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the runs of a part that the passage has; an empty part is there."""
    wanted = runs_of(part)
    if not wanted:
        return 1.0
    size = len(next(iter(wanted)))
    return len(wanted & {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}) / len(wanted)


@dataclass
class Index:
    """Postings of a shard: items by number, impacts as shares of the item's score for itself."""

    ids: list[int]
    parts: list[tuple[list[str], list[str]]]
    vocabulary: pa.Array
    postings: list[tuple[np.ndarray, np.ndarray]]
    stride: int
    light: np.ndarray = field(init=False)
    light_sum: np.ndarray = field(init=False)
    blocks: list[tuple[list[int], list[float]]] = field(init=False)

    def __post_init__(self) -> None:
        self.light = np.zeros(len(self.postings), bool)
        self.light_sum = np.zeros(len(self.ids))
        for t in sorted(range(len(self.postings)), key=lambda t: -len(self.postings[t][0])):
            items, impacts = self.postings[t]
            if (self.light_sum[items] + impacts).max() <= THRESHOLD / 2:
                self.light_sum[items] += impacts
                self.light[t] = True
        self.blocks = [
            ([int(x[min(i + BLOCK, len(x)) - 1]) for i in range(0, len(x), BLOCK)], [float(y[i : i + BLOCK].max()) for i in range(0, len(x), BLOCK)])
            for x, y in self.postings
        ]
        self.plain = [(x.tolist(), y.tolist()) for x, y in self.postings]
        self.most = [float(y.max()) for _, y in self.postings]
        heavy = [(x, y) if not light else (x[:0], y[:0]) for (x, y), light in zip(self.postings, self.light)]
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x, _ in heavy])]).astype(np.int64)
        self.items = np.concatenate([x for x, _ in heavy] or [np.zeros(0, np.int64)])
        self.impacts = np.concatenate([y for _, y in heavy] or [np.zeros(0)])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose impacts over the distinct ``terms`` reach the threshold."""
        out = []
        need = threshold - 1e-9
        cursors = [[self.plain[t][0][0], 0, t] for t in terms]
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block, last = 0.0, math.inf
            for _, _, t in cursors[: pivot + 1]:
                ends, tops = self.blocks[t]
                k = bisect_left(ends, item)
                if k < len(ends):
                    block += tops[k]
                    last = min(last, ends[k])
            if block >= need:
                if cursors[0][0] == item:
                    score = sum(self.plain[t][1][at] for i, at, t in cursors if i == item)
                    if score >= need:
                        out.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            else:
                goal = last + 1 if last < math.inf else item + 1
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, item + 1)
            kept = []
            for k, cursor in enumerate(cursors):
                if k <= pivot and cursor[0] < goal:
                    items = self.plain[cursor[2]][0]
                    at = bisect_left(items, goal, cursor[1])
                    if at == len(items):
                        continue
                    cursor[0], cursor[1] = items[at], at
                kept.append(cursor)
            cursors = kept


def make_index(rows: list[tuple[int, str]], frequency: dict[str, int], n_items: int, mean_length: float, stride: int) -> Index:
    """The index of some items under the statistics of all."""
    rows = sorted(rows)
    parts = [question_and_answer(text) for _, text in rows]
    terms = [terms_of(text) for _, text in rows]
    entries: dict[str, list[tuple[int, float]]] = {}
    for i, own in enumerate(terms):
        weights = {}
        for t in set(own):
            tf = own.count(t)
            idf = math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5))
            weights[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / mean_length))
        total = sum(weights.values())
        for t, w in weights.items():
            entries.setdefault(t, []).append((i, w / total))
    names = sorted(entries)
    postings = [(np.array([i for i, _ in entries[t]], np.int64), np.array([w for _, w in entries[t]])) for t in names]
    return Index([i for i, _ in rows], parts, pa.array(names, pa.string()), postings, stride)


def leaks_of(index: Index, texts: pa.Array) -> list[tuple[int, int, float, float, float, int]]:
    """(text, item id, best score, question and answer overlap, passages) of the verified items of some texts."""
    flat, begin = split_terms(texts)
    codes = pc.fill_null(pc.index_in(flat, value_set=index.vocabulary), -1).to_numpy().astype(np.int64)
    # passages: every stride a window of two, the last one ends with the text
    count = np.maximum(1, np.ceil(np.diff(begin) / index.stride).astype(np.int64) - 1)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[owner] + nth * index.stride
    stop = np.minimum(start + 2 * index.stride, begin[owner + 1])
    # distinct heavy terms of each passage: a term counts where the passage had none before
    place = np.flatnonzero((codes >= 0) & ~np.append(index.light, True)[codes])
    term = codes[place]
    low, high = np.searchsorted(place, start), np.searchsorted(place, stop)
    sizes = high - low
    passage = np.repeat(np.arange(len(start)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
    keys = np.unique(passage * len(index.postings) + term[at])
    passage, term = keys // len(index.postings), keys % len(index.postings)
    n = index.begin[term + 1] - index.begin[term]
    hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.begin[term], n)
    pair, inverse = np.unique(np.repeat(passage, n) * len(index.ids) + index.items[hit], return_inverse=True)
    sums = np.bincount(inverse, index.impacts[hit], len(pair))
    alive = np.unique(pair[sums + index.light_sum[pair % len(index.ids)] >= THRESHOLD - 1e-9] // len(index.ids))
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for p in alive.tolist():
        own = codes[start[p] : stop[p]]
        words = None
        for item, score in index.search(np.unique(own[own >= 0]).tolist(), THRESHOLD):
            words = words or flat[int(start[p]) : int(stop[p])].to_pylist()
            question, answer = (overlap(part, words) for part in index.parts[item])
            if question >= OVERLAP and answer >= OVERLAP:
                key = (int(owner[p]), index.ids[item])
                old = best.get(key, (0.0, 0.0, 0.0, 0))
                best[key] = (max(old[0], score), max(old[1], question), max(old[2], answer), old[3] + 1)
    return [(*key, *value) for key, value in best.items()]


def item_statistics(items: DataFrame) -> tuple[DataFrame, int, float, int]:
    """Items with terms, document frequencies per term, the mean and the greatest length."""

    def cut(batches):
        for batch in batches:
            flat, begin = split_terms(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["item_id", "text", "terms"])

    rows = items.mapInArrow(cut, "item_id long, text string, terms array<string>").where("size(terms) > 0")
    return write_and_reread(rows, "benchmark-terms")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and test item that it contains: score, question and answer overlap.

    Missing texts contain nothing, and a missing or wordless item is in no
    document.  Items of equal text are all reported.  Rows repeated under one
    doc_id give one row.  Empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = picked(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    rows = item_statistics(items.select(F.col("item_id").cast("long"), "text"))
    total = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.size("terms")).alias("mean"),
        F.max(F.size("terms")).alias("longest"),
        F.sum(F.octet_length("text")).alias("bytes"),
    ).first()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    if not total["n"]:
        return spark.createDataFrame([], schema)
    frequency = rows.select("item_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    shards = max(1, math.ceil(total["bytes"] / SHARD_BYTES))
    texts = picked(docs, "doc_id", "text").select("doc_id", whole_text().alias("text"))
    parts = []
    for shard in range(shards):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        terms = own.select(F.explode("terms").alias("term")).distinct()
        counts = {r["term"]: r["n"] for r in frequency.join(terms, "term").collect()}
        local = [(r["item_id"], r["text"]) for r in own.select("item_id", "text").collect()]
        if not local:
            continue
        held = spark.sparkContext.broadcast(make_index(local, counts, total["n"], total["mean"], total["longest"]))

        def look(batches, held=held):
            for batch in batches:
                ends = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy())
                cuts = [0, *np.flatnonzero(np.diff(ends // BATCH_CHARS) > 0) + 1, len(ends)]
                for low, high in zip(cuts, cuts[1:]):
                    piece = batch.slice(low, high - low)
                    found = leaks_of(held.value, piece.column(1)) if len(piece) else []
                    if found:
                        cols = list(zip(*found))
                        yield pa.RecordBatch.from_arrays(
                            [piece.column(0).take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:5])],
                            ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                        )

        parts.append(texts.mapInArrow(look, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(*[F.round(F.max(c), 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified test item; each row without doc_id is looked up by its own text."""
    key = lookup_key(docs, "text")
    leaks = find_leaks(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, same_key(key, leaks["_leak"]), "left_anti")
