"""Repeated byte strings: every byte under a string of at least ``LENGTH`` bytes that starts elsewhere too.

Equal strings must meet, wherever they stand.  Each window of ``LENGTH`` bytes
names an anchor, the k-gram in it with the least hash (leftmost of equals), so
equal windows name equal anchors at equal places.  The windows of a text that
share an anchor form a context: one run of starts, and the bytes they cover.
Anchors that occur once are dropped, contexts that occur twice as a whole are
repeated as a whole, and what remains are the contexts at the rims of repeats.
These are cut into cells of starts, aligned at the anchor; all windows of a cell
have a core in common, and only contexts with equal cores can hold equal
windows.

The contexts that share cores are searched by a Burrows-Wheeler transform.
Breadth-first backward extension visits intervals of suffixes by increasing
length of their common prefix: an interval of w gives one of cw for every byte c
before it, and the first to reach a right border fixes the common prefix there.
It stops at ``LENGTH``.  Borders that were never reached have longer common
prefixes: their suffixes are the repeated windows.

A core that more than ``GROUP`` different contexts share (a passage in a third
of all documents) never comes into one task: such contexts are cut into smaller
cells, down to single windows, which are equal or not, and counting is all that
is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.text import matched, picked, whole_text
from tabloom.session import release, write_and_reread

LENGTH = 400
GRAM = 64
CELLS = (32, 8, 1)
GROUP = 64
OUTPUT_BYTES = 1 << 20  # bytes of pieces in one batch that a task hands on
SEARCH_BYTES = 1 << 20
CHUNK = 1 << 21  # bytes of text in one go; places take PLACE_BITS bits
PLACE_BITS = 22
# Odd multipliers of the rolling hash and its mixer.
BASE, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each place on."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX_B)
        power, size = BASE, 1
        while size < gram:
            h = h[:-size] * np.uint64(power) + h[size:]
            power = power * power % 2**64
            size *= 2
        h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX_A)
        return h ^ (h >> np.uint64(32))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    size, m = 1, values
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def contexts_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of the anchors of one text, and the first and last start of the windows that name each."""
    found = []
    for begin in range(0, max(1, len(data) - length + 1), CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        if len(part) < length:
            break
        h = gram_hashes(part, gram)
        keys = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        at = (least(keys, length - gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        change = np.flatnonzero(np.diff(at)) + 1
        low = np.concatenate([[0], change])
        high = np.concatenate([change - 1, [len(at) - 1]])
        found.append((h[at[low]], at[low] + begin, low + begin, high + begin))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def digest(raw: bytes) -> tuple[int, int]:
    a = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(a[:8], "little", signed=True), int.from_bytes(a[8:], "little", signed=True)


def _bytes_of(column: pa.Array):
    """The bytes of each text of a column, without decoding."""
    for x in column.cast(pa.binary()):
        yield np.frombuffer(x.as_buffer(), np.uint8)


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """A row per context of each text (id, text): anchor hash, first and last start, their places from the anchor, digest."""

    def cut(batches):
        for batch in batches:
            ids, cols = [], []
            names = batch.column(0).to_pylist()
            for name, data in zip(names, _bytes_of(batch.column(1))):
                g, at, low, high = contexts_of(data, length)
                raw = data.tobytes()
                sums = b"".join(xxhash.xxh3_128_digest(raw[i : j + length]) for i, j in zip(low.tolist(), high.tolist()))
                halves = np.frombuffer(sums, np.int64).reshape(-1, 2)
                ids += [name] * len(g)
                cols.append((g.view(np.int64), low, high, at, halves[:, 0], halves[:, 1]))
            if ids:
                arrays = [pa.array(np.concatenate(c)) for c in zip(*cols)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], ["id", "g", "low", "high", "at", "ca", "cb"])

    return texts.mapInArrow(cut, "id long, g long, low long, high long, at long, ca long, cb long")


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by prefix doubling."""
    n = len(s)
    bits = int(s.max()).bit_length()
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] |= s[k:]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all() or step >= depth:
            return order
        key = rank * (n + 1)
        key[: max(0, n - step)] += rank[step:]
        step *= 2


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which starts of windows of ``length`` bytes have an equal window among all pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum())
    s = np.empty(n, np.int64)
    marks = np.ones(n, bool)
    marks[begin + sizes] = False
    s[marks] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + len(pieces) + 1
    s[~marks] = np.arange(1, len(pieces) + 1)  # each piece ends in a symbol of its own
    order = suffix_order(s, length)
    before = np.where(order > 0, s[order - 1], 0)  # the transform; the first suffix has nothing before it
    # LF: where the suffix that is longer by the symbol before goes
    stable = np.argsort(before.astype(np.uint16) if before.max() < 1 << 16 else before, kind="stable")
    lf = np.empty(n, np.int64)
    lf[stable] = np.arange(n)
    # the last and the next place with the same symbol
    same = before[stable[1:]] == before[stable[:-1]]
    prev, following = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    prev[stable[1:][same]] = stable[:-1][same]
    following[stable[:-1][same]] = stable[1:][same]
    plain = before > len(pieces)  # extension across the end of a piece is none
    fixed = np.zeros(n + 1, bool)
    fixed[[0, n]] = True
    # intervals of single symbols, the ends of pieces included: their borders have no common prefix
    first = s[order]
    edges = np.flatnonzero(first[1:] != first[:-1]) + 1
    fixed[edges] = True
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
    for _ in range(1, length):
        size = ends - starts
        owner = np.repeat(np.arange(len(starts)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[owner]
        at_plain = plain[at]
        low = lf[at[at_plain & (prev[at] < starts[owner])]]
        high = lf[at[at_plain & (following[at] >= ends[owner])]] + 1
        low.sort()
        high.sort()
        fresh = ~fixed[high]
        starts, ends = low[fresh], high[fresh]
        fixed[ends] = True
        if not len(starts):
            break
    # a border never reached lies between suffixes with at least ``length`` symbols in common
    repeated = np.zeros(n, bool)
    equal = np.flatnonzero(~fixed[1:n]) + 1
    repeated[order[equal]] = True
    repeated[order[equal - 1]] = True
    return [repeated[b : b + max(0, m - length + 1)] for b, m in zip(begin.tolist(), sizes.tolist())]


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


PIECE = "id long, low long, high long, at long, raw binary, done boolean"


CELL = PIECE + ", ka long, kb long, ca long, cb long"


def _in_lots(rows: Iterator[tuple], schema: str, raw: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``OUTPUT_BYTES``; field ``raw`` holds the bytes."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [part.split() for part in schema.split(", ")]
    held, size = [], 0

    def made():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*held), fields)], [name for name, _ in fields]
        )

    for row in rows:
        held.append(row)
        size += len(row[raw]) + 8 * len(row)
        if size >= OUTPUT_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _cells(pieces: DataFrame, size: int, length: int, reach: int) -> DataFrame:
    """Pieces cut into cells of ``size`` starts aligned at the anchor, with digests of the core and of the piece."""

    def cut(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for name, low_, high_, at, raw_, done in (tuple(c[k].as_py() for c in columns) for k in range(batch.num_rows)):
                for cell in range((low_ - at + reach) // size, (high_ - at + reach) // size + 1):
                    c0 = at + cell * size - reach  # starts of the whole cell
                    low, high = max(low_, c0), min(high_, c0 + size - 1)
                    raw = raw_[low - low_ : high - low_ + length]
                    core = raw[c0 + size - 1 - low : c0 - low + length]
                    ka, kb = digest(core + cell.to_bytes(4, "little"))
                    ca, cb = digest(raw + (low - at).to_bytes(4, "little", signed=True))
                    yield name, low, high, at, raw, done, ka, kb, ca, cb

    return pieces.mapInArrow(lambda batches: _in_lots(cut(batches), CELL, 4), CELL)


def _classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and context: how often it occurs and its elected row; per key: how many different ones and rows in all."""
    one = rows.groupBy(*keys, "ca", "cb").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("id", "low"), F.xxhash64("id", "low")).alias("head")
    )
    return one.select(*keys, "ca", "cb", "n", F.col("head.id").alias("head_id"), F.col("head.low").alias("head_low"))


def _search(rows: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts of pieces that share cores, by the transform: rows come in the order of their key."""

    def look(batches):
        held, size, last = [], 0, None

        def flush():
            marks = repeated_starts([h["raw"] for h in held], length)
            out = [(h["id"], h["low"] + i, h["low"] + j) for h, m in zip(held, marks) if not h["done"] for i, j in runs(m)]
            cols = list(zip(*out)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "low", "high"])

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["ka"], r["kb"])
                if size >= SEARCH_BYTES and key != last:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r["raw"])
                last = key
        if held:
            yield flush()

    return rows.mapInArrow(look, "id long, low long, high long")


def repeated_runs(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, low and high: runs of starts of repeated windows of the texts (id, text), whose ids are unique.

    Tables on the way are let go as soon as all that needs them is written.
    """
    found = write_and_reread(anchors(texts, length), "suffix-anchors")
    several = found.groupBy("g").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("g")
    open_ = write_and_reread(matched(found, several, "g"), "suffix-shared")
    release(found)
    classes = write_and_reread(_classes(open_, ["g"]), "suffix-classes")
    kinds = classes.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"))
    known = classes.join(kinds, "g").where("n > 1 OR kinds > 1")
    judged = write_and_reread(matched(open_, known, "g", "ca", "cb"), "suffix-judged")
    release(open_)
    release(classes)
    done = [write_and_reread(judged.where("n > 1").select("id", "low", "high"), "suffix-found")]
    rims = judged.where("kinds > 1 AND (n = 1 OR (id = head_id AND low = head_low))").select(
        "id", "low", "high", "at", (F.col("n") > 1).alias("done")
    )
    pieces, sources = _with_bytes(rims, texts, length), [judged]
    reach = 1 << (length - 1).bit_length()
    for size in CELLS:
        cells = write_and_reread(_cells(pieces, size, length, reach), "suffix-cells")
        for table in sources:
            release(table)
        one = write_and_reread(_classes(cells, ["ka", "kb"]), "suffix-classes")
        many = one.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("kinds"))
        known = one.join(many, ["ka", "kb"]).where("n > 1 OR kinds > 1")
        met = write_and_reread(matched(cells.drop("raw"), known, "ka", "kb", "ca", "cb"), "suffix-met")
        release(one)
        done.append(write_and_reread(met.where("n > 1 AND NOT done").select("id", "low", "high"), "suffix-found"))
        left = met.where("kinds > 1 AND (n = 1 OR (id = head_id AND low = head_low))").select(
            "id", "low", "at", "ka", "kb", "kinds", (F.col("done") | (F.col("n") > 1)).alias("over")
        )
        raw = cells.select("id", "low", "at", "high", "raw")
        full = left.join(raw, ["id", "low", "at"])
        few = full.where(F.col("kinds") <= GROUP)
        dealt = few.select("id", "low", "raw", F.col("over").alias("done"), "ka", "kb").repartition("ka", "kb").sortWithinPartitions("ka", "kb")
        done.append(write_and_reread(_search(dealt, length), "suffix-found"))
        many_kinds = full.where(F.col("kinds") > GROUP)
        sources = [cells, met]
        if size == 1 or many_kinds.isEmpty():
            break
        pieces = many_kinds.select("id", "low", "high", "at", "raw", F.col("over").alias("done"))
    for table in sources:
        release(table)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _with_bytes(rims: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each rim context, cut from its text."""
    lists = rims.groupBy("id").agg(F.collect_list(F.struct("low", "high", "at", "done")).alias("own"))

    def cut(batches):
        for batch in batches:
            for k, data in enumerate(_bytes_of(batch.column(1))):
                name = batch.column(0)[k].as_py()
                for x in batch.column(2)[k].as_py():
                    yield name, x["low"], x["high"], x["at"], data[x["low"] : x["high"] + length].tobytes(), x["done"]

    joined = texts.join(lists, "id").select("id", "text", "own")
    return joined.mapInArrow(lambda batches: _in_lots(cut(batches), PIECE, 4), PIECE)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes of each row of ``docs``.

    Texts are UTF-8 bytes, and a missing text has none.  What is repeated is
    judged on the input, so all copies lose it.  Every row stands for itself,
    whatever its doc_id: rows under one doc_id or without one are judged like any
    other two.  An empty table gives an empty result.
    """
    own = picked(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")
    )
    rows = write_and_reread(own, "suffix-texts")  # so that a row has the same number in every pass
    found = repeated_runs(rows.select("id", "text"), length)
    spans = found.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def remove(batches):
        for batch in batches:
            for k, data in enumerate(_bytes_of(batch.column(1))):
                edge = np.zeros(len(data) + 1, np.int32)
                for x in batch.column(2)[k].as_py() or ():
                    edge[x["low"]] += 1
                    edge[x["high"] + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                yield batch.column(0)[k].as_py(), len(data), int(gone.sum()), len(runs(gone)), data[~gone].tobytes()

    joined = rows.join(spans, "id", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(lambda batches: _in_lots(remove(batches), schema, 4), schema)
