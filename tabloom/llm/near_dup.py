"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimate, verification.

A document is its set of distinct word shingles, each a 64-bit hash.  The first
seven bits choose one of 128 buckets; a bucket keeps its least hash as a
16-bit register of leading zeros and ten mantissa bits.  Documents that share a
band of registers are candidates.  A band is as wide as the similarity allows
for a pair to miss all bands with a probability below 1e-10: four registers and
32 bands at 0.85, three and 43 at 0.80.

Equal sets are one class, and only its smallest doc_id goes on.  In a band a
candidate is compared with two elected members, the one that is central and one
chosen by a hash, so a band of any size gives two pairs per member at most.
Pairs first pass the estimate from registers, corrected for chance collisions,
then are verified on full sets; verified links are contracted to components.

Election leaves links unseen inside a band.  They matter only between members
that are not yet in one component.  In bands that still hold several components,
what is alike by registers across components is joined to clouds, and in a
cloud the members of different components are compared on full sets, block by
block: a task holds two blocks of bounded size, counts common shingles by matrix
products and gives back one link for each two components.  No pairs are written
out.  A band with more than ``BAND_REPS`` members is parted by its neighbours first:
a pair that shares four bands has two of them within ``NEXT_BANDS`` and stays
together.  Short texts fill few bands, so they do not rely on that: their sets meet
by what is left when one or two shingles are taken away, which misses no link.

Nothing about all documents passes through the driver: it sees counts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.bloom import without_most
from tabloom.llm.text import matched, picked, whole_text
from tabloom.session import write_and_reread

SIZE = 5
SIMILARITY = 85  # in hundredths, unless another one is given
BUCKET_BITS = 7
MANTISSA_BITS = 10
BUCKETS = 1 << BUCKET_BITS
MISSED = 1e-10
EMPTY = 0xFFFF
BLOCK_REPS = 256
BAND_REPS = 2048
NEXT_BANDS = 8
DEVIATIONS = 5.0
PIECE_CHARS = 2 << 20
# Odd multipliers that mix 64-bit hashes.
MIX_A, MIX_B, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of texts one after the other, and where each text's begin, with the end.

    A text with fewer words than ``size`` is one shingle of all its words; one
    without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    flat, owner = flat.filter(real), owner.filter(real).to_numpy()
    coded = flat.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = known[coded.indices.to_numpy()] if len(known) else known
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = np.diff(begin)
    # a rolling combination: the shingle at a place is a mix of the words that follow it
    with np.errstate(over="ignore"):
        full = np.maximum(n - size + 1, 0)
        rows = np.repeat(np.arange(len(texts)), full)
        at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(begin[:-1], full)
        value = np.full(len(at), STEP, np.uint64)
        for k in range(size):
            value = mixed(value + words[at + k] * np.uint64(2 * k + 1))
        short = np.flatnonzero((n > 0) & (n < size))
        other = np.full(len(short), STEP, np.uint64)
        for k in range(size):
            live = n[short] > k
            other[live] = mixed(other[live] + words[begin[:-1][short[live]] + k] * np.uint64(2 * k + 1))
        other = mixed(other + n[short].astype(np.uint64))
    rows, value = np.concatenate([rows, short]), np.concatenate([value, other])
    order = np.lexsort((value, rows))
    rows, value = rows[order], value[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (value[1:] != value[:-1])
    rows, value = rows[first], value[first]
    return value, np.searchsorted(rows, np.arange(len(texts) + 1))


def registers(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: a row of 128 per set; EMPTY where a bucket has no hash."""
    rows = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell = rows * BUCKETS + bucket
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # hashes are sorted, so the first of a bucket is its least
    rest = (values[first] << np.uint64(BUCKET_BITS)) | np.uint64((1 << BUCKET_BITS) - 1)
    # leading zeros by the exponent of the top 52 bits, exact for floats
    zeros = 52 - np.frexp((rest >> np.uint64(12)).astype(np.float64))[1].astype(np.int64)
    after = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out = np.full((len(begin) - 1) * BUCKETS, EMPTY, np.uint16)
    out[cell[first]] = ((zeros << MANTISSA_BITS) | after.astype(np.int64)).astype(np.uint16)
    return out.reshape(-1, BUCKETS)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of register rows without the expected chance collisions, and the buckets they rest on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = np.maximum(size_a, size_b) / np.maximum(1, np.minimum(size_a, size_b))
    # the closed form of the expected number of collisions of registers with this mantissa
    chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2 * used / BUCKETS
    return np.clip((equal - chance) / np.maximum(used - chance, 1e-9), 0, 1), used


def band_width(similarity: int) -> int:
    """Registers in a band: the most, four at most, with which a pair at the similarity is not missed."""
    fits = [w for w in range(1, 5) if (1 - (similarity / 100) ** w) ** (BUCKETS // w) < MISSED]
    return max(fits, default=1)


def band_count(similarity: int) -> int:
    return -(-BUCKETS // band_width(similarity))


def band_keys(regs: np.ndarray, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """A hash per band, and whether the band has a hash at all.  The last band may be narrower."""
    width, bands = band_width(similarity), band_count(similarity)
    filled = np.pad(regs, ((0, 0), (0, width * bands - BUCKETS)), constant_values=EMPTY)
    grouped = filled.reshape(len(regs), bands, width)
    packed = np.zeros((len(regs), bands), np.uint64)
    for k in range(width):
        packed = (packed << np.uint64(16)) | grouped[:, :, k].astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = mixed(mixed(packed) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(STEP))
    return keys, (grouped != EMPTY).any(axis=2)


def _pieces(batch: pa.RecordBatch, column: int):
    """Slices of a batch of a bounded number of characters, but at least a row."""
    ends = np.cumsum(pc.utf8_length(batch.column(column)).to_numpy())
    cuts = [0, *np.flatnonzero(np.diff(ends // PIECE_CHARS) > 0) + 1, len(ends)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, da and db (128 bits of the set) and registers of each row."""

    def sign(batches):
        for batch in batches:
            for piece in _pieces(batch, 1):
                values, begin = shingle_sets(piece.column(1))
                regs = registers(values, begin)
                digests = [xxhash.xxh3_128_digest(values[i:j].tobytes()) for i, j in zip(begin, begin[1:])]
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array(np.diff(begin), pa.int64()),
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "da", "db", "regs"],
                )

    rows = picked(docs, "doc_id", "text").select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(sign, f"doc_id {kind_of(docs)}, n_shingles long, da long, db long, regs binary")


def kind_of(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def emissions(reps: DataFrame, similarity: int) -> DataFrame:
    """key, band and rep of every band that holds a hash.

    A set so small that one differing shingle is too much links with nothing
    but its equals, and has no bands.
    """

    def emit(batches):
        for batch in batches:
            keys, real = band_keys(_matrix(batch.column(1)), similarity)
            rows, cols = np.nonzero(real)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[rows, cols].view(np.int64)), pa.array(cols, pa.int32()), batch.column(0).take(pa.array(rows))],
                ["key", "band", "rep"],
            )

    # n / (n + 1) must reach the similarity
    return reps.where(F.col("n_shingles") * (100 - similarity) >= similarity).select("rep", "regs").mapInArrow(emit, "key long, band int, rep long")


def shared_bands(rows: DataFrame) -> DataFrame:
    """The rows (key, rep) of keys with several reps, with two elected reps and the number of reps.

    ``head`` is the rep whose bands hold most reps in all: in a group of copies
    that differ from one document more than their distance to it, that is this
    document.  ``other`` is elected by a hash, and is another one in each band.
    """
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = write_and_reread(matched(rows, counted, "key"), "dedup-several")
    fame = several.groupBy("rep").agg(F.sum("n").alias("fame"))
    ranked = matched(several, fame, "rep")
    elected = ranked.groupBy("key").agg(
        F.max_by("rep", F.col("fame") * 1024 + F.pmod(F.xxhash64("rep"), F.lit(1024))).alias("head"),
        F.min_by("rep", F.xxhash64("key", "rep")).alias("other"),
    )
    return matched(several, elected, "key")


def star_pairs(shared: DataFrame) -> DataFrame:
    pairs = shared.select("rep", F.explode(F.array("head", "other")).alias("to")).where("rep <> to")
    return pairs.select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct()


def likely(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose estimate may still mean a link, by far more than its error."""
    lean = reps.select("rep", "n_shingles", "regs")
    both = pairs
    for side in ("a", "b"):
        both = both.join(lean.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("regs").alias(f"r{side}")), side)
    # sizes alone exclude a pair whose smaller set is too small
    both = both.where(f"100 * least(na, nb) >= {similarity} * greatest(na, nb)").select("a", "b", "na", "nb", "ra", "rb")

    def judge(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            guess, used = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), na, nb)
            j = similarity / 100
            ok = guess >= j - DEVIATIONS * np.sqrt(j * (1 - j) / np.maximum(used, 1))
            yield batch.select([0, 1]).filter(pa.array(ok))

    return both.mapInArrow(judge, "a long, b long")


def set_table(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """rep and set (its hashes) of the ``needed`` reps.  ``texts`` has rep and text."""

    def sets(batches):
        for batch in batches:
            for piece in _pieces(batch, 1):
                values, begin = shingle_sets(piece.column(1))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([values[i:j].tobytes() for i, j in zip(begin, begin[1:])], pa.binary())], ["rep", "set"]
                )

    some = without_most(texts.select("rep", "text"), "rep", needed)
    held = some.join(needed, "rep", "left_semi").select("rep", "text").mapInArrow(sets, "rep long, set binary")
    return write_and_reread(held, "dedup-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("rep").alias(side), F.col("set").alias(f"s{side}")), side)

    def confirm(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                ok.append(100 * common >= similarity * (len(u) + len(v) - common))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """rep and root of every rep with a link, by contraction.

    In a round every node hooks onto the neighbour that comes first, or stays if
    it comes first itself; links between what is left form the next, smaller
    graph.  Nodes with more links come first, so a star is done in one round,
    and among equals the order is a random one that changes with the round, so
    chains shrink by a share in each.
    """
    edges = write_and_reread(links.select("a", "b"), "dedup-links")
    mapping = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("b").agg(F.count(F.lit(1)).alias("links"))

        def place(node: str, links: str) -> Column:
            return F.pmod(F.xxhash64(F.lit(turn), node), F.lit(1 << 40)) - F.least(links, F.lit(1 << 20)) * F.lit(1 << 40)

        ranked = matched(both, degree, "b").withColumn("at", place("b", "links"))
        nearest = ranked.groupBy("a").agg(F.min_by("b", "at").alias("b"), F.min("at").alias("at"), F.count(F.lit(1)).alias("links"))
        first = F.when(F.col("at") < place("a", "links"), F.col("b")).otherwise(F.col("a"))
        hooks = write_and_reread(nearest.select(F.col("a").alias("rep"), first.alias("root")), "dedup-hooks")
        moved = edges
        for side in ("a", "b"):
            moved = moved.join(hooks.select(F.col("rep").alias(side), F.col("root").alias(f"r{side}")), side)
        edges = write_and_reread(
            moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "dedup-links"
        )
        if mapping is None:
            mapping = hooks
        else:
            step = hooks.select(F.col("rep").alias("root"), F.col("root").alias("next"))
            mapping = mapping.join(step, "root", "left").select("rep", F.coalesce("next", "root").alias("root"))
            mapping = write_and_reread(mapping, "dedup-roots")
    return mapping if mapping is not None else edges.select(F.col("a").alias("rep"), F.col("b").alias("root"))


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs``.

    Documents are linked where the shingle sets have at least ``similarity`` hundredths in common;
    component_id is the smallest doc_id reachable, kept whether it is the own
    one.  Null, empty and wordless texts have empty sets and are linked with
    nothing.  Rows repeated under one doc_id are copies and all get its
    component.  Rows without doc_id are linked with nothing: their component is
    null and they are kept.  An empty table gives an empty result.
    """
    signed = write_and_reread(signatures(docs), "dedup-signatures")
    ids = signed.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", "da", "db", "regs")
    worded = ids.where("n_shingles > 0")
    classes = write_and_reread(worded.groupBy("da", "db").agg(F.min("doc_id").alias("rep")), "dedup-classes")
    own = matched(worded, classes, "da", "db").select("doc_id", "rep", "n_shingles", "regs")
    reps = write_and_reread(own.where("doc_id = rep").drop("doc_id").dropDuplicates(["rep"]), "dedup-reps")
    texts = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("rep"), whole_text().alias("text"))
    roots = link_classes(reps, texts, similarity)
    # the smallest doc_id of a component is the smallest of its representatives
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    named = matched(roots, least, "root").select("rep", "least")
    found = matched(worded.select("doc_id", "n_shingles", "da", "db"), classes, "da", "db").join(named, "rep", "left")
    linked = found.select("doc_id", "n_shingles", F.coalesce("least", "rep").alias("component_id"))
    bare = ids.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    lost = signed.where("doc_id IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = linked.unionByName(bare).unionByName(lost)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def link_classes(reps: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """rep and root of the classes that have a link."""
    shared = write_and_reread(shared_bands(emissions(reps, similarity)), "dedup-bands")
    close = write_and_reread(likely(star_pairs(shared), reps, similarity), "dedup-likely")
    if close.isEmpty():
        stars, roots = close, close.select(F.col("a").alias("rep"), F.col("b").alias("root"))
    else:
        needed = write_and_reread(close.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "dedup-needed")
        stars = write_and_reread(verified(close, set_table(texts, needed), similarity), "dedup-stars")
        roots = components(stars)
    # a band that holds several components may hide a link between them
    edges = write_and_reread(cloud_edges(shared.select("key", "band", "rep"), roots, reps, texts, similarity).distinct(), "dedup-open")
    if edges.isEmpty():
        return roots
    clouds = components(edges).withColumnRenamed("root", "cloud")
    members = write_and_reread(_labelled(clouds, roots), "dedup-clouds")
    crossing = write_and_reread(cross_links(members, reps, texts, similarity), "dedup-crossing")
    return roots if crossing.isEmpty() else components(stars.select("a", "b").union(crossing))


def _open(rows: DataFrame) -> DataFrame:
    """The rows (key, band, rep, root) of keys that hold several roots, with the number of the key's rows."""
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    return matched(rows, several.where("low < high").select("key", "n"), "key")


def cloud_edges(shared: DataFrame, roots: DataFrame, reps: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that join all pairs of different components whose registers are alike enough for a link.

    A task looks at one band, or at two parts of one, and gives back a spanning
    forest of its pairs, not the pairs.  A band with more than ``BAND_REPS``
    members is first refined by the bands next to it, twice, which parts what
    has little in common; what is still larger is looked at in parts.  Short
    sets of such bands are joined by `short_edges`.
    """
    rows = write_and_reread(_open(_labelled(shared, roots)), "dedup-rows")
    lean = reps.select("rep", "regs")
    parts = []
    for depth in range(3):
        fits = rows.where(F.col("n") <= BAND_REPS) if depth < 2 else rows
        split = F.ceil(F.col("n") / BAND_REPS).cast("int")
        mine = F.pmod(F.xxhash64("rep"), split).cast("int")
        ranged = fits.select("key", "rep", "root", mine.alias("own"), F.explode(F.sequence(F.lit(0), split - 1)).alias("with"))
        dealt = matched(
            ranged.select(F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("task"), "rep", "root"), lean, "rep"
        )
        parts.append(dealt.repartition("task").sortWithinPartitions("task").select("task", "rep", "root", "regs").mapInArrow(_spanning(similarity), "a long, b long"))
        large = rows.where(F.col("n") > BAND_REPS)
        if depth == 2 or large.isEmpty():
            break
        if depth == 0:
            parts.append(short_edges(large, reps, texts, similarity))
        some = reps.join(large.select("rep").distinct(), "rep", "left_semi")
        near = emissions(some, similarity).select(F.col("key").alias("key2"), F.col("band").alias("band2"), "rep")
        finer = large.join(near, "rep").where(f"pmod(band2 - band, {band_count(similarity)}) BETWEEN 1 AND {NEXT_BANDS}")
        rows = write_and_reread(
            _open(finer.select(F.xxhash64("key", "key2").alias("key"), F.col("band2").alias("band"), "rep", "root")), "dedup-rows"
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def short_limit(similarity: int) -> int:
    """The most shingles of a set that can lose two of them, but not three, and still be similar enough."""
    return -(-300 // (100 - similarity)) - 1


def short_edges(rows: DataFrame, reps: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that join all linked pairs of short sets among the reps of ``rows``.

    Two sets with the common part K and a and b more shingles are linked where K / (K + a + b) is large
    enough, so both meet under K, and there the one with the fewest more is linked with all that are linked
    with any: one pair per member joins them.
    """
    lean = reps.where(F.col("n_shingles") <= short_limit(similarity)).select("rep")
    needed = write_and_reread(lean.join(rows.select("rep").distinct(), "rep", "left_semi"), "dedup-needed")

    def rests(batches):
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part, out = batch.slice(begin, 256), []
                for rep, raw in zip(part.column(0).to_pylist(), part.column(1)):
                    values = np.frombuffer(raw.as_buffer(), np.uint64)
                    for gone in range((100 - similarity) * len(values) // 100 + 1):
                        for less in combinations(range(len(values)), gone):
                            rest = xxhash.xxh3_128_digest(np.delete(values, less).tobytes())
                            out.append((rest, rep, len(values) - gone, gone))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["rest", "rep", "left", "gone"])

    met = write_and_reread(set_table(texts, needed).mapInArrow(rests, "rest binary, rep long, left long, gone long"), "dedup-rests")
    heads = met.groupBy("rest").agg(F.min(F.struct("gone", "rep")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = matched(met, heads.select("rest", "head"), "rest")
    linked = both.where(f"rep <> head.rep AND 100 * left >= {similarity} * (left + gone + head.gone)")
    return linked.select(F.least("rep", "head.rep").alias("a"), F.greatest("rep", "head.rep").alias("b"))


def _spanning(similarity: int):
    """Spanning forests of the alike pairs across roots, of rows (task, rep, root, regs) in the order of tasks."""
    share = similarity / 100

    def forest(rep: np.ndarray, root: np.ndarray, regs: np.ndarray) -> list[tuple[int, int]]:
        parent = list(range(len(rep)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        live = regs != EMPTY
        for begin in range(0, len(rep), 64):
            part = slice(begin, begin + 64)
            equal = ((regs[part, None, :] == regs[None, begin:, :]) & live[part, None, :]).sum(axis=2)
            used = (live[part, None, :] | live[None, begin:, :]).sum(axis=2)
            alike = equal >= used * share - DEVIATIONS * np.sqrt(share * (1 - share) * used)
            alike &= root[part, None] != root[None, begin:]
            for i, j in zip(*np.nonzero(alike)):
                x, y = top(begin + int(i)), top(begin + int(j))
                if x != y:
                    parent[y] = x
                    out.append((int(rep[begin + i]), int(rep[begin + j])))
        return out

    def finish(table: pa.Table) -> pa.RecordBatch:
        task = table.column("task").to_numpy()
        rep, root = table.column("rep").to_numpy(), table.column("root").to_numpy()
        regs = _matrix(table.column("regs"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
        out = [e for i, j in zip(cuts, cuts[1:]) for e in forest(rep[i:j], root[i:j], regs[i:j])]
        return pa.RecordBatch.from_arrays([pa.array([min(e) for e in out], pa.int64()), pa.array([max(e) for e in out], pa.int64())], ["a", "b"])

    def spanning(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            task = table.column("task").to_numpy()
            whole = int(np.searchsorted(task, task[-1]))  # the last task may go on in the next batch
            if whole:
                yield finish(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield finish(pa.Table.from_batches(held))

    return spanning


def cross_links(members: DataFrame, reps: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Links between components of a cloud: (a, b), one for each two components of each two blocks.

    ``members`` has rep, cloud and root.  A cloud is cut into blocks of about
    ``BLOCK_REPS`` by component, size and hash; small components lie together.
    Two blocks meet in a task if their sizes allow a link and they are not of
    one component, and the task counts the common shingles of all pairs of the
    two as products of incidence matrices.
    """
    sized = matched(members, reps.select("rep", "n_shingles"), "rep")
    whole = sized.groupBy("cloud", "root").agg(F.count(F.lit(1)).alias("of_root"))
    step = float(-np.log(similarity / 100))
    graded = matched(sized, whole, "cloud", "root").select(
        "rep",
        "cloud",
        "root",
        F.when(F.col("of_root") < BLOCK_REPS, F.lit(-1).cast("long")).otherwise(F.col("root")).alias("own"),
        F.floor(F.log("n_shingles") / F.lit(step)).cast("int").alias("grade"),
    )
    keys = ("cloud", "own", "grade")
    filled = graded.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_REPS).cast("int").alias("parts"))
    blocks = filled.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn(
        "block", F.xxhash64(*keys, "part")
    )
    other = blocks.select("cloud", *[F.col(c).alias(f"{c}2") for c in ("own", "grade", "block")])
    meets = blocks.join(other, "cloud").where(
        "block <= block2 AND abs(grade - grade2) <= 1 AND (own = -1 OR own2 = -1 OR own <> own2)"
    )
    ends = meets.select(
        F.xxhash64("block", "block2").alias("meet"),
        F.explode(
            F.expr("filter(array(struct(block AS block, 0 AS side), struct(block2 AS block, 1 AS side)), x -> x.side = 0 OR block <> block2)")
        ).alias("end"),
    ).select("meet", "end.block", "end.side")
    placed = (
        matched(graded, filled, *keys)
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .select("rep", "root", F.xxhash64(*keys, "part").alias("block"))
    )
    rows = placed.join(ends, "block").join(set_table(texts, members.select("rep")), "rep")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep, root = table.column("rep").to_numpy(), table.column("root").to_numpy()
        values = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        right = right if len(right) else left  # a block that meets itself
        common = common_counts([values[i] for i in left], [values[i] for i in right])
        size = np.array([len(v) for v in values])
        union = size[left][:, None] + size[right][None, :] - common
        i, j = np.nonzero((100 * common >= similarity * union) & (root[left][:, None] != root[right][None, :]))
        found = {}
        for x, y in zip(left[i].tolist(), right[j].tolist()):
            found.setdefault((min(root[x], root[y]), max(root[x], root[y])), (min(rep[x], rep[y]), max(rep[x], rep[y])))
        return pa.table({c: pa.array([p[k] for p in found.values()], pa.int64()) for k, c in enumerate("ab")})

    return rows.select("meet", "side", "rep", "root", "set").groupBy("meet").applyInArrow(compare, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists."""
    out = np.zeros((len(left), len(right)), np.float64)
    flat = np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(v) for v in (*left, *right)])
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    many = often > 1  # what only one set has is common to none
    live = many[code]
    owner, code = owner[live], (np.cumsum(many) - 1)[code[live]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    edges = np.searchsorted(code, np.arange(0, int(many.sum()) + width, width))
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        has = np.zeros((len(left) + len(right), width), np.float32)
        has[owner[low:high], code[low:high] - k * width] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out.astype(np.int64)


def keep_first(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row of its smallest doc_id.

    Of rows repeated under one doc_id one stays; rows without doc_id all stay.
    """
    kept = near_duplicates(docs, similarity).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    some = docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    return some.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id IS NULL"))
