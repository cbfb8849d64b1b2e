"""Fill-in-the-middle forms of documents.

Each batch goes through one pyarrow pipeline: texts are split into list arrays
of code points, the lists are flattened with the row each unit comes from, the
ordinal of a unit in its text decides its role, units are filtered by role, the
lists are rebuilt per row and joined into the three pieces.

A lot holds at most ``LOT_BYTES`` bytes of text, since the flat arrays take some
thirty times that; a longer text goes through in slices, which are put
together piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.text import lots, picked, whole_text

LOT_BYTES = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values: the marks
MARK = "<P>|<S>|<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of seed and doc_id; a missing doc_id counts as nothing written."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, suffix_first_below: int = 20) -> DataFrame:
    """Every text with its middle moved to the end.

    Two draws cut a text of n code points into prefix, middle and suffix; a
    third leaves it plain from ``plain_from`` percent on, and a fourth puts the
    suffix first below ``suffix_first_below`` percent.  Texts that hold a mark
    stay plain, so every output can be turned back.

    Returns doc_id, n, form (plain, psm or spm), prefix_chars and middle_chars
    (null if plain) and output, one row per row.  A missing text is the empty
    text, which is plain.  Repeated rows give repeated results, an empty table
    none; further columns are left aside.
    """
    text = whole_text()
    first, second, third, fourth = draws(F.col("doc_id"), seed)
    units = F.length(text).cast("long")
    plain = (text == "") | text.rlike(MARK) | (third % 100 >= plain_from)
    source = picked(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        units.alias("n"),
        F.when(plain, "plain").when(fourth % 100 < suffix_first_below, "spm").otherwise("psm").alias("form"),
        F.least(first % (units + 1), second % (units + 1)).alias("low"),
        F.greatest(first % (units + 1), second % (units + 1)).alias("high"),
    )
    return source.mapInArrow(_rearranged, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of, from the output and its form alone."""
    part = F.split(output, MARK)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def _rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lot in lots(batch, LOT_BYTES):
            yield _lot_output(lot)


def _lot_output(lot: pa.RecordBatch) -> pa.RecordBatch:
    text, form = lot.column("text").cast(pa.large_string()), lot.column("form")
    low, high = lot.column("low"), lot.column("high")
    plain = pc.equal(form, "plain")
    if lot.num_rows == 1 and text.nbytes > LOT_BYTES and not plain[0].as_py():
        prefix, middle, suffix = _long_pieces(text[0].as_py(), low, high)
    else:
        prefix, middle, suffix = pieces(text, low, high)
    marks = [pa.scalar(m, pa.large_string()) for m in (PREFIX, SUFFIX, MIDDLE, "")]
    psm = pc.binary_join_element_wise(marks[0], prefix, marks[1], suffix, marks[2], middle, marks[3])
    spm = pc.binary_join_element_wise(marks[1], suffix, marks[0], prefix, marks[2], middle, marks[3])
    output = pc.if_else(plain, text, pc.if_else(pc.equal(form, "spm"), spm, psm))
    none = pa.scalar(None, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            lot.column("doc_id"),
            lot.column("n"),
            form,
            pc.if_else(plain, none, low),
            pc.if_else(plain, none, pc.subtract(high, low)),
            output.cast(pa.string()),
        ],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def units_of(text: pa.Array) -> pa.ListArray:
    """A list of code points per text.

    A unit starts at each byte that does not carry on a code point, so the
    units share the bytes of the texts.
    """
    offsets = pa.Array.from_buffers(pa.int64(), len(text) + 1, [None, text.buffers()[1]], offset=text.offset)
    begin, end = offsets[0].as_py(), offsets[-1].as_py()
    data = text.buffers()[2] or pa.py_buffer(b"")
    data = data.slice(begin, end - begin)
    offsets = pc.subtract(offsets, begin)
    bits = pc.bit_wise_and(pa.Array.from_buffers(pa.uint8(), end - begin, [None, data]), pa.scalar(0xC0, pa.uint8()))
    starts = pc.indices_nonzero(pc.not_equal(bits, pa.scalar(0x80, pa.uint8()))).cast(pa.int64())
    borders = pa.concat_arrays([starts, pa.array([end - begin], pa.int64())])
    units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, borders.buffers()[1], data])
    rows = pa.array(borders.to_numpy().searchsorted(offsets.to_numpy()), pa.int64())
    return pa.LargeListArray.from_arrays(rows, units)


def pieces(text: pa.Array, low: pa.Array, high: pa.Array, passed: int = 0) -> list[pa.Array]:
    """Prefix, middle and suffix of each text; ``passed`` units of it came before."""
    lists = units_of(text)
    units, row = lists.flatten(), pc.list_parent_indices(lists)
    starts = lists.offsets[:-1]
    ordinal = pc.subtract(_counted(len(units)), starts.take(row))
    if passed:
        ordinal = pc.add(ordinal, passed)
    in_prefix = pc.less(ordinal, low.take(row))
    in_suffix = pc.greater_equal(ordinal, high.take(row))
    roles = (in_prefix, pc.invert(pc.or_(in_prefix, in_suffix)), in_suffix)
    return [_joined(units, row, role, len(text)) for role in roles]


def _counted(n: int) -> pa.Array:
    return pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), n), start=-1)


def _joined(units: pa.Array, row: pa.Array, role: pa.Array, rows: int) -> pa.Array:
    """The units of one role, as one string per row."""
    kept = row.filter(role)
    borders = kept.to_numpy().searchsorted(range(rows + 1))  # rows ascend, so a list ends where the next row begins
    lists = pa.LargeListArray.from_arrays(pa.array(borders, pa.int64()), units.filter(role))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


def _long_pieces(text: str, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    parts: list[list[str]] = [[], [], []]
    step = LOT_BYTES // 4  # a code point takes four bytes at most
    for passed in range(0, len(text), step):
        found = pieces(pa.array([text[passed : passed + step]], pa.large_string()), low, high, passed)
        for part, piece in zip(parts, found, strict=True):
            part.append(piece[0].as_py())
    return [pa.array(["".join(p)], pa.large_string()) for p in parts]
