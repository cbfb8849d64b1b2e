"""Secret scans: a battery of randomness tests over long tokens, with false-discovery control.

A candidate is a token of at least ``MIN_LENGTH`` code characters outside the
spans of the base rules; in ``NAME=value`` name and value are tokens of their
own.  Its encoding (hex, base32, base36, base62, base64) is
inferred from its characters.  A secret must look uniform: chi-squared over the
encoding's alphabet, Wald-Wolfowitz runs about the middle of the alphabet and
lag-one serial correlation are combined by Fisher's method, and a token that
they refuse is none.

Not being refused is little evidence for a short token.  So each candidate also
gets a p-value for "this is ordinary text": the likelihood ratio of uniform
characters against letter frequencies has mean 1 under ordinary text, so one
over the ratio bounds the p-value by Markov's inequality.  It falls with every
further character, which makes it aware of length.  The Benjamini-Hochberg
cut over the candidates of the whole corpus then holds the share of false
discoveries at ``FDR``; it needs only counts of p-values by class.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.spans import SPAN_TYPE, overlaps
from tabloom.llm.text import picked, whole_text
from tabloom.session import write_and_reread

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH = 16
UNIFORM_LEVEL = 0.005
FDR = 0.01
CLASSES_PER_10 = 8  # classes of p-values per factor ten
LAST_CLASS = 2400  # p below 1e-300: one class

# The patterns of the base rules.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# '=' only pads the end of a token: before more code characters it parts a name from a value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}+(?:=+(?![A-Za-z0-9+/_=-]))?" % MIN_LENGTH)

# Per mille of the letters a to z in English text, rounded.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ENCODINGS = (
    DIGITS + LOWER[:6],
    DIGITS + UPPER[:6],
    UPPER + "234567",
    LOWER,
    DIGITS + LOWER,
    DIGITS + UPPER,
    UPPER + LOWER + DIGITS,
    UPPER + LOWER + DIGITS + "+/",
    UPPER + LOWER + DIGITS + "-_",
    UPPER + LOWER + DIGITS + "+/-_",
)
_total = sum(LETTERS)
ORDINARY = {c: 0.88 * n / _total for c, n in zip(LOWER, LETTERS)}
ORDINARY |= {c: 0.05 * n / _total for c, n in zip(UPPER, LETTERS)}
ORDINARY |= {c: 0.05 / 10 for c in DIGITS} | {c: 0.02 / 5 for c in "+/_-="}
SHOUTED = {c.swapcase(): p for c, p in ORDINARY.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules."""
    found = []
    if ":" in text or "=" in text:
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that has all characters of a token; None for numbers."""
    have = set(token)
    if have <= set(DIGITS):
        return None
    return next((a for a in ENCODINGS if have <= set(a)), None)


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniform_p(token: str, alphabet: str) -> float:
    """Fisher's combination of the three tests of uniformity."""
    n, k = len(token), len(alphabet)
    at = [alphabet.index(c) for c in token]
    counts: dict[int, int] = {}
    for x in at:
        counts[x] = counts.get(x, 0) + 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    # Wilson and Hilferty: the cube root is nearly normal
    spread = 2 / (9 * (k - 1))
    p_chi = 0.5 * math.erfc(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))
    high = [2 * x >= k for x in at]
    ups = sum(high)
    downs = n - ups
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 1 + 2 * ups * downs / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = _tail((runs - mean) / math.sqrt(var)) if var > 0 else 2.0 ** (1 - n)
    middle = sum(at) / n
    power = sum((x - middle) ** 2 for x in at)
    serial = sum((x - middle) * (y - middle) for x, y in zip(at, at[1:])) / power if power else 1.0
    p_serial = _tail((serial + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def ordinary_p(token: str, alphabet: str) -> float:
    """Log10 of the bound of the p-value for ordinary text, in lower or upper case."""
    ratio = min(sum(math.log10(1 / len(alphabet) / model[c]) for c in token) for model in (ORDINARY, SHOUTED))
    return -max(0.0, ratio)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, class) of the tokens that get a p-value; class -1 where the battery refuses one."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m.group().rstrip("=")
        alphabet = encoding_of(token)
        if alphabet is None or overlaps(m.start(), m.end(), base):
            continue
        grade = min(LAST_CLASS, int(-ordinary_p(token, alphabet) * CLASSES_PER_10))
        if grade and uniform_p(token, alphabet) < UNIFORM_LEVEL:
            grade = -1
        out.append((m.start(), m.end(), grade))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and graded candidates of each row of ``docs``."""

    def judge(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        graded = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("grade", pa.int32())]))
        for batch in batches:
            bases, cands = [], []
            for text in batch.column(1):
                base = base_spans(whole := text.as_py())
                bases.append([dict(zip(("kind", "start", "end"), x)) for x in base])
                cands.append([dict(zip(("start", "end", "grade"), x)) for x in candidates(whole, base)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bases, kind), pa.array(cands, graded)], ["doc_id", "base", "cands"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, base {SPAN_TYPE}, cands array<struct<start:int,end:int,grade:int>>"
    return picked(docs, "doc_id", "text").select("doc_id", whole_text().alias("text")).mapInArrow(judge, schema)


def discovery_cut(counts: dict[int, int], fdr: float = FDR) -> int:
    """The least class that Benjamini and Hochberg's rule accepts; above all classes where there is none."""
    total = sum(counts.values())
    above, cut = 0, LAST_CLASS + 1
    for grade in sorted((g for g in counts if g > 0), reverse=True):
        above += counts[grade]
        if 10 ** (-grade / CLASSES_PER_10) * total <= fdr * above:
            cut = grade
    return cut


def secret_spans(docs: DataFrame) -> DataFrame:
    """Each row's base spans and all its spans, with offsets in code points.

    A missing text is the empty one and has no spans.  Texts of any length are
    scanned whole.  Repeated rows get the same spans and each counts as a
    candidate of its own.  An empty table gives an empty result.
    """
    scanned = write_and_reread(scan(docs), "secret-scan")
    grades = scanned.select(F.explode("cands.grade").alias("grade")).groupBy("grade").count().collect()
    cut = discovery_cut({r["grade"]: r["count"] for r in grades})
    found = F.transform(
        F.filter("cands", lambda x: x["grade"] >= cut),
        lambda x: F.struct(F.lit(3).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    return scanned.select("doc_id", "base", F.concat("base", found).alias("spans"))
