"""Personal data: base rules, and a semi-Markov conditional random field over candidate segments.

The base rules find well-formed e-mail addresses, IP addresses, card and phone
numbers.  The field adds spans that are like them without being well formed.
It scores whole segments, so its features can ask what no token can tell: how
many digits a segment has in all, whether they pass Luhn, how it is built, what
stands around it.  A further weight for each two kinds says how likely one follows the
other as the next entity of a window.  Dynamic programming over tokens and the kind of the entity
before, with segments of at most ``MAX_TOKENS`` tokens, picks boundaries and types together.

The weights are fitted here by gradient steps on the likelihood.  The rows are
windows of the corpus with the base rules' spans as labels, the
``TRAIN_WINDOWS`` first in the order of a hash, plus copies in which numbers
are written another way.  Everything else covers every character of every text:
windows are cut around each digit and @, and nothing outside them can be a
candidate, because a segment must hold one of these.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.spans import SPAN_TYPE, overlaps
from tabloom.llm.text import picked, whole_text

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 40
MARGIN = 24
TRAIN_WINDOWS = 1200
TRAIN_CHARS = 400  # longer windows are not trained on
EPOCHS = 12
RATE = 0.5
DECAY = 1e-4
LEAST_ODDS = 2.0  # log odds that a segment of the best path needs against being no entity

# The patterns of the base rules.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ANCHOR = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\W_]+|[^\s]|_")
LOOSE = re.compile(r"[0-9()+./\x20-]+\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, kind by kind, in linear time."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def windows(text: str):
    """(start, end) of the stretches around digits and @, up to white space."""
    pos, n = 0, len(text)
    while m := ANCHOR.search(text, pos):
        start = max(pos, m.start() - MARGIN)
        end = m.end() + MARGIN
        while (again := ANCHOR.search(text, m.end(), end)) or (end < n and not text[end - 1].isspace() and end - m.end() < 4 * MARGIN):
            if again:
                m, end = again, again.end() + MARGIN
            else:
                end += 1
        end = min(end, n)
        yield start, end
        pos = end


def _bucket(n: int) -> int:
    for i, top in enumerate((0, 3, 6, 7, 9, 10, 11, 12, 15, 19)):
        if n <= top:
            return i
    return 10


NAMES = (
    ["one"]
    + [f"digits{i}" for i in range(11)]
    + ["luhn", "no_luhn", "at", "address", "quad", "quad_range", "dots", "plus", "parens", "dashes", "blanks", "letters", "mixed"]
    + [f"groups{i}" for i in range(7)]
    + ["edge_left", "edge_right", "number_left", "number_right", "cue_mail", "cue_phone", "cue_card", "cue_net", "longest_run3", "hexlike"]
)
FEATURE = {n: i for i, n in enumerate(NAMES)}
CUES = (("cue_mail", ("mail", "e-mail", "email")), ("cue_phone", ("tel", "phone", "call", "fax", "mobile")), ("cue_card", ("card", "visa", "credit")), ("cue_net", ("ip", "host", "address", "server")))


@lru_cache(maxsize=50_000)
def _inner(segment: str) -> tuple[int, ...]:
    """Features of what a segment holds."""
    digits = _digits(segment)
    on = ["one", f"digits{_bucket(len(digits))}"]
    if 13 <= len(digits) <= 19:
        on.append("luhn" if luhn(digits) else "no_luhn")
    if "@" in segment:
        on.append("at")
        if re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", segment):
            on.append("address")
    parts = segment.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        on += ["quad"] + ["quad_range"] * all(len(p) <= 3 and int(p) <= 255 for p in parts)
    on += [n for n, c in (("dots", "."), ("plus", "+"), ("parens", "("), ("dashes", "-"), ("blanks", " ")) if c in segment]
    if any(c.isalpha() for c in segment):
        on.append("letters")
        on += ["mixed"] * bool(re.search(r"[0-9][^\W\d_]|[^\W\d_][0-9]", segment))
        on += ["hexlike"] * bool(re.fullmatch(r"[0-9a-fA-F]{8,}", segment))
    groups = re.findall(r"[0-9]+", segment)
    on.append(f"groups{min(6, len(groups))}")
    on += ["longest_run3"] * bool(groups and max(map(len, groups)) <= 4)
    return tuple(FEATURE[n] for n in on)


def segments(window: str) -> tuple[int, list[tuple[int, int, int, int, tuple[int, ...]]]]:
    """Number of tokens, and the candidates: (first token, after the last, start, end, features)."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(window)]
    out = []
    for i, (start, stop) in enumerate(tokens):
        if not (window[start].isalnum() or window[start] in "+("):
            continue
        blank = False
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            if j > i and tokens[j][0] > tokens[j - 1][1]:
                blank = True
                if window[tokens[j - 1][1] : tokens[j][0]] != " ":
                    break
            end = tokens[j][1]
            segment = window[start:end]
            if blank and not LOOSE.match(segment):
                break
            if not window[end - 1].isalnum() or not ANCHOR.search(segment):
                continue
            before, after = window[start - 1 : start], window[end : end + 1]
            on = list(_inner(segment))
            on += [FEATURE["edge_left"]] * (not before or before.isspace()) + [FEATURE["edge_right"]] * (not after or not after.isalnum())
            on += [FEATURE["number_left"]] * bool(re.search(r"[0-9][ .-]?$", window[max(0, start - 2) : start]))
            on += [FEATURE["number_right"]] * bool(re.match(r"[ .-]?[0-9]", window[end : end + 2]))
            left = window[max(0, start - MARGIN) : start].lower()
            on += [FEATURE[name] for name, words in CUES if any(re.search(rf"\b{w}\b", left) for w in words)]
            out.append((i, j + 1, start, end, tuple(on)))
    return len(tokens), out


def _scores(weights: np.ndarray, found) -> np.ndarray:
    """A row per candidate, a column per kind."""
    return np.array([weights[:, list(s[4])].sum(axis=1) for s in found]).reshape(-1, len(KINDS))


def _follow(weights: np.ndarray) -> np.ndarray:
    """Weights of the entity before: a row per kind, a column for none yet and one per earlier kind."""
    own = weights[:, len(NAMES) :]
    return own if own.shape[1] else np.zeros((len(KINDS), len(KINDS) + 1))


def _gradient(weights: np.ndarray, n: int, found, gold: dict[tuple[int, int], int]) -> np.ndarray:
    """Of the log likelihood of one window: features of the labels less their expectation."""
    scores, follow = _scores(weights, found), _follow(weights)
    forward, backward = _sums(n, found, scores, follow)
    total = np.logaddexp.reduce(forward[n])
    grad, features = np.zeros_like(weights), len(NAMES)
    for k, s in enumerate(found):
        # by kind and kind before
        expected = np.exp(forward[s[0]] + follow + (scores[k] + backward[s[1], 1:])[:, None] - total)
        grad[:, list(s[4])] -= expected.sum(axis=1)[:, None]
        grad[:, features:] -= expected
    before = 0
    for k, s in sorted(enumerate(found), key=lambda x: x[1][2]):
        kind = gold.get((s[2], s[3]))
        if kind is not None:
            grad[kind, list(s[4])] += 1
            grad[kind, features + before] += 1
            before = kind + 1
    return grad


def _sums(n: int, found, scores: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log sums over all paths up to and from each token, by the kind of the last entity (0: none yet)."""
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for k, s in enumerate(found):
        starts.setdefault(s[0], []).append(k)
        ends.setdefault(s[1], []).append(k)
    states = len(KINDS) + 1
    forward, backward = np.full((n + 1, states), -np.inf), np.zeros((n + 1, states))
    forward[0, 0] = 0.0
    for t in range(1, n + 1):
        forward[t] = forward[t - 1]
        for k in ends.get(t, ()):
            reached = np.logaddexp.reduce(forward[found[k][0]] + follow, axis=1) + scores[k]
            forward[t, 1:] = np.logaddexp(forward[t, 1:], reached)
    for t in range(n - 1, -1, -1):
        backward[t] = backward[t + 1]
        for k in starts.get(t, ()):
            onward = np.logaddexp.reduce(follow + (scores[k] + backward[found[k][1], 1:])[:, None], axis=0)
            backward[t] = np.logaddexp(backward[t], onward)
    return forward, backward


def log_likelihood(weights: np.ndarray, n: int, found, gold: dict[tuple[int, int], int]) -> float:
    """Of the labels of one window that are candidates."""
    scores, follow = _scores(weights, found), _follow(weights)
    total, before = 0.0, 0
    for k, s in sorted(enumerate(found), key=lambda x: x[1][2]):
        kind = gold.get((s[2], s[3]))
        if kind is not None:
            total, before = total + scores[k, kind] + follow[kind, before], kind + 1
    return float(total - np.logaddexp.reduce(_sums(n, found, scores, follow)[0][n]))


def variants(window: str, gold: dict[tuple[int, int], int]):
    """The window, and copies in which a number is written another way."""
    yield window, gold
    if len(gold) == 1:
        ((start, end), kind), = gold.items()
        text = window[start:end]
        other = {2: " ".join(text[i : i + 4] for i in range(0, len(text), 4)), 3: re.sub(r"^\+[0-9]{1,3}[ .-]?", "", text)}.get(kind)
        if kind == 2 and not text.isdigit():
            other = text.replace(" ", ".").replace("-", ".")
        if other and other != text:
            yield window[:start] + other + window[end:], {(start, start + len(other)): kind}


def fit(rows: list[str]) -> np.ndarray:
    """Weights by kind and feature, from windows labelled by the base rules."""
    data = []
    for row in rows:
        labels = base_spans(row)
        gold: dict[tuple[int, int], int] = {}
        for kind, start, end in labels:
            if not overlaps(start, end, [(0, *k) for k in gold]):
                gold[start, end] = kind
        for text, marks in variants(row, gold):
            n, found = segments(text)
            if found:
                data.append((n, found, marks))
    weights = np.zeros((len(KINDS), len(NAMES) + len(KINDS) + 1))
    square = np.full_like(weights, 1e-6)
    for _ in range(EPOCHS):
        for begin in range(0, len(data), 16):
            grad = sum(_gradient(weights, *x) for x in data[begin : begin + 16]) - DECAY * weights
            square += grad * grad
            weights += RATE * grad / np.sqrt(square)
    return weights


def best_path(weights: np.ndarray, window: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the segments on the best path through a window."""
    n, found = segments(window)
    if not found:
        return []
    scores, follow = _scores(weights, found), _follow(weights)
    ends: dict[int, list[int]] = {}
    for k, s in enumerate(found):
        ends.setdefault(s[1], []).append(k)
    best = np.full((n + 1, len(KINDS) + 1), -np.inf)
    best[0, 0] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}  # token and last kind: the candidate, and the kind before it
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for k in ends.get(t, ()):
            odds = follow + scores[k][:, None]  # by kind and kind before
            reached = np.where(odds >= LEAST_ODDS, best[found[k][0]] + odds, -np.inf)
            for kind in np.flatnonzero(reached.max(axis=1) > best[t, 1:]).tolist():
                before = int(reached[kind].argmax())
                best[t, kind + 1] = reached[kind, before]
                back[t, kind + 1] = k, before
    out, t, state = [], n, int(best[n].argmax())
    while t > 0:
        if (t, state) in back and best[t, state] > best[t - 1, state]:
            k, before = back[t, state]
            out.append((state - 1, found[k][2], found[k][3]))
            t, state = found[k][0], before
        else:
            t -= 1
    return out[::-1]


def training_windows(docs: DataFrame, limit: int = TRAIN_WINDOWS) -> list[str]:
    """The ``limit`` windows that come first in the order of a hash."""

    def cut(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = [t[s:e] for t in texts for s, e in windows(t) if e - s <= TRAIN_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["w"])

    rows = docs.select(whole_text().alias("text")).where(F.col("text").rlike("[0-9@]")).mapInArrow(cut, "w string")
    return [r["w"] for r in rows.distinct().orderBy(F.xxhash64("w"), "w").limit(limit).collect()]


def all_spans(weights: np.ndarray, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the field's spans that overlap none of them."""
    base = base_spans(text)
    added = []
    for start, end in windows(text):
        near = [b for b in base if b[1] < end and b[2] > start]
        for kind, s, e in best_path(weights, text[start:end]):
            if not overlaps(start + s, start + e, near):
                added.append((kind, start + s, start + e))
    return base, added


def pii_spans(docs: DataFrame, limit: int = TRAIN_WINDOWS) -> DataFrame:
    """Each row's base spans and all its spans, with offsets in code points.

    A missing text is the empty one.  Repeated rows get the same spans; equal
    windows are one training row.  An empty table gives an empty result, and a
    corpus without digits and @ a field that adds nothing.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(training_windows(docs, limit)))

    def judge(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            bases, alls = [], []
            for text in batch.column(1):
                base, added = all_spans(held.value, text.as_py())
                bases.append([dict(zip(("kind", "start", "end"), x)) for x in base])
                alls.append([dict(zip(("kind", "start", "end"), x)) for x in base + added])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, kind), pa.array(alls, kind)], ["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = picked(docs, "doc_id", "text").select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(judge, f"doc_id {kind}, base {SPAN_TYPE}, spans {SPAN_TYPE}")
