"""The language of a text, by family first and then by pairs of close relatives.

Features are letter trigrams of the whole text (lower case, word ends
included), hashed into buckets; a text is the share that each bucket has in
its trigrams.  A multinomial regression tells the family, and inside it linear
support vector machines decide between every two languages; the language with
the most duels won is the answer.

The models are fitted by Spark ML on at most ``PER_LANG`` labelled texts of each
language; all other work covers all rows.  A linear score of shares is the mean of
the weights of a text's trigrams, so a prediction looks each trigram up once
and holds one lot of ``LOT_UNITS`` code points, however long the text is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.text import lots, picked, whole_text
from tabloom.session import write_and_reread

PER_LANG = 400  # labelled texts a language is learned from, at most
LANGUAGES = 64  # languages that are learned, those with the most labelled texts first
BUCKETS = 4096
ROUNDS = 25  # steps of a fit
LOT_UNITS = 1 << 20
UNKNOWN = "und"

# Language codes by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "gu", "pa"),
    "iranian": ("fa", "ps", "ku"),
    "semitic": ("ar", "he", "am", "mt"),
    "malayic": ("id", "ms", "jv", "su"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is left out of learning; a row without doc_id takes part."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- trigrams


@cache
def _letters() -> np.ndarray:
    """Per code point its lower-case letter, or 0 for what is no letter."""
    lower = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            small = char.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    return lower


def trigrams(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (row, bucket) arrays for all trigrams around a letter, lot by lot.

    The code points beside a text's ends count as word ends.  A long text comes
    in slices that share a code point with their neighbours.
    """
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        for start in range(0, len(text), LOT_UNITS):
            piece = text[max(start - 1, 0) : start + LOT_UNITS + 1]
            # a blank on the side where the text ends, so that only whole trigrams of this slice are counted
            piece = ("" if start else " ") + piece + ("" if start + LOT_UNITS < len(text) else " ")
            if held and held + len(piece) > LOT_UNITS:
                yield _hashed(rows, parts, buckets)
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(piece)
            held += len(piece)
    if parts:
        yield _hashed(rows, parts, buckets)


def _hashed(rows: list[int], parts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters()[codes]
    row = np.repeat(np.array(rows, dtype=np.int32), lengths)
    inside = np.ones(len(letters), dtype=bool)  # the first and last code point of a part are no middle
    ends = np.cumsum(lengths)
    inside[ends - 1] = False
    inside[ends - lengths] = False
    middle = np.flatnonzero(inside & (letters > 0))
    # Odd multipliers of a multiplicative hash.
    with np.errstate(over="ignore"):
        key = letters[middle - 1] * np.uint32(0x9E3779B1) + letters[middle] * np.uint32(0x85EBCA6B)
        key = (key ^ (key >> np.uint32(15))) + letters[middle + 1] * np.uint32(0xC2B2AE35)
        key = (key ^ (key >> np.uint32(13))) * np.uint32(0x27D4EB2F)
    return row[middle], (key >> np.uint32(16)) % np.uint32(buckets)


def _shares(buckets: int):
    """Rows (lang, text) to (lang, shares): one sparse sample text after the other."""

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").to_pylist(), strict=True):
                counts = np.zeros(buckets)
                for _, bucket in trigrams([text], buckets):
                    counts += np.bincount(bucket, minlength=buckets)
                shares = counts / max(counts.sum(), 1.0)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([shares.tolist()])], names=["lang", "shares"])

    return run


# ---------------------------------------------------------------- learning


@dataclass(frozen=True)
class LanguageModel:
    """Weights per bucket: a row per family, and a row per pair of languages of one family."""

    families: tuple[str, ...]
    members: tuple[tuple[str, ...], ...]
    family_weights: np.ndarray
    family_bias: np.ndarray
    pairs: tuple[tuple[str, str], ...]
    pair_weights: np.ndarray
    pair_bias: np.ndarray


def learning_sample(docs: DataFrame, per_lang: int = PER_LANG, languages: int = LANGUAGES) -> DataFrame:
    """(lang, text) of at most ``per_lang`` labelled texts with letters for each language.

    Texts are taken in the order of a hash.  A first pass counts the languages, so
    that the second keeps about twice the wanted share before it ranks.
    """
    labelled = picked(docs, "doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")) & whole_text().rlike(r"\p{L}")
    )
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    thinned = labelled.join(F.broadcast(counts), "lang").filter(draw * F.col("count") < 2 * per_lang)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id", "text"))
    return thinned.withColumn("place", place).filter(F.col("place") <= per_lang).select("lang", "text")


def fit_languages(docs: DataFrame, per_lang: int = PER_LANG, languages: int = LANGUAGES, buckets: int = BUCKETS) -> LanguageModel | None:
    """Fit on the labelled rows that are not held out; None where there are none."""
    shares = learning_sample(docs, per_lang, languages).mapInArrow(_shares(buckets), "lang string, shares array<double>")
    features = shares.select("lang", array_to_vector("shares").alias("features"))
    sample = write_and_reread(features, "language-sample").cache()
    try:
        langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
        if not langs:
            return None
        families = sorted({family_of(lang) for lang in langs})
        members = [tuple(lang for lang in langs if family_of(lang) == f) for f in families]
        family_weights, family_bias = _family_fit(sample, members, buckets)
        pairs = [(a, b) for group in members for i, a in enumerate(group) for b in group[i + 1 :]]
        duels = [_duel(sample, a, b) for a, b in pairs]
    finally:
        sample.unpersist()
    return LanguageModel(
        tuple(families),
        tuple(members),
        family_weights,
        family_bias,
        tuple(pairs),
        np.array([w for w, _ in duels]).reshape(len(pairs), buckets),
        np.array([b for _, b in duels]),
    )


def _family_fit(sample: DataFrame, members: list[tuple[str, ...]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    if len(members) == 1:
        return np.zeros((1, buckets)), np.zeros(1)
    label = F.lit(None)
    for i, group in enumerate(members):
        label = F.when(F.col("lang").isin(*group), float(i)).otherwise(label)
    learner = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=ROUNDS)
    model = learner.fit(sample.select("features", label.alias("label")))
    return model.coefficientMatrix.toArray(), model.interceptVector.toArray()


def _duel(sample: DataFrame, first: str, second: str) -> tuple[np.ndarray, float]:
    """Weights that are positive for ``second``."""
    rows = sample.filter(F.col("lang").isin(first, second))
    learner = LinearSVC(regParam=1e-3, maxIter=ROUNDS)
    model = learner.fit(rows.select("features", (F.col("lang") == second).cast("double").alias("label")))
    return model.coefficients.toArray(), float(model.intercept)


# ---------------------------------------------------------------- prediction


def predict_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``; only its text decides.

    The score is the family's probability times the mean certainty of the
    language's duels.  A missing text, one without a letter, and every text
    where nothing could be learned, is ``und`` with score 0.  Repeated rows
    give repeated results, an empty table none; further columns are left aside.
    """
    source = picked(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), whole_text().alias("text")
    )

    def run(batches):
        for batch in batches:
            for part in lots(batch, LOT_UNITS):
                langs, scores = _judged(part.column("text").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _judged(texts: list[str], model: LanguageModel | None) -> tuple[list[str], list[float]]:
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    weights = np.concatenate([model.family_weights, model.pair_weights])
    sums, counts = np.zeros((len(weights), len(texts))), np.zeros(len(texts))
    for row, bucket in trigrams(texts, weights.shape[1]):
        counts += np.bincount(row, minlength=len(texts))
        for i, w in enumerate(weights):
            sums[i] += np.bincount(row, weights=w[bucket], minlength=len(texts))
    means = sums / np.maximum(counts, 1)
    families = means[: len(model.families)] + model.family_bias[:, None]
    margins = means[len(model.families) :] + model.pair_bias[:, None]
    odds = np.exp(families - families.max(axis=0))
    odds /= odds.sum(axis=0)
    langs, scores = [], []
    for k in range(len(texts)):
        if not counts[k]:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        family = int(np.argmax(odds[:, k]))
        lang, certainty = _winner(model, family, margins[:, k])
        langs.append(lang)
        scores.append(float(odds[family, k] * certainty))
    return langs, scores


def _winner(model: LanguageModel, family: int, margins: np.ndarray) -> tuple[str, float]:
    """The language with the most duels won, the larger sum of margins deciding a tie, and its certainty."""
    group = model.members[family]
    if len(group) == 1:
        return group[0], 1.0
    won = {lang: [0, 0.0, 0.0] for lang in group}
    for (first, second), margin in zip(model.pairs, margins, strict=True):
        if first in won:
            for lang, m in ((first, -margin), (second, margin)):
                won[lang][0] += m > 0
                won[lang][1] += m
                won[lang][2] += 1 / (1 + np.exp(-np.clip(m, -50, 50)))
    best = max(group, key=lambda lang: (won[lang][0], won[lang][1]))
    return best, won[best][2] / (len(group) - 1)
