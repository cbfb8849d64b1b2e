"""Quality rules: robust multivariate outliers among the documents of a language and source.

Each document becomes a vector of transformed statistics.  Per language and
source, location and scatter are minimum-covariance-determinant estimates, and
a document is rejected when its Mahalanobis distance is beyond a chi-squared
quantile.  Everything is DataFrame and SQL expressions.

The estimates are found by concentration steps.  One step is one pass over the
table of statistics: distances to the current estimate fall into narrow
classes, sums are taken per group and class, a running count over the classes
finds the one that completes the share of rows to keep, and the sums up to it are the
next estimate, which is written down: a step plans and compiles only itself.  No group ever sits in one task, and because statistics are whole
numbers the sums do not depend on the order of rows.

A group's estimate is blended with its language's, as if that stood for
``PRIOR_ROWS`` more rows, so a group of any size has a regular scatter matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.text import SPACE, lookup_key, picked, same_key, whole_text, words_of
from tabloom.session import write_and_reread

# One unit of a statistic is 1 / SCALE.
SCALE = 512
WINDOW = 5
KEPT_SHARE = 0.75
STEPS = 4
PRIOR_ROWS = 50
CUTOFF = 40.0  # squared distance; about the 1 - 4.6e-7 quantile of chi-squared with six degrees
CLASSES_PER_E = 64  # distance classes per factor e
SALTS = 16

# The statistics: name, expression over the base counts, and the least spread that counts.
STATISTICS = (
    ("words", "ln(1.0D + n_words)", 0.8),
    ("word_length", "ln(1.0D + word_chars / n_some)", 0.12),
    ("symbols", "sqrt(n_symbols / chars_some)", 0.045),
    ("capitals", "sqrt(n_capitals / chars_some)", 0.08),
    ("dup_lines", "sqrt(n_dup_lines / lines_some)", 0.15),
    ("repeats", "sqrt(n_repeat_words / n_some)", 0.15),
)
DIMS = range(len(STATISTICS))
PAIRS = [(i, j) for i in DIMS for j in range(i + 1)]


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by the series of the incomplete gamma function."""
    a, h = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= h / (a + n)
        total += term
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


def consistency(share: float = KEPT_SHARE, k: int = len(STATISTICS)) -> float:
    """What the scatter of the kept share is multiplied by to be that of all rows."""
    return round(share / chi2_cdf(chi2_quantile(share, k), k + 2), 6)


def counts(docs: DataFrame) -> DataFrame:
    """Base counts of each document: one row per row of ``docs``.

    A missing text is the empty one.  All work stays within the row.
    """
    base = picked(docs, "doc_id", "text", "lang", "source").select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        whole_text().alias("text"),
    )
    split = base.select(
        "doc_id",
        "lang",
        "source",
        words_of(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(SPACE.replace("[", "[^"))).alias("lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )
    hashed = split.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"CASE WHEN size(w) < {WINDOW} THEN array() ELSE "
            f"transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))) END"
        )
        .cast("array<bigint>")
        .alias("h"),
    )
    repeated = hashed.withColumn("again", F.size("h") > F.size(F.array_distinct("h")))
    ordered = repeated.withColumn(
        "s", F.expr("CASE WHEN again THEN array_sort(transform(h, (x, i) -> struct(x AS h, i AS p))) END")
    ).drop("h")
    marked = ordered.withColumn(
        "p",
        F.expr(
            "array_sort(transform(filter(sequence(0, size(s) - 1), i -> "
            "(i > 0 AND get(s, i - 1).h = s[i].h) OR (i + 1 < size(s) AND get(s, i + 1).h = s[i].h)), i -> s[i].p))"
        ),
    ).drop("s")
    return marked.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_capitals",
        "n_lines",
        "n_dup_lines",
        F.expr(
            f"coalesce(aggregate(p, named_struct('c', 0L, 'last', -{WINDOW}), (a, x) -> "
            f"named_struct('c', a.c + least({WINDOW}, x - a.last), 'last', x)).c, 0L)"
        ).alias("n_repeat_words"),
    )


def statistic_sql() -> list[str]:
    """The whole-number statistics z0, z1, ... over the base counts, as SQL."""
    over = {
        "n_some": "greatest(n_words, 1)",
        "chars_some": "greatest(word_chars, 1)",
        "lines_some": "greatest(n_lines, 1)",
    }
    texts = []
    for i, (_, body, _) in enumerate(STATISTICS):
        for name, plain in over.items():
            body = body.replace(name, plain)
        texts.append(f"CAST(floor({SCALE} * {body} + 0.5) AS BIGINT) AS z{i}")
    return texts


def estimate_sql(prior: bool) -> Iterator[tuple[str, str]]:
    """Location, scatter and its triangular root from a group's sums, in order of use.

    Sums are n, s{i} and q{i}_{j}; ``prior`` blends in pm{i} and pc{i}_{j}.
    """
    factor = consistency()
    weight = f"(n / (n + {PRIOR_ROWS}.0))"
    for i in DIMS:
        own = f"(s{i} * 1.0 / n)"
        yield f"m{i}", f"({weight} * {own} + (1 - {weight}) * pm{i})" if prior else own
    for i, j in PAIRS:
        own = f"({factor} * (q{i}_{j} * 1.0 / n - (s{i} * 1.0 / n) * (s{j} * 1.0 / n)))"
        if i == j:
            own = f"({own} + {(STATISTICS[i][2] * SCALE) ** 2!r})"
        yield f"c{i}_{j}", f"({weight} * {own} + (1 - {weight}) * pc{i}_{j})" if prior else own
    for i, j in PAIRS:
        rest = f"c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        yield f"l{i}_{j}", f"sqrt({rest})" if i == j else f"({rest}) / l{j}_{j}"


def distance_sql() -> Iterator[tuple[str, str]]:
    """Squared Mahalanobis distance d2 by forward substitution, in order of use."""
    for i in DIMS:
        yield f"y{i}", f"(z{i} - m{i}" + "".join(f" - l{i}_{k} * y{k}" for k in range(i)) + f") / l{i}_{i}"
    yield "d2", " + ".join(f"y{i} * y{i}" for i in DIMS)


CLASS_SQL = f"CAST(floor({CLASSES_PER_E} * ln(1.0D + d2)) AS BIGINT)"
SUMS = [f"s{i}" for i in DIMS] + [f"q{i}_{j}" for i, j in PAIRS]
ESTIMATE = [f"m{i}" for i in DIMS] + [f"c{i}_{j}" for i, j in PAIRS] + [f"l{i}_{j}" for i, j in PAIRS]


def _with(df: DataFrame, steps: Iterator[tuple[str, str]]) -> DataFrame:
    for name, text in steps:
        df = df.withColumn(name, F.expr(text))
    return df


def _distances(stats: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its d2.  Rows of a group are dealt over salts, so a group that holds
    a third of all rows is joined in many tasks."""
    salted = estimates.select(*keys, *[c for c in ESTIMATE if c[0] in "ml"]).withColumn(
        "salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    )
    rows = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id", "z0"), F.lit(SALTS)).cast("int"))
    joined = _with(rows.join(salted, [*keys, "salt"]), distance_sql())
    return joined.drop("salt", *[c for c in ESTIMATE if c[0] in "ml"], *[f"y{i}" for i in DIMS])


def _concentrate(stats: DataFrame, estimates: DataFrame, keys: list[str], prior: DataFrame | None) -> DataFrame:
    """One concentration step of every group."""
    near = _distances(stats, estimates, keys).withColumn("class", F.expr(CLASS_SQL))
    sums = near.groupBy(*keys, "class").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"z{i}").alias(f"s{i}") for i in DIMS],
        *[F.sum(F.expr(f"z{i} * z{j}")).alias(f"q{i}_{j}") for i, j in PAIRS],
    )
    group = f"PARTITION BY {', '.join(keys)}"
    reached = sums.selectExpr("*", f"sum(n) OVER ({group} ORDER BY class) AS upto", f"sum(n) OVER ({group}) AS total")
    # all classes up to the one that completes the share
    inner = reached.where(f"upto - n < {KEPT_SHARE} * total")
    base = inner.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ["n", *SUMS]])
    if prior is not None:
        base = base.join(
            prior.select("lang", *[F.col(f"m{i}").alias(f"pm{i}") for i in DIMS], *[F.col(f"c{i}_{j}").alias(f"pc{i}_{j}") for i, j in PAIRS]),
            "lang",
        )
    return _with(base, estimate_sql(prior is not None)).select(*keys, *ESTIMATE)


def _start(stats: DataFrame) -> DataFrame:
    """Per language: the median of each statistic, and its quartile range as the spread."""
    values = stats.select(
        "lang", F.posexplode(F.array(*[F.col(f"z{i}") for i in DIMS])).alias("dim", "z")
    )
    counted = values.groupBy("lang", "dim", "z").agg(F.count(F.lit(1)).alias("n"))
    running = counted.selectExpr(
        "lang",
        "dim",
        "z",
        "sum(n) OVER (PARTITION BY lang, dim) AS total",
        "sum(n) OVER (PARTITION BY lang, dim ORDER BY z) AS upto",
    )
    marks = running.groupBy("lang", "dim").agg(
        *[
            F.min(F.when(F.expr(f"upto >= {q} * total"), F.col("z"))).alias(name)
            for name, q in (("low", 0.25), ("mid", 0.5), ("high", 0.75))
        ]
    )
    flat = marks.groupBy("lang").agg(
        *[F.max(F.when(F.col("dim") == i, F.col(name))).alias(f"{name}{i}") for i in DIMS for name in ("low", "mid", "high")]
    )
    return flat.selectExpr("lang", *start_sql())


def start_sql() -> list[str]:
    out = [f"mid{i} * 1.0D AS m{i}" for i in DIMS]
    for i, j in PAIRS:
        spread = f"((high{i} - low{i}) / 1.349D + {STATISTICS[i][2] * SCALE!r})"
        out.append(f"{spread} * {spread} AS c{i}_{j}" if i == j else f"0.0D AS c{i}_{j}")
    for i, j in PAIRS:
        spread = f"((high{i} - low{i}) / 1.349D + {STATISTICS[i][2] * SCALE!r})"
        out.append(f"{spread} AS l{i}_{j}" if i == j else f"0.0D AS l{i}_{j}")
    return out


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts, squared distance and verdict of each document.

    Null texts are empty and fail the base rule (fewer than ten words).  A
    missing language or source is a group of its own.  Documents with equal
    statistics get equal verdicts; repeated rows are judged like any others,
    and an empty table gives an empty result.
    """
    stats = write_and_reread(counts(docs).selectExpr("*", *statistic_sql()), "quality-stats")
    lean = stats.select("doc_id", "lang", "source", *[f"z{i}" for i in DIMS])
    by_lang = _start(lean)
    for _ in range(STEPS):
        by_lang = write_and_reread(_concentrate(lean, by_lang, ["lang"], None), "quality-languages")
    keys = ["lang", "source"]
    groups = lean.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).drop("rows").join(by_lang, "lang")
    for _ in range(STEPS):
        groups = write_and_reread(_concentrate(lean, groups, keys, by_lang), "quality-groups")
    judged = _distances(stats, groups, keys)
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("d2") <= CUTOFF)).alias("kept"),
        "d2",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; each row without doc_id is judged by itself."""
    content = ("text", "lang", "source")
    key = lookup_key(docs, *content)
    judged = quality_verdicts(docs.select(key.alias("doc_id"), *content))
    good = judged.where("kept").select(F.col("doc_id").alias("_good")).distinct()
    return docs.join(good, same_key(key, good["_good"]), "left_semi")
