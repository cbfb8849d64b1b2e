"""Table profiling: many columns per pass, results in long form.

Every function reads the table a fixed number of times, whatever the number of
columns.  Functions that need several passes run them when called; persist the
table first if it is costly to derive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.moments import moment_table, sample_deviation, sample_kurtosis, sample_skewness
from tabloom.operators.quantiles import exact_quantiles, number
from tabloom.session import merged

QUARTILES = (0.25, 0.5, 0.75)
FLAT = 1e-12  # a variance this small beside the squares it is taken from is rounding; more rows leave more of it


def long_form(wide: DataFrame, columns: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """One row per column from a one-row frame with values named ``field:column``.

    ``fields`` maps each field to its SQL type.
    """
    rows = ", ".join(
        "'{0}', {1}".format(c.replace("'", "\\'"), ", ".join(f"CAST(`{f}:{c}` AS {t})" for f, t in fields.items()))
        for c in columns
    )
    return wide.selectExpr(f"stack({len(columns)}, {rows}) AS (column_name, {', '.join(fields)})")


def unpivot_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) for every non-null value."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, value)").filter("value IS NOT NULL")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def schema_info(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of every column, and the row count."""
    aggregates = [F.count(F.lit(1)).alias("n_rows")] + [F.count(F.col(c)).alias(f"n:{c}") for c in df.columns]
    rows = ", ".join(
        f"{i}, '{name}', '{kind}', `n:{name}`, n_rows" for i, (name, kind) in enumerate(df.dtypes, start=1)
    )
    names = "(position, column_name, dtype, non_null, n_rows)"
    return df.agg(*aggregates).selectExpr(f"stack({len(df.columns)}, {rows}) AS {names}")


def head_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in key order (a top-n per task, then a merge)."""
    return df.orderBy(key).limit(n)


def missing_summary(df: DataFrame) -> DataFrame:
    """Null count and percentage of the columns that have nulls, most first."""
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    aggregates += [F.count_if(F.col(c).isNull()).alias(f"missing_count:{c}") for c in df.columns]
    wide = df.agg(*aggregates)
    pairs = ", ".join(f"'{c}', `missing_count:{c}`, n_rows" for c in df.columns)
    return (
        wide.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, missing_count, n_rows)")
        .filter("missing_count > 0")
        .select("column_name", "missing_count", (F.col("missing_count") / F.col("n_rows") * 100).alias("percentage"))
        .orderBy(F.desc("missing_count"), "column_name")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    found = moment_table(df, columns).withColumn("std", sample_deviation()).collect()  # one row per column
    by_name = {row["column_name"]: row for row in found}
    quartiles = exact_quantiles(df, {c: QUARTILES for c in columns})
    rows = [
        (c, row["n"], row["mean"], row["std"], row["min"], *quartiles[c], row["max"])
        for c, row in ((c, by_name[c]) for c in columns)
    ]
    schema = "column_name string, n bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    return _table(df.sparkSession, rows, schema)


def skewness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness per column."""
    return moment_table(df, columns).select("column_name", sample_skewness().alias("skewness"))


def kurtosis(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected excess kurtosis per column."""
    return moment_table(df, columns).select("column_name", sample_kurtosis().alias("kurtosis"))


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(column_name, probability, value) with linear interpolation."""
    found = exact_quantiles(df, {c: probabilities for c in columns})
    rows = [(c, float(p), v) for c in columns for p, v in zip(probabilities, found[c], strict=True)]
    return _table(df.sparkSession, rows, "column_name string, probability double, value double")


def center_and_spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, deviation, skewness and kurtosis: the statistics of a target column."""
    statistics = moment_table(df, columns).select(
        "column_name",
        "n",
        "mean",
        sample_deviation().alias("std"),
        sample_skewness().alias("skewness"),
        sample_kurtosis().alias("kurtosis"),
    )
    by_name = {row["column_name"]: row for row in statistics.collect()}  # one row per column
    medians = exact_quantiles(df, {c: [0.5] for c in columns})
    rows = [
        (c, row["mean"], medians[c][0], row["std"], row["skewness"], row["kurtosis"])
        for c, row in ((c, by_name[c]) for c in columns)
    ]
    schema = "column_name string, mean double, median double, std double, skewness double, kurtosis double"
    return _table(df.sparkSession, rows, schema)


def outlier_counts(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Values outside [Q1 - factor*IQR, Q3 + factor*IQR], and their share of all rows in percent."""
    quartiles = exact_quantiles(df, {c: (0.25, 0.75) for c in columns})
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    fences = {}
    for c in columns:
        q1, q3 = quartiles[c]
        if q1 is None:
            continue
        fences[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
        x = number(c)
        aggregates.append(F.count_if((x < fences[c][0]) | (x > fences[c][1])).alias(c))
    row = df.agg(*aggregates).first()
    rows = [
        (c, fences[c][0], fences[c][1], row[c], row[c] / row["n_rows"] * 100) if c in fences
        else (c, None, None, 0, 0.0)
        for c in columns
        if row["n_rows"]
    ]
    schema = "column_name string, lower_fence double, upper_fence double, outliers bigint, percentage double"
    return _table(df.sparkSession, rows, schema)


def boxplot_stats(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (the extreme values within the fences) and outlier count."""
    quartiles = exact_quantiles(df, {c: QUARTILES for c in columns})
    aggregates = []
    for c in columns:
        q1, _, q3 = quartiles[c]
        x = number(c)
        low = None if q1 is None else q1 - factor * (q3 - q1)
        high = None if q1 is None else q3 + factor * (q3 - q1)
        within = x.between(F.lit(low).cast("double"), F.lit(high).cast("double"))
        aggregates += [
            F.min(F.when(within, x)).alias(f"whisker_low:{c}"),
            F.max(F.when(within, x)).alias(f"whisker_high:{c}"),
            F.count_if(~within).alias(f"outliers:{c}"),
        ]
    row = df.agg(*aggregates).first()
    rows = [
        (c, *quartiles[c], row[f"whisker_low:{c}"], row[f"whisker_high:{c}"], row[f"outliers:{c}"]) for c in columns
    ]
    schema = (
        "column_name string, q25 double, q50 double, q75 double, "
        "whisker_low double, whisker_high double, outliers bigint"
    )
    return _table(df.sparkSession, rows, schema)


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete sums for every pair of columns i < j.

    Each task folds its Arrow batches into d x d matrices and emits them once,
    so the shuffle carries d*d/2 rows per task however many rows there are.
    Values are shifted by a per-column constant near their mean, which keeps
    the sums of squares well conditioned.
    """
    names = list(columns)
    d = len(names)
    means = df.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    shift = np.array([means[f"m{i}"] or 0.0 for i in range(d)])

    def fold(batches):
        totals = np.zeros((6, d, d))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(d)]) - shift
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            m = seen.astype(float)
            square = x * x
            totals += np.stack([m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x])
        upper = np.triu_indices(d, 1)
        columns = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32))]
        columns += [pa.array(totals[k][upper]) for k in range(6)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    partial = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(names)]).mapInArrow(fold, schema)
    return merged(partial, ["i", "j"], ["n", "sx", "sy", "sxx", "syy", "sxy"])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (the strict triangle), each over its complete rows.

    A pair with a constant column has a null correlation.
    """
    names = list(columns)
    label = F.array(*[F.lit(c) for c in names])
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    flat = (vx <= F.col("sxx") * FLAT) | (vy <= F.col("syy") * FLAT)
    r = F.when(~flat, F.try_divide(cov, F.sqrt(vx * vy)))
    return pair_sums(df, names).select(
        F.get(label, F.col("i")).alias("feature_1"), F.get(label, F.col("j")).alias("feature_2"), r.alias("r")
    )


def high_correlations(df: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairs with an absolute correlation above ``threshold``."""
    return correlation_matrix(df, columns).filter(F.abs("r") > threshold)


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, over the rows that have both."""
    y = number(target)
    aggregates = []
    for c in features:
        both = number(c).isNotNull() & y.isNotNull()
        vx, vy = F.var_pop(F.when(both, number(c))), F.var_pop(F.when(both, y))
        r = F.try_divide(F.covar_pop(number(c), y), F.sqrt(vx * vy))
        aggregates.append(r.alias(f"r:{c}"))
    return long_form(df.agg(*aggregates), list(features), {"r": "DOUBLE"})


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency and share of every non-null value of the columns, most frequent first.

    All columns are counted in one shuffle keyed by (column, value), after a
    map-side count; a value held by most rows costs one row per task.
    """
    counts = _value_table(df, columns)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    return (
        counts.join(totals, "column_name")
        .select("column_name", "value", "n", (F.col("n") / F.col("total")).alias("share"))
        .orderBy("column_name", F.desc("n"), "value")
    )


def _value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, value)").filter("value IS NOT NULL")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct non-null values per column."""
    names = ", ".join(f"'{c}'" for c in columns)
    found = _value_table(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
    every = df.sparkSession.sql(f"SELECT explode(array({names})) AS column_name")
    return every.join(found, "column_name", "left").select(
        "column_name", F.coalesce("distinct_values", F.lit(0).cast("bigint")).alias("distinct_values")
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The most frequent value per column and its count; the smallest value wins a tie, numbers by their size."""
    numeric = [f.name for f in df.schema.fields if f.name in set(columns) and isinstance(f.dataType, T.NumericType)]
    size = F.when(F.col("column_name").isin(*numeric), F.col("value").try_cast("double")) if numeric else F.lit(None).cast("double")
    best = F.min(F.struct((-F.col("n")).alias("order"), size.alias("size"), "value")).alias("best")
    return (
        _value_table(df, columns)
        .groupBy("column_name")
        .agg(best)
        .select("column_name", F.col("best.value").alias("value"), (-F.col("best.order")).alias("n"))
    )


def bin_number(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1, the last one closed; everything is in bin 0 where low = high."""
    position = F.floor(F.try_divide((x - low) * bins, high - low))
    return F.when(low == high, F.lit(0)).otherwise(F.least(position, F.lit(bins - 1))).cast("int")


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    aggregates = [e for c in columns for e in (F.min(number(c)).alias(f"l:{c}"), F.max(number(c)).alias(f"h:{c}"))]
    row = df.agg(*aggregates).first()
    return {c: (row[f"l:{c}"], row[f"h:{c}"]) for c in columns if row[f"l:{c}"] is not None}


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """(column_name, bin, bin_low, n) of equal-width histograms; empty bins are left out."""
    ranges = _ranges(df, columns)
    schema = "column_name string, bin int, bin_low double, n bigint"
    if not ranges:
        return _table(df.sparkSession, [], schema)
    names = list(ranges)
    low, high = (np.array([ranges[c][k] for c in names], dtype=float) for k in (0, 1))

    def fold(batches):
        """Counts of a task per column and bin."""
        counts = np.zeros((len(names), bins), dtype=np.int64)
        for batch in batches:
            for i in range(len(names)):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                if low[i] == high[i]:
                    counts[i, 0] += len(x)
                else:
                    at = np.minimum(np.floor((x - low[i]) * bins / (high[i] - low[i])), bins - 1).astype(np.int64)
                    counts[i] += np.bincount(at, minlength=bins)
        i, k = np.nonzero(counts)
        columns = [i.astype(np.int32), k.astype(np.int32), counts[i, k]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "bin", "n"])

    partial = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(names)]).mapInArrow(fold, "i int, bin int, n bigint")
    label, start, end = (F.array(*[F.lit(v) for v in values]) for values in (names, low.tolist(), high.tolist()))
    own, top = F.get(start, F.col("i")), F.get(end, F.col("i"))
    edge = own + F.col("bin") * ((top - own) / bins)
    return merged(partial, ["i", "bin"], ["n"]).select(F.get(label, F.col("i")).alias("column_name"), "bin", edge.alias("bin_low"), "n")


def log_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """The histogram of log(1 + x)."""
    return histogram(df.select(F.log1p(number(column)).alias(column)), [column], bins)


def kde_curve(df: DataFrame, column: str, points: int = 200, cells: int = 1024) -> DataFrame:
    """Gaussian kernel density on ``points`` grid points from minimum to maximum.

    The bandwidth is n**(-1/5) times the sample deviation.  Values are counted
    in ``cells`` equal cells first, each standing at the mean of its values, so
    the density costs cells x points terms at any row count.
    """
    x = number(column)
    row = df.agg(
        F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.stddev_samp(x).alias("std")
    ).first()
    n, low, high = row["n"], row["low"], row["high"]
    if not n or not row["std"]:
        return _table(df.sparkSession, [], "point int, x double, density double")
    h = row["std"] * n ** (-0.2)
    binned = (
        df.select(x.alias("x"))
        .filter("x IS NOT NULL")
        .groupBy(bin_number(F.col("x"), F.lit(low), F.lit(high), cells).alias("cell"))
        .agg(F.count(F.lit(1)).alias("weight"), F.avg("x").alias("center"))
    )
    grid = binned.select("weight", "center", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    at = F.lit(low) + F.col("point") * F.lit((high - low) / (points - 1))
    u = (at - F.col("center")) / F.lit(h)
    kernel = F.col("weight") * F.exp(-0.5 * u * u)
    norm = n * h * float(np.sqrt(2 * np.pi))
    return (
        grid.groupBy("point")
        .agg((F.sum(kernel) / F.lit(norm)).alias("density"))
        .select("point", (F.lit(low) + F.col("point") * F.lit((high - low) / (points - 1))).alias("x"), "density")
    )


def qq_points(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """Normal quantile, sample quantile and fitted line at evenly spaced probabilities.

    The line is the least-squares fit of the sample quantiles on the normal
    ones; ``line_r`` is their correlation.
    """
    probabilities = [(i + 0.5) / points for i in range(points)]
    sample = exact_quantiles(df, {column: probabilities})[column]
    schema = (
        "probability double, normal_quantile double, sample_quantile double, "
        "line_slope double, line_intercept double, line_r double"
    )
    if sample[0] is None:
        return _table(df.sparkSession, [], schema)
    z = [NormalDist().inv_cdf(p) for p in probabilities]
    slope, intercept = (float(v) for v in np.polyfit(z, sample, 1))
    r = float(np.corrcoef(z, sample)[0, 1]) if max(sample) > min(sample) else None
    rows = [(p, q, v, slope, intercept, r) for p, q, v in zip(probabilities, z, sample, strict=True)]
    return _table(df.sparkSession, rows, schema)


def null_patterns(df: DataFrame) -> DataFrame:
    """How many rows share each pattern of nulls, over all columns in order (1 = null)."""
    bits = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    present = F.length(F.regexp_replace("pattern", "1", "")).alias("present")
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).select("pattern", "n", present)


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """Counts on a bins x bins grid over (x, y): a scatter plot that keeps every point."""
    ranges = _ranges(df, [x, y])
    if len(ranges) < 2:
        return _table(df.sparkSession, [], "x_bin int, y_bin int, n bigint")
    cells = [
        bin_number(number(c), F.lit(ranges[c][0]), F.lit(ranges[c][1]), bins).alias(name)
        for c, name in ((x, "x_bin"), (y, "y_bin"))
    ]
    return df.filter(number(x).isNotNull() & number(y).isNotNull()).groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that equal an earlier row."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))
