"""SQL of the quality query."""

from __future__ import annotations

from tabloom.llm import quality as q

SPACES = r"[\x20\x09-\x0D]"


def _chain(source: str, steps) -> str:
    """Columns added one after the other, each as a subquery."""
    for name, text in steps:
        source = f"(SELECT *, {text} AS {name} FROM {source})"
    return source


def _plain(text: str) -> str:
    return text.replace("1.0D", "1.0::DOUBLE").replace("0.0D", "0.0::DOUBLE").replace("1.349D", "1.349::DOUBLE").replace("* 1.0 ", "* 1.0::DOUBLE ").replace(f"{q.PRIOR_ROWS}.0", f"{q.PRIOR_ROWS}::DOUBLE")


def _counts() -> str:
    return rf"""
base AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + {q.WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS p FROM base WHERE len(w) >= {q.WINDOW})),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM rep, range(0, {q.WINDOW}) r(o) GROUP BY doc_id),
counts AS MATERIALIZED (SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words,
  coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN cov USING (doc_id)),
stats AS MATERIALIZED (SELECT *, {_plain(', '.join(q.statistic_sql()))} FROM counts)"""


def _start() -> str:
    marks = ", ".join(
        f"min(CASE WHEN upto >= {share} * total AND dim = {i} THEN z END) AS {name}{i}"
        for i in q.DIMS
        for name, share in (("low", 0.25), ("mid", 0.5), ("high", 0.75))
    )
    values = " UNION ALL ".join(f"SELECT lang, {i} AS dim, z{i} AS z FROM stats" for i in q.DIMS)
    return f"""
cells AS (SELECT lang, dim, z, count(*) AS n FROM ({values}) GROUP BY ALL),
marks AS (SELECT lang, {marks} FROM (SELECT lang, dim, z, sum(n) OVER (PARTITION BY lang, dim) AS total,
  sum(n) OVER (PARTITION BY lang, dim ORDER BY z) AS upto FROM cells) GROUP BY lang),
lang0 AS MATERIALIZED (SELECT lang, {_plain(', '.join(q.start_sql()))} FROM marks)"""


def _step(before: str, after: str, keys: list[str], prior: str | None) -> str:
    by = ", ".join(keys)
    pairs = ", ".join(f"sum(z{i} * z{j}) AS q{i}_{j}" for i, j in q.PAIRS)
    singles = ", ".join(f"sum(z{i}) AS s{i}" for i in q.DIMS)
    rows = _chain(f"(SELECT * FROM stats JOIN {before} USING ({by}))", q.distance_sql())
    running = ", ".join(f"sum({c}) OVER (PARTITION BY {by} ORDER BY class) AS {c}" for c in ["n", *q.SUMS])
    base = f"(SELECT * FROM (SELECT {by}, class, sum(n) OVER (PARTITION BY {by}) AS total, {running} FROM (SELECT {by}, {_plain(q.CLASS_SQL)} AS class, count(*) AS n, {singles}, {pairs} FROM {rows} GROUP BY ALL)) WHERE n >= {q.KEPT_SHARE} * total QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY class) = 1)"
    if prior:
        pick = ", ".join([f"m{i} AS pm{i}" for i in q.DIMS] + [f"c{i}_{j} AS pc{i}_{j}" for i, j in q.PAIRS])
        base = f"(SELECT * FROM {base} JOIN (SELECT lang, {pick} FROM {prior}) USING (lang))"
    made = _chain(base, ((n, _plain(t)) for n, t in q.estimate_sql(prior is not None)))
    return f"{after} AS MATERIALIZED (SELECT {by}, {', '.join(q.ESTIMATE)} FROM {made})"


def quality_sql() -> str:
    parts = [_counts(), _start()]
    for k in range(q.STEPS):
        parts.append(_step(f"lang{k}", f"lang{k + 1}", ["lang"], None))
    last = f"lang{q.STEPS}"
    parts.append(f"group0 AS MATERIALIZED (SELECT DISTINCT source, {last}.* FROM stats JOIN {last} USING (lang))")
    for k in range(q.STEPS):
        parts.append(_step(f"group{k}", f"group{k + 1}", ["lang", "source"], last))
    rows = _chain(f"(SELECT * FROM stats JOIN group{q.STEPS} USING (lang, source))", q.distance_sql())
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, "
        f"{failed} AS base_failed, (NOT {failed} AND d2 <= {q.CUTOFF}) AS kept FROM {rows}"
    )
