"""The registered corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.llm import (
    decontaminate,
    infill,
    language,
    line_dedup,
    merkle,
    near_dup,
    packing,
    pii,
    quality,
    quality_sql,
    secrets,
    spans,
    suffix_dedup,
    token_files,
    url_filter,
)
from tabloom.llm.text import ascii_lower, read_table, sha256_of, whole_text
from tabloom.plans.registry import Catalog
from tabloom.session import shared_path


def quality_query(spark, sf_dir):
    return quality.quality_verdicts(read_table(spark, sf_dir, "documents")).drop("d2")


def line_query(spark, sf_dir):
    kept = line_dedup.drop_shared_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_of(whole_text()).alias("kept_sha256"))


LINE_SQL = r"""
WITH lines AS (SELECT doc_id, p, string_split(t, chr(10))[p] AS line
  FROM (SELECT doc_id, coalesce(text, '') AS t, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents)),
keyed AS (SELECT *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT y.*, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM keyed y LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)
# The listed names; a host with one of them as a label is listed.
LISTED = ("ads-track", "adult-x", "cheap-pills", "free-bets", "spam-farm")
LISTED_HOST = r"(^|\.)(" + "|".join(LISTED) + r"|casino[a-z0-9-]*)(\.|$)"


def url_query(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    hosts = pages.select(url_filter.url_parts(F.col("url"))[0].alias("host"))
    return url_filter.url_verdicts(pages, RULES, hosts.where(F.col("host").rlike(LISTED_HOST)))


URL_SQL = rf"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(verdict, h, p) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '{LISTED_HOST}') THEN 'block' ELSE 'allow' END) AS verdict,
  regexp_matches(host, '{LISTED_HOST}') AS listed
FROM parts LEFT JOIN fit USING (page_id)
"""


def secret_query(spark, sf_dir):
    found = secrets.secret_spans(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])],
        sha256_of(spans.joined(F.col("base"), secrets.KINDS, by_start=True)).alias("base_sha256"),
        spans.joined(F.col("spans"), secrets.KINDS, by_start=True).alias("spans"),
    )


def pii_query(spark, sf_dir):
    found = pii.pii_spans(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        sha256_of(spans.joined(F.col("base"), pii.KINDS, by_start=False)).alias("base_sha256"),
        spans.joined(F.col("spans"), pii.KINDS, by_start=False).alias("spans"),
    )


def packing_query(spark, sf_dir):
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def leak_query(spark, sf_dir):
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def near_dup_query(spark, sf_dir):
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), 85)


NEAR_DUP_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM (
  SELECT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM words WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (SELECT i.a, i.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) i
  JOIN sizes s ON s.doc_id = i.a JOIN sizes t ON t.doc_id = i.b WHERE 100 * c >= 85 * (s.n + t.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(b), w.doc_id)) AS component_id,
  w.doc_id <= coalesce(min(b), w.doc_id) AS kept
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""


def token_query(spark, sf_dir):
    import public_tokenizers

    path = shared_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("word_bpe_49k.json")))
    return token_files.with_checksums(token_files.read_token_files(spark, path, as_bytes=True))


def repeat_query(spark, sf_dir):
    rest = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


REPEAT_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 800)) AS g
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d WHERE len(h) >= 800)),
again AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked) GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(len(h)) // 2 FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
rest AS (SELECT doc_id, string_agg(substr(h, (2 * x + 1)::BIGINT, (2 * (y - x))::BIGINT), '' ORDER BY x) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d JOIN rest USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


def infill_query(spark, sf_dir):
    forms = infill.fill_in_middle(read_table(spark, sf_dir, "documents"))
    return forms.withColumn("output_sha256", sha256_of(F.col("output"))).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        "output_sha256",
        sha256_of(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


INFILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS h FROM documents),
drawn AS (SELECT doc_id, t, length(t) AS n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS r FROM d),
cut AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
    WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def merkle_query(spark, sf_dir):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    found = merkle.merkle_manifest(read_table(spark, sf_dir, "documents"), tampered)
    proof = sha256_of(merkle.proof_text(F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256(concat({', '.join(parts)}))"


# The crc32 is folded bit by bit; 3988292384 is its polynomial, 0xEDB88320, and 4294967295 its start and end mask.
MERKLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)), lambda y, k: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS crc FROM documents GROUP BY doc_id),
leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, {_leaf_sql("text")} AS h,
  CASE WHEN crc % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS copy
  FROM documents JOIN crc USING (doc_id)),
tree(l, g, i, h, n) AS (SELECT 0, g, i, h, count(*) OVER (PARTITION BY g) FROM leaves
  UNION ALL SELECT l + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY l, g, i // 8),
subroots AS (SELECT g, h, l, row_number() OVER (ORDER BY g) - 1 AS i FROM tree WHERE n = 1),
top(l, i, h, n) AS (SELECT 0, i, h, count(*) OVER () FROM subroots
  UNION ALL SELECT l + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY l, i // 8),
runs AS MATERIALIZED (SELECT l, g, i // 8 AS r, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY l, g, i // 8
  UNION ALL SELECT s.l + t.l, s.g, t.r, t.hs FROM (SELECT l, i // 8 AS r, list(h ORDER BY i) AS hs, list(i) AS members FROM top WHERE n > 1 GROUP BY l, i // 8) t
    JOIN subroots s ON s.i // (8 ** (t.l + 1))::BIGINT = t.r),
fold(l, doc_id, g, i, s, h, proof) AS (SELECT 0, doc_id, leaves.g, leaves.i, subroots.i, copy, '' FROM leaves JOIN subroots USING (g)
  UNION ALL SELECT f.l + 1, doc_id, f.g, CASE WHEN f.l + 1 = sub.l THEN s ELSE f.i // 8 END, s,
    sha256(array_to_string(hs[1 : f.i % 8], '') || f.h || array_to_string(hs[f.i % 8 + 2 :], '')),
    proof || array_to_string(hs[1 : f.i % 8], '') || array_to_string(hs[f.i % 8 + 2 :], '')
  FROM fold f JOIN subroots sub ON sub.g = f.g JOIN runs ON runs.l = f.l AND runs.g = f.g AND runs.r = f.i // 8),
ends AS (SELECT doc_id, arg_max(h, l) AS folded_root, sha256(arg_max(proof, l)) AS proof_sha256 FROM fold GROUP BY doc_id)
SELECT doc_id, leaves.h AS leaf, subroots.h AS subroot, top.h AS root, proof_sha256, folded_root, folded_root = top.h AS verified
FROM leaves JOIN subroots USING (g) JOIN ends USING (doc_id) CROSS JOIN (SELECT h FROM top WHERE n = 1) top
"""


def language_query(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return language.predict_languages(docs, language.fit_languages(docs))


def register(catalog: Catalog) -> None:
    catalog.add("op1_pii", pii_query)
    catalog.add("op2_near_dup", near_dup_query, NEAR_DUP_SQL)
    catalog.add("op3_packing", packing_query)
    catalog.add("op4_line_dedup", line_query, LINE_SQL)
    catalog.add("op5_suffix_dedup", repeat_query, REPEAT_SQL)
    catalog.add("op6_url_filter", url_query, URL_SQL)
    catalog.add("op7_quality_rules", quality_query, quality_sql.quality_sql())
    catalog.add("op8_secret_scan", secret_query)
    catalog.add("op9_token_files", token_query)
    catalog.add("op10_decontamination", leak_query)
    catalog.add("op11_infill", infill_query, INFILL_SQL)
    catalog.add("op12_merkle", merkle_query, MERKLE_SQL)
    catalog.add("op13_language_id", language_query)
