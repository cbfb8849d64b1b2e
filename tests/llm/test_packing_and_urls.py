import random

import numpy as np
import pytest
from corpus import ODD, frame, words
from pyspark.sql import functions as F

from tabloom.llm import packing, url_filter


def brute_pack(lengths, sources, clusters, capacity, per_source):
    """Best fit by looking at all bins."""
    bins, out, rest = [], [], []
    for row, length in enumerate(lengths):
        for piece in range(length // capacity):
            bins.append(None)
            out.append((row, piece, len(bins) - 1, 0, capacity))
        if length % capacity or not length:
            rest.append((length % capacity, row, length // capacity))
    for length, row, piece in sorted(rest, key=lambda x: (-x[0], x[1])):
        fit = [
            (b["room"], i)
            for i, b in enumerate(bins)
            if b and b["room"] >= length and clusters[row] not in b["clusters"] and b["sources"].count(sources[row]) < per_source
        ]
        if fit:
            _, i = min(fit)
        else:
            bins.append({"room": capacity, "clusters": set(), "sources": []})
            i = len(bins) - 1
        b = bins[i]
        out.append((row, piece, i, capacity - b["room"], length))
        b["room"] -= length
        b["clusters"].add(clusters[row])
        b["sources"].append(sources[row])
    return out


@pytest.mark.parametrize("seed", range(20))
def test_packing_equals_brute_force(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 150)
    capacity = rng.choice([10, 64])
    lengths = [rng.choice([0, rng.randint(0, capacity), rng.randint(0, 3 * capacity)]) for _ in range(n)]
    sources = [rng.choice("aaab") for _ in range(n)]
    clusters = [rng.choice([0, rng.randint(1, 99)]) for _ in range(n)]
    per = rng.randint(1, 3)
    assert packing.pack(lengths, sources, clusters, capacity, per) == brute_pack(lengths, sources, clusters, capacity, per)


@pytest.mark.parametrize("shard_docs", [1000, 7])
def test_packed_rows(spark, shard_docs):
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randint(0, 90))) for _ in range(60)] + ["copy of this"] * 20 + ODD
    docs = frame(spark, texts, [*range(len(texts) - 3), 5, None, None])
    rows = packing.pack_documents(docs, capacity=40, per_source=2, shard_docs=shard_docs).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((t or "").split()) for t in texts)
    used = {}
    for r in rows:
        used.setdefault((r["shard"], r["bin"]), []).append((r["bin_start"], r["bin_start"] + r["n_tokens"], r["doc_id"]))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 40 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert sum(x[2] is not None and 60 <= x[2] < 80 for x in own) <= 1  # copies never share a bin
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_cascade_is_exact(spark):
    rng = random.Random(2)
    hosts = sorted({f"{a}.{b}.example.org" for a in words(rng, 400) for b in "xy"})
    listed = set(rng.sample(hosts, 90))
    rows = spark.createDataFrame([(h,) for h in hosts + hosts[:50] + [""]] + [(None,)], "host string")
    member = F.col("host").isin(*listed)
    for pass_bytes in (1 << 20, 200):
        got = url_filter.listed_flags(rows, "host", member, pass_bytes).collect()
        assert len(got) == len(hosts) + 52 and all(r["listed"] == (r["host"] in listed) for r in got)
    a, b = (np.arange(1, 3000, dtype=np.uint64) * np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9))
    assert url_filter.walk([], a, b).sum() == 0


def test_url_rows(spark):
    rules = (url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "com", "/de/"))
    urls = [
        (None, "", "", None, "allow"),
        ("no scheme/x", "", "", None, "allow"),
        ("http://A.Example.ORG/es/1?x=/#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/eS/1", "example.org", "/eS/1", "org/", "allow"),
        ("https://borg", "borg", "", None, "allow"),
        ("https://x.org", "x.org", "", None, "allow"),
        ("x://y.com/de/?q=http://z", "y.com", "/de/", "com/de/", "block"),
        ("http://spam.net\n/a", "spam.net\n", "/a", None, "allow"),
        ("http://spam.net#f", "spam.net", "", None, "block"),
    ]
    pages = spark.createDataFrame([(k, u[0], "h", "x") for k, u in enumerate(urls)], "page_id long, url string, host string, listed string")
    got = url_filter.url_verdicts(pages, rules, F.col("host") == "spam.net").orderBy("page_id").collect()
    assert [tuple(r)[1:5] for r in got] == [u[1:] for u in urls]
    assert url_filter.url_verdicts(pages.limit(0), rules, F.lit(True)).count() == 0


def test_equal_rows_are_dealt_over_shards(spark):
    docs = frame(spark, [None] * 600 + ["a b"] * 300, [None] * 600 + [7] * 300)
    rows = packing.pack_documents(docs, shard_docs=100).collect()
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
    assert len(rows) == 900 and len(sizes) == 9 and max(sizes.values()) < 160
    places = {(r["shard"], r["bin"], r["doc_id"]) for r in rows}
    assert len(places) == 900  # copies never share a bin


def test_listed_keys_may_be_a_table(spark):
    rng = random.Random(21)
    keys = [None, "", *[f"host{i}.example" for i in range(400)]]
    rows = spark.createDataFrame([(i, rng.choice(keys)) for i in range(3000)], "page_id long, host string")
    for chosen in (set(rng.sample([k for k in keys if k], 150)), {""}, {None}, set()):
        table = spark.createDataFrame([(k,) for k in [*chosen, *chosen, "never.seen"]], "name string")
        listed = {k or "" for k in chosen}
        for pass_bytes in (url_filter.PASS_BYTES, 200):
            got = url_filter.listed_flags(rows, "host", table, pass_bytes).collect()
            assert len(got) == 3000 and all(r["listed"] == ((r["host"] or "") in listed) for r in got)
