import random
import re

import numpy as np
import pytest
from corpus import ODD, frame, words

import corpus_pipeline
from tabloom.llm import decontaminate, quality
from test_dedup import brute_components, brute_lines


def brute_counts(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(5)} if len(windows) < 2000 else None
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), None if again is None else len(again)


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ODD + [rng.choice([" ", "\n"]).join(rng.choice(["a", "b", "c#", "d|", "é", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for r in quality.counts(frame(spark, texts)).collect():
        want = brute_counts(texts[r["doc_id"]])
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got[:4] == want[:4] and want[4] in (None, got[4])


def test_chi_squared():
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.75, 6), 6) - 0.75) < 1e-9
    assert abs(quality.chi2_quantile(0.95, 1) - 3.8414588) < 1e-5


def test_outliers_go_and_others_stay(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randint(40, 300))) + "." for _ in range(150)]
    junk = [" ".join(w + "###" for w in words(rng, 80)) for _ in range(12)]
    docs = frame(spark, texts + junk + ODD)
    rows = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    assert len(rows) == len(texts + junk + ODD)
    assert all(rows[i]["kept"] for i in range(len(texts)))
    assert not any(rows[len(texts) + i]["kept"] for i in range(len(junk)))
    assert rows[len(texts + junk)]["base_failed"]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows.values())
    assert quality.quality_verdicts(frame(spark, [])).count() == 0


def test_estimate_is_the_one_of_numpy(spark):
    """The scatter from sums, its root and the distance, against numpy."""
    rng = np.random.default_rng(3)
    z = rng.integers(-500, 500, (40, len(quality.STATISTICS)))
    values = {"n": 40, **{f"s{i}": int(z[:, i].sum()) for i in quality.DIMS}}
    values |= {f"q{i}_{j}": int((z[:, i] * z[:, j]).sum()) for i, j in quality.PAIRS}
    values |= {f"z{i}": int(z[0, i]) for i in quality.DIMS}
    df = spark.range(1).selectExpr(*[f"{v}L AS {k}" for k, v in values.items()])
    row = quality._with(quality._with(df, quality.estimate_sql(False)), quality.distance_sql()).first()
    cov = quality.consistency() * np.cov(z.T, bias=True) + np.diag([(s[2] * quality.SCALE) ** 2 for s in quality.STATISTICS])
    d = z[0] - z.mean(axis=0)
    assert abs(row["d2"] - d @ np.linalg.solve(cov, d)) < 1e-6


def test_pipeline_equals_its_stages_done_by_hand(spark, tmp_path):
    rng = random.Random(4)
    shared = " ".join(words(rng, 8))
    texts = [" ".join(words(rng, rng.randint(30, 120))) + ("\n" + shared if k % 4 == 0 else "") for k in range(80)]
    texts += [t + " end" for t in texts[:6]] + [" ".join(w + "###" for w in words(rng, 60)) for _ in range(5)] + ODD
    item = " ".join(words(rng, 12)) + ". " + " ".join(words(rng, 8)) + "."
    texts[10] += " " + item
    docs = frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = sorted(r["doc_id"] for r in quality.quality_verdicts(docs).collect() if r["kept"])
    lines = [x[1] for x in brute_lines([texts[i] for i in good])]
    kept = [(i, t) for i, t, c in zip(good, lines, brute_components(lines)) if c[3]]
    clean = [(i, t) for i, t in kept if " ".join(decontaminate.terms_of(item)) not in " ".join(decontaminate.terms_of(t))]
    assert 10 in good and 10 not in dict(clean) and len(good) > len(kept) > len(clean)
    packed = {}
    for r in rows:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["n_tokens"]
    assert packed == {i: len(t.split()) for i, t in clean}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = frame(spark, ODD + ODD[-2:], [*range(len(ODD) - 1), None, None, 3])
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.collect()


def test_rows_without_id_are_judged_one_by_one(spark):
    rng = random.Random(12)
    good = [" ".join(words(rng, rng.randint(60, 200))) + "." for _ in range(60)]
    junk = [" ".join(w + "###" for w in words(rng, 80)) for _ in range(3)]
    item = " ".join(words(rng, 12)) + ". " + " ".join(words(rng, 8)) + "."
    leaking = good[0] + " " + item
    texts = [*good, good[1], *junk, None, leaking]
    ids = [*range(50), *[None] * 10, None, None, None, 70, None, None]
    docs = frame(spark, texts, ids)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in quality.keep_good(docs).collect())
    assert kept == sorted((str(i), t) for i, t in zip(ids, texts) if t is not None and t not in junk)
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    clean = decontaminate.drop_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in clean.collect()) == sorted((str(i), str(t)) for i, t in zip(ids, texts) if t != leaking)
