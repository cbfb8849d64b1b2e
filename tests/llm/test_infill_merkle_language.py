"""Fill-in-the-middle, the manifest and language identification against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from corpus import ODD, SCHEMA, frame, words
from pyspark.sql import functions as F

from tabloom.llm import infill, language, merkle
from tabloom.llm.text import read_table

# ---------------------------------------------------------------- fill in the middle


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def infill_texts():
    rng = random.Random(3)
    own = ["".join(rng.choice("aé🍎ß \n<PSM>") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*ODD, "has <S> in it", "a<S", "<<P>", "🍎" * 70_000, "́e͞" * 9, *own]


def check_infill(spark, texts, ids):
    found = infill.fill_in_middle(frame(spark, texts, ids))
    rows = found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((repr(r[0]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows)
    wanted = sorted((repr(i), *by_hand(i, t)) for i, t in zip(ids, texts, strict=True))
    assert [repr(g) for g in got] == [repr(w) for w in wanted]
    assert sorted(r["back"] for r in rows) == sorted(t or "" for t in texts)


def test_infill_equals_slices(spark):
    texts = infill_texts()
    check_infill(spark, texts, [None, 7, 7, *range(100, 97 + len(texts))])


def test_long_texts_are_cut_in_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(infill, "LOT_BYTES", 64)
    text = "aé🍎ß" * 100
    found = infill._long_pieces(text, pa.array([33]), pa.array([301]))
    assert [p[0].as_py() for p in found] == [text[:33], text[33:301], text[301:]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([text, "short"]), pa.array([400, 5]), pa.array(["psm", "spm"]), pa.array([33, 1]), pa.array([301, 2])],
        names=["doc_id", "text", "n", "form", "low", "high"],
    )
    out = [r for b in infill._rearranged([batch]) for r in b.column("output").to_pylist()]
    assert out == [f"<P>{text[:33]}<S>{text[301:]}<M>{text[33:301]}", "<S>ort<P>s<M>h"]


def test_infill_of_an_empty_table(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


# ---------------------------------------------------------------- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node its path of (left, right)."""
    paths = [[] for _ in nodes]
    places = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
            places[k] = at // 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def manifest_by_hand(rows, copies):
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(row["lang"], []).append(k)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = [leaf(r, r["text"]) for r in rows]
    for g in groups:
        groups[g].sort(key=lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, leaves[k]))
    subs = {g: tree([leaves[k] for k in groups[g]]) for g in order}
    root, over = tree([subs[g][0] for g in order])
    result = []
    for g, above in zip(order, over, strict=True):
        for k, path in zip(groups[g], subs[g][1], strict=True):
            node = leaf(rows[k], copies[k])
            for left, right in path + above:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path + above))
            result.append((rows[k]["doc_id"], leaves[k], subs[g][0], root, proof, node, node == root))
    return sorted(result, key=repr)


def check_manifest(spark, rows):
    copies = [t and t.lower() if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t for i, t in ((r["doc_id"], r["text"]) for r in rows)]
    schema = "doc_id long, source string, lang string, n_chars long, text string, g string, h long, rank string, path string"
    docs = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], "x", 1, "y", "z") for r in rows], schema)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    found = merkle.merkle_manifest(docs, tampered)
    got = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256), "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest_by_hand(rows, copies)


def doc(i, lang, text="Some Text", source="s"):
    return {"doc_id": i, "source": source, "lang": lang, "n_chars": None if text is None else len(text), "text": text}


@pytest.mark.parametrize("size", [1, 7, 8, 9, 64, 65, 513, 600])
def test_manifest_of_one_language(spark, size):
    check_manifest(spark, [doc(3 * i, "en", f"Text {i}") for i in range(size)])


def test_manifest_of_many_languages_with_nulls_and_ties(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rng = random.Random(4)
    langs = [None, "", "en", "ä", "z", *[f"l{k}" for k in range(90)]]
    rows = [doc(rng.choice([None, *range(400)]), rng.choice(langs[:5] * 20 + langs), rng.choice(["A b", None, "", "Äß🍎"]), rng.choice([None, "s"])) for _ in range(700)]
    check_manifest(spark, rows + [doc(5, "en", "same")] * 40)


def test_manifest_of_an_empty_table(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


# ---------------------------------------------------------------- languages


def test_slices_give_the_same_trigrams(monkeypatch):
    texts = ["Straße 9 über", "", "a", "xy" * 50, "- -", "🍎b🍎 cde\nf"]

    def counted():
        total = np.zeros((len(texts), 64))
        for row, bucket in language.trigrams(texts, 64):
            np.add.at(total, (row, bucket), 1)
        return total

    whole = counted()
    assert whole.sum(axis=1).tolist() == [10, 0, 1, 100, 0, 5]
    monkeypatch.setattr(language, "LOT_UNITS", 5)
    assert (counted() == whole).all()


def test_trigrams_are_those_of_a_loop():
    rng = random.Random(5)
    text = "".join(rng.choice("abÄß 1-🍎") for _ in range(200))
    low = [c.lower() if c.isalpha() else "\0" for c in f" {text} "]
    plain = {}
    for a, b, c in zip(low, low[1:], low[2:]):
        if b != "\0":
            plain[a + b + c] = plain.get(a + b + c, 0) + 1
    buckets = {}
    for key, count in plain.items():  # a trigram on its own, letters and ends as they are
        (_, found), = language.trigrams([key.replace("\0", " ")], 1 << 16)
        bucket = found[int(key[0] != "\0")]  # the one around the middle letter
        buckets[bucket] = buckets.get(bucket, 0) + count
    (_, all_found), = language.trigrams([text], 1 << 16)
    values, counts = np.unique(all_found, return_counts=True)
    assert dict(zip(values.tolist(), counts.tolist())) == {int(k): v for k, v in buckets.items()}


def test_held_out_accuracy(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit_languages(docs)
    assert model.pairs == (("de", "en"), ("es", "fr"))
    held = language.predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, rows, least, most = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert rows > 30 and right >= 0.97 and 0 <= least <= most <= 1


def test_neither_lang_nor_source_decides_and_held_out_rows_teach_nothing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit_languages(docs)
    hidden = docs.withColumn("lang", F.when(language.is_held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    again = language.fit_languages(hidden)
    assert again.members == model.members and np.allclose(again.pair_weights, model.pair_weights)
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    assert sorted(language.predict_languages(docs, model).collect()) == sorted(language.predict_languages(other, model).collect())


def test_odd_rows_get_a_defined_answer(spark):
    rng = random.Random(6)
    texts = [*ODD, "123 !?", "ωμέγα", *[" ".join(words(rng, 20)) for _ in range(30)]]
    docs = frame(spark, texts, [None, 5, 5, *range(10, 7 + len(texts))])
    model = language.fit_languages(docs)
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict_languages(docs, model).collect()}
    assert {(None, "und", 0.0), (5, "und", 0.0)} <= rows
    assert {r[1] for r in rows} == {"und", "en"} and all(r[2] in (0.0, 1.0) for r in rows)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit_languages(unlabelled) is None
    assert {r["lang_pred"] for r in language.predict_languages(docs, None).collect()} == {"und"}
    empty = spark.createDataFrame([], SCHEMA)
    assert language.predict_languages(empty, language.fit_languages(empty)).collect() == []


def test_three_relatives_and_a_language_of_its_own(spark):
    rng = random.Random(7)
    letters = {"fr": "abcde", "es": "cdefg", "it": "efghi", "ja": "stuvw"}
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(letters))
        text = " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(30))
        rows.append((i, text, lang, "s", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language.fit_languages(docs)
    assert model.families == ("only ja", "romance") and len(model.pairs) == 3
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict_languages(docs, model).collect()}
    assert all(found[r[0]] == r[2] for r in rows)
