import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import ODD, frame, words

from tabloom.llm import decontaminate, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_blocks_come_back(monkeypatch):
    rng = np.random.default_rng(1)
    for sizes in ([1], [1, 1], [300, 5, 70_000], [128, 129, 127], [9000] * 3):
        blocks = [[rng.choice([rng.integers(0, 49_408, n), rng.zipf(1.3, n) % 49_408]).astype(np.uint16), np.array([1], np.uint16)] for n in sizes]
        back = token_files.unpack_blocks(token_files.pack_blocks(blocks))
        assert all(np.array_equal(a, b) for x, y in zip(blocks, back) for a, b in zip(x, y))


def test_coder_shrinks_what_it_can_predict():
    ids = np.tile(np.array([7, 900, 31, 4], np.uint16), 20_000)
    assert len(token_files.pack_blocks([[ids]])[0]) < 0.1 * 2 * len(ids)


def test_damage_is_seen():
    data = token_files.pack_blocks([[np.arange(500, dtype=np.uint16)]])[0]
    for at in (0, 20, 40, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack_blocks([bytes(bad)])


def test_pieces_encode_like_whole_texts(tokenizer):
    rng = random.Random(3)
    parts = ["It's", "don't.", "end!!!", "É.", "e\u0301,", "ΑΣ.", "ΑΣ", "<|endoftext|>", "<|ENDOFTEXT|>", "a\u00a0b", "x,y", "…", "ß?", " ", "\n", "\r\n", "\t", "İ;", "123.", "日本。", "'", "'s", ".s"]
    texts = [rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    encode = token_files.Encoder(tokenizer)
    for batch in (texts[:400], texts[400:]):
        ids, edge = encode(pa.array(batch, pa.string()))
        for k, t in enumerate(batch):
            assert ids[edge[k] : edge[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1], repr(t)


def test_pieces_that_were_forgotten_come_back(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 40)
    rng = random.Random(5)
    parts = ["tion", "É", "été", "ß", "à", "í", "ÿ", "x", "qu", "ing"]
    odd = ["end!!!", "a###", "b$$$ c", "x-y)", "d|", "e\u0301...", "1|2", "don't***", "'s###", "<|endoftext|> f|"]
    texts = [" ".join(rng.choice(odd) if rng.random() < 0.2 else "".join(rng.choices(parts, k=3)) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    encode = token_files.Encoder(tokenizer)
    assert encode.of_letters is not None
    for at in range(0, 120, 20):
        ids, edge = encode(pa.array(texts[at : at + 20], pa.string()))
        for k, t in enumerate(texts[at : at + 20]):
            assert ids[edge[k] : edge[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1], repr(t)
        assert len(encode.number) == len(encode.size) == len(encode.again)


def test_a_word_of_letters_skips_the_steps_that_leave_it_as_it_is(tokenizer):
    """The calls that made the cost: a new word went through every step of the tokenizer on its own."""
    encode, calls = token_files.Encoder(tokenizer), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    encode.tokenizer = Counted()
    encode(pa.array(["one two three### four, Ünïque été", "and 5 x-y"]))
    assert not [t for t in calls if t.isalpha()]


def test_ids_as_bytes_are_the_ids(spark, tokenizer, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(frame(spark, ["one two", None, "x" * 700, "É, ß###"], [5, 3, None, 5]), path, PATH)
    lists = {(r.start, r.n_tokens, tuple(r.ids)) for r in token_files.read_token_files(spark, path).collect()}
    raw = token_files.read_token_files(spark, path, as_bytes=True)
    assert {(r.start, r.n_tokens, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in raw.collect()} == lists
    same = token_files.with_checksums(token_files.read_token_files(spark, path))
    assert sorted(map(tuple, token_files.with_checksums(raw).collect()), key=str) == sorted(map(tuple, same.collect()), key=str)
    assert token_files.with_checksums(raw)._jdf.queryExecution().toString().count("MapInArrow") < same._jdf.queryExecution().toString().count("MapInArrow")


def test_lanes_side_by_side_are_coded_like_alone():
    rng = np.random.default_rng(8)
    blocks = [[(rng.zipf(1.2, n) % 49_408).astype(np.uint16)] for n in (50_000, 1, 513, 8 * 512, 8 * 512 + 1, 200_000, 4097)]
    together = token_files.pack_blocks(blocks)
    assert together == [token_files.pack_blocks([b])[0] for b in blocks]
    rare = [[np.full(60_000, 49_407, np.uint16)], [np.arange(49_408).astype(np.uint16)[::-1].copy()]]  # carries, and ids that were never seen
    for some in (blocks, rare):
        back = token_files.unpack_blocks(token_files.pack_blocks(some))
        assert all(np.array_equal(a, b) for x, y in zip(some, back) for a, b in zip(x, y))


def test_files_come_back(spark, tokenizer, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randint(0, 200))) for _ in range(50)] + ODD
    ids = list(range(len(texts) - 2, -2, -1))
    ids[ids.index(-1)] = None
    path = str(tmp_path / "files")
    token_files.write_token_files(frame(spark, texts, ids), path, PATH)
    rows = token_files.with_checksums(token_files.read_token_files(spark, path)).orderBy("start").collect()
    start = 0
    for row, (i, t) in zip(rows, sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0]))):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert tuple(row) == (i, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert len(rows) == len(texts)
    empty = str(tmp_path / "none")
    token_files.write_token_files(frame(spark, []), empty, PATH)
    assert token_files.read_token_files(spark, empty).count() == 0


def _index(items, stride=40):
    terms = [decontaminate.terms_of(t) for t in items]
    frequency = {}
    for own in terms:
        for t in set(own):
            frequency[t] = frequency.get(t, 0) + 1
    return decontaminate.make_index(list(enumerate(items)), frequency, len(items), sum(map(len, terms)) / len(items), stride)


def test_search_retrieves_what_all_postings_give():
    rng = random.Random(5)
    vocabulary = words(rng, 60)
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25))) for _ in range(90)]
    index = _index(items)
    names = index.vocabulary.to_pylist()
    for _ in range(200):
        terms = sorted(rng.sample(range(len(names)), rng.randint(0, 40)))
        sums = {}
        for t in terms:
            for i, w in zip(*index.postings[t]):
                sums[int(i)] = sums.get(int(i), 0.0) + float(w)
        want = {i: s for i, s in sums.items() if s >= 0.3}
        got = dict(index.search(terms, 0.3))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_batches_find_every_item(monkeypatch):
    rng = random.Random(6)
    pool = words(rng, 300)
    items = [". ".join(" ".join(rng.choice(pool) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 3))) + "." for _ in range(40)]
    longest = max(len(decontaminate.terms_of(t)) for t in items)
    index = _index(items, longest)
    texts, want = [], set()
    for k in range(120):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 400))]
        if k % 3 == 0:
            item = rng.randrange(len(items))
            at = rng.randint(0, len(text))
            text[at:at] = [items[item].upper() if k % 2 else items[item]]
            want.add((k, item))
        texts.append(" ".join(text))
    found = decontaminate.leaks_of(index, pa.array(texts, pa.string()))
    assert {(f[0], f[1]) for f in found} == want
    assert all(abs(f[2] - 1) < 1e-9 and f[3] == f[4] == 1 for f in found)


def test_leak_rows(spark, monkeypatch):
    item = "What is the name of the red thing. It is called zorblax of old."
    texts = ["before " * 50 + item + " after" * 60, item.lower(), "What is the name of the red thing", None, "", "nothing here at all"]
    docs = frame(spark, texts, [1, 2, 3, 4, 5, None])
    bench = spark.createDataFrame([(1, item, 0.0), (2, None, 0.0), (3, "", 0.0), (4, "other words that nobody has. none.", 0.0), (1, item, 0.0)], "item_id long, text string, score double")
    for size in (1 << 20, 40):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()) == [(1, 1), (2, 1)]
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 4
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
