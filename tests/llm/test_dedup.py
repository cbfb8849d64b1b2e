import random

import numpy as np
import pytest
from corpus import ODD, frame, words

import corpus_pipeline
from tabloom.llm import line_dedup, near_dup, suffix_dedup


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    w = [x for part in w for x in part.replace("\t", "\n").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").split("\n") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                comp[b] = a
    return [(i, len(sets[i]), top(i), top(i) == i) for i in range(len(texts))]


def clouds(rng):
    """Copies with edits: some of a base, some of each other, some just beyond the similarity."""
    texts = []
    for size, edits in ((40, 3), (60, 5), (25, 8), (200, 6)):
        base = words(rng, size)
        last = base
        for k in range(25):
            w = list(base if k % 2 else last)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 3))
            last = w
            texts.append(" ".join(w))
    texts += [" ".join(words(rng, rng.randint(1, 9))) for _ in range(30)] + texts[:5] + [t.upper() for t in texts[5:8]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block, band", [(256, 2048), (4, 3)])
def test_components_equal_brute_force(spark, monkeypatch, block, band):
    monkeypatch.setattr(near_dup, "BLOCK_REPS", block)
    monkeypatch.setattr(near_dup, "BAND_REPS", band)
    texts = clouds(random.Random(block)) + ODD[:5] + ODD[6:]
    got = sorted(tuple(r) for r in near_dup.near_duplicates(frame(spark, texts)).collect())
    assert got == brute_components(texts)


def test_near_dup_rows(spark):
    texts = ["a b c d e f"] * 3 + [None, "", "a b c d e f"]
    docs = frame(spark, texts, [5, 5, 2, 9, 1, None])
    got = sorted(near_dup.near_duplicates(docs).collect(), key=str)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(5, 2, False), (2, 2, True), (9, 9, True), (1, 1, True), (None, None, True)}
    assert len(got) == 6
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "2", "9", "None"]
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    for overlap in (0.5, 0.85, 0.95):
        n = 2000
        common = rng.integers(0, 2**63, int(n * overlap), dtype=np.uint64) * np.uint64(2)
        pair = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64) * np.uint64(2)])) for _ in range(2)]
        true = len(np.intersect1d(*pair)) / len(np.union1d(*pair))
        begin = np.array([0, len(pair[0]), len(pair[0]) + len(pair[1])])
        regs = near_dup.registers(np.concatenate(pair), begin)
        guess, used = near_dup.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))
        assert used[0] == near_dup.BUCKETS and abs(guess[0] - true) < 5 * np.sqrt(true * (1 - true) / near_dup.BUCKETS)


def test_register_is_the_least_hash_compressed():
    h = np.array([3, (5 << 57) | (1 << 50), (5 << 57) | (1 << 55)], np.uint64)
    regs = near_dup.registers(np.sort(h), np.array([0, 3]))
    assert (regs != near_dup.EMPTY).sum() == 2 and regs[0, 5] >> near_dup.MANTISSA_BITS == 6


def brute_lines(texts):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    first, holders = {}, {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first.setdefault(k, i)
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and first[key(x)] != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    pool = ["short", "a line of ten and more", " A Line of TEN and more\t", "Äußerst lange Zeile", "", "another long line here", "0123456789", "012345678"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8))) for _ in range(60)] + ODD
    rows = line_dedup.drop_shared_lines(frame(spark, texts)).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in rows) == brute_lines(texts)
    assert line_dedup.drop_shared_lines(frame(spark, [])).count() == 0
    same = line_dedup.drop_shared_lines(frame(spark, [pool[1]] * 3, [4, 4, None])).collect()
    assert all(r["n_dropped"] == 0 for r in same)


def brute_windows(pieces, length):
    seen = {}
    for p in pieces:
        for i in range(len(p) - length + 1):
            seen[p[i : i + length]] = seen.get(p[i : i + length], 0) + 1
    return [np.array([seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)], bool) for p in pieces]


def test_search_equals_brute_force():
    rng = random.Random(9)
    for trial in range(150):
        length = rng.choice([3, 5, 8, 16])
        letters = b"ab" if trial % 2 else b"abcdefgh"
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        pieces += [pieces[0]] * (trial % 3 == 0)
        for a, b in zip(suffix_dedup.repeated_starts(pieces, length), brute_windows(pieces, length)):
            assert np.array_equal(a, b)


@pytest.mark.parametrize("group", [64, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(10)
    passage = " ".join(words(rng, 120))
    texts = []
    for _ in range(40):
        text = " ".join(words(rng, rng.randint(5, 150)))
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, 250)
            text += " ä " + passage[a : a + rng.randint(300, 700)] + " ".join(words(rng, 20))
        texts.append(text)
    texts += [texts[3], texts[4][:-30] + "z", "ab" * 700, "ab" * 400, None, ""]
    data = [(t or "").encode() for t in texts]
    want = []
    for i, (d, m) in enumerate(zip(data, brute_windows(data, 400))):
        gone = np.zeros(len(d), bool)
        for p in np.flatnonzero(m):
            gone[p : p + 400] = True
        want.append((i, len(d), int(gone.sum()), len(suffix_dedup.runs(gone)), np.frombuffer(d, np.uint8)[~gone].tobytes()))
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect())
    assert got == want
    assert sum(r[2] for r in want) > 5000


def test_repeat_rows(spark):
    long = " ".join(words(random.Random(1), 100))
    got = suffix_dedup.remove_repeats(frame(spark, [long, long, long, None], [7, 7, None, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in got) == [("7", True), ("7", True), ("None", False), ("None", True)]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_a_row_takes_its_own_spans_only(spark):
    rng = random.Random(12)
    alone, other = " ".join(words(rng, 200)), " ".join(words(rng, 200))
    got = suffix_dedup.remove_repeats(frame(spark, [alone, other, "x " + other[:550]], [5, 5, 9])).collect()
    assert sorted((r["doc_id"], r["n_bytes"] == len(alone), r["n_removed"]) for r in got if len(alone) != len(other)) == sorted(
        [(5, True, 0), (5, False, 550), (9, False, 550)]
    )


def test_bands_of_any_size_lose_no_link_of_short_texts(spark, monkeypatch):
    rng = random.Random(13)
    texts = []
    for _ in range(40):
        line = words(rng, 24)
        texts += [" ".join(line[i : i + n]) for n in (10, 11) for i in range(14)]
    want = brute_components(texts)
    assert len({c for _, _, c, _ in want}) < len(texts)
    for most in (6, 3):
        monkeypatch.setattr(near_dup, "BAND_REPS", most)
        assert sorted(tuple(r) for r in near_dup.near_duplicates(frame(spark, texts)).collect()) == want


def test_short_sets_meet_under_what_they_share():
    for similarity in (80, 85, 95):
        most = near_dup.short_limit(similarity)
        assert (100 - similarity) * most // 100 == 2 and (100 - similarity) * (most + 1) // 100 == 3


def test_many_shared_lines_take_time_in_proportion(spark):
    import time

    def seconds(n):
        text = "\n".join(f"shared line number {i}" for i in range(n))
        start = time.monotonic()
        rows = line_dedup.drop_shared_lines(frame(spark, [text, text + "\nown line of this one"])).collect()
        assert sorted((r["n_lines"], r["n_dropped"]) for r in rows) == [(n, 0), (n + 1, n)]
        assert [r["text"] for r in rows if r["n_dropped"]] == ["own line of this one"]
        return time.monotonic() - start

    seconds(1000)
    assert seconds(40_000) < 20  # an array looked up line by line took 35 s for half of this


def test_line_rows_under_one_doc_id_keep_their_own_places(spark):
    first, second = "a shared line here\nmine alone, all of it", "nothing of theirs\nand more\na shared line here"
    docs = frame(spark, ["a shared line here", first, second], [1, 5, 5]).withColumnsRenamed({"root": "_drop", "key": "_lines", "n": "_rest"})
    rows = line_dedup.drop_shared_lines(docs).collect()
    assert sorted(r["text"] for r in rows) == ["a shared line here", "mine alone, all of it", "nothing of theirs\nand more"]
    assert {r["_drop"] for r in rows} == {"x"} and {r["_lines"] for r in rows} == {7}


def linked_at(texts, similarity):
    """doc_ids of each component of texts under a similarity in hundredths, by all pairs."""
    sets = [shingles(t) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similarity * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    return comp


def test_similarity_is_an_argument(spark):
    rng = random.Random(11)
    texts = clouds(rng)
    for n in (30, 54, 100, 300):  # a changed tail: at 0.80 and above, but below 0.85
        base = words(rng, n + 4)
        changed = n - round(n / 1.11)
        texts += [" ".join(base), " ".join(base[:-changed] + words(rng, changed))]
        x, y = shingles(texts[-2]), shingles(texts[-1])
        assert 80 * len(x | y) <= 100 * len(x & y) < 85 * len(x | y)
    docs = frame(spark, texts)
    for similarity in (85, 80):
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, similarity).collect()}
        assert [got[i] for i in range(len(texts))] == linked_at(texts, similarity)
    want = [i for i, c in enumerate(linked_at(texts, 80)) if i == c]
    assert sorted(r["doc_id"] for r in near_dup.keep_first(docs, 80).collect()) == want
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
