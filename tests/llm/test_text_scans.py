import itertools
import math
import random
import re

import numpy as np
from corpus import ODD, frame

from tabloom.llm import pii, secrets

ALPHABET = "a1 9.@-+()_\n0é:=\"'AKI"


def naive(pattern, text):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text)]


def test_pii_base_rules_equal_plain_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a1 2.@-+()_\n0é") for _ in range(rng.randint(0, 70)))
        if rng.random() < 0.3:
            text += rng.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "1.2.3.4.5.6.7.8", "300.1.1.1", "x.y@b.c.d"])
        want = [(0, *s) for s in naive(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(1, *s) for s in naive(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in text[slice(*s)].split("."))]
        for s in naive(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub(r"[^0-9]", "", text[slice(*s)])
            if 16 <= len(digits) <= 19 and pii.luhn(digits):
                want.append((2, *s))
        want += [(3, *s) for s in naive(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", text[slice(*s)])) <= 15]
        assert pii.base_spans(text) == want, text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1 " * 70_000, "@" * 200_000, "a1" * 100_000):
        pii.base_spans(text)
        secrets.base_spans(text)


def test_windows_cover_every_anchor():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abcdef  \n1@") if rng.random() < 0.1 else "w" for _ in range(rng.randint(0, 900)))
        spans = list(pii.windows(text))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all(any(s <= m.start() < e for s, e in spans) for m in re.finditer("[0-9@]", text))


def test_best_path_is_the_best_segmentation():
    rng = np.random.default_rng(1)
    for window in ("call +1 743 555-3824 now", "ip 10.0.0.1 or a@b.c", "12 34 56"):
        weights = rng.normal(0.3, 1.0, (len(pii.KINDS), len(pii.NAMES)))
        n, found = pii.segments(window)
        scores = pii._scores(weights, found)
        tops = [float(s.max()) if s.max() >= pii.LEAST_ODDS else -math.inf for s in scores]
        best = 0.0
        for size in range(1, 4):
            for pick in itertools.combinations(range(len(found)), size):
                ordered = sorted(pick, key=lambda k: found[k][0])
                if all(found[a][1] <= found[b][0] for a, b in zip(ordered, ordered[1:])):
                    best = max(best, sum(tops[k] for k in ordered))
        path = pii.best_path(weights, window)
        by_place = {(s[2], s[3]): k for k, s in enumerate(found)}
        assert abs(sum(tops[by_place[s, e]] for _, s, e in path) - best) < 1e-9 or len(path) > 3


def field(rng, mean=0.3):
    return rng.normal(mean, 1.0, (len(pii.KINDS), len(pii.NAMES) + len(pii.KINDS) + 1))


def paths(found, at=0):
    """All sets of candidates that do not overlap, in order."""
    yield ()
    for k, s in enumerate(found):
        if s[0] >= at:
            yield from ((k, *rest) for rest in paths(found, s[1]))


def test_best_path_weighs_the_entity_before():
    rng = np.random.default_rng(4)
    for trial in range(12):
        for window in ("12 a@b.c 34", "1 a2 b3 c4 d5", "10.0.0.1"):
            weights = field(rng)
            n, found = pii.segments(window)
            scores, follow = pii._scores(weights, found), pii._follow(weights)
            best = 0.0
            for path in paths(found):
                for kinds in itertools.product(range(len(pii.KINDS)), repeat=len(path)):
                    odds = [scores[k, c] + follow[c, b] for k, c, b in zip(path, kinds, (0, *(c + 1 for c in kinds)))]
                    if all(o >= pii.LEAST_ODDS for o in odds):
                        best = max(best, sum(odds))
            place, total, before = {(s[2], s[3]): k for k, s in enumerate(found)}, 0.0, 0
            got = pii.best_path(weights, window)
            for kind, start, end in got:
                odds = scores[place[start, end], kind] + follow[kind, before]
                assert odds >= pii.LEAST_ODDS
                total, before = total + odds, kind + 1
            assert all(a[2] <= b[1] for a, b in zip(got, got[1:])) and abs(total - best) < 1e-9


def test_likelihood_sums_over_all_paths():
    rng = np.random.default_rng(5)
    weights = field(rng)
    n, found = pii.segments("1 a2 b@c.d")
    scores, follow = pii._scores(weights, found), pii._follow(weights)
    every = [
        sum(scores[k, c] + follow[c, b] for k, c, b in zip(path, kinds, (0, *(c + 1 for c in kinds))))
        for path in paths(found)
        for kinds in itertools.product(range(len(pii.KINDS)), repeat=len(path))
    ]
    assert abs(pii.log_likelihood(weights, n, found, {}) + np.logaddexp.reduce(every)) < 1e-9


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(6)
    weights = field(rng, 0.0)
    n, found = pii.segments("mail a@b.c, card 4111 1111 1111 1111 or +1 743 555-3824")
    gold = {(5, 10): 0, (17, 36): 2, (40, 55): 3}
    assert set(gold) <= {(s[2], s[3]) for s in found}
    grad = pii._gradient(weights, n, found, gold)
    for _ in range(60):
        at = (rng.integers(weights.shape[0]), rng.integers(weights.shape[1]))
        step = np.zeros_like(weights)
        step[at] = 1e-5
        slope = (pii.log_likelihood(weights + step, n, found, gold) - pii.log_likelihood(weights - step, n, found, gold)) / 2e-5
        assert abs(slope - grad[at]) < 1e-6
    assert np.abs(grad[:, len(pii.NAMES) :]).max() > 0.01


def test_field_learns_its_labels_and_finds_what_is_like_them():
    rng = random.Random(2)
    rows = []
    for k in range(150):
        digits = "".join(rng.choice("0123456789") for _ in range(10))
        rows.append(f"words here +1 ({digits[:3]}) {digits[3:6]}-{digits[6:]} and more")
        rows.append(f"host {rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)} is up")
        rows.append(f"write to m{k}.x@mail{k % 9}.example.com today")
        rows.append(f"there are {rng.randint(1, 999)} of {rng.randint(1, 99)} things")
    weights = pii.fit(rows)
    assert pii.best_path(weights, "there are 17 of 25 things") == []
    assert (3, 5, 19) in pii.best_path(weights, "call (555) 123-4567 please")
    base, added = pii.all_spans(weights, "mail m3.x@mail2.example.com ok")
    assert base == [(0, 5, 27)] and added == []


def test_pii_rows(spark):
    texts = ODD + ["a@b.co and 1.2.3.4"] * 2
    got = {}
    for r in pii.pii_spans(frame(spark, texts)).collect():
        got[r["doc_id"]] = [tuple(s) for s in r["base"]]
    assert got == {i: pii.base_spans(t or "") for i, t in enumerate(texts)}
    assert pii.pii_spans(frame(spark, [])).count() == 0


def test_secret_base_rules_equal_plain_patterns():
    rng = random.Random(4)
    plain = r"""([Pp]assword|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for _ in range(2000):
        parts = ["token", "api_key", " ", ":", "=", '"', "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "zz", "é"]
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = [(0, m.start(), m.end()) for m in re.finditer(plain, text) if len(m[2]) >= 6]
        want += [(1, *s) for s in naive("AKIA[A-Z0-9]+", text) if s[1] - s[0] >= 20]
        want += [(2, *s) for s in naive("[0-9a-f]+", text) if s[1] - s[0] >= 24]
        assert secrets.base_spans(text) == want, text


def test_battery_tells_random_from_regular():
    rng = random.Random(6)
    passed = sum(secrets.uniform_p("".join(rng.choice("0123456789abcdef") for _ in range(40)), "0123456789abcdef") >= secrets.UNIFORM_LEVEL for _ in range(300))
    assert passed >= 285
    assert secrets.uniform_p("0123456789abcdef" * 3, "0123456789abcdef") < secrets.UNIFORM_LEVEL
    assert secrets.uniform_p("aaaaaaaaaaaaaaaaaaaaaaaa", "0123456789abcdef") < secrets.UNIFORM_LEVEL


def test_cut_is_the_one_of_benjamini_and_hochberg():
    rng = random.Random(7)
    for _ in range(50):
        grades = [rng.choice([0, 0, -1, rng.randint(1, 60)]) for _ in range(rng.randint(1, 60))]
        counts = {g: grades.count(g) for g in set(grades)}
        order = sorted((10 ** (-g / secrets.CLASSES_PER_10) if g > 0 else 1.0 for g in grades))
        most = max((p for k, p in enumerate(order, 1) if p * len(order) <= secrets.FDR * k), default=-1.0)
        accepted = [g for g in grades if g > 0 and 10 ** (-g / secrets.CLASSES_PER_10) <= most]
        cut = secrets.discovery_cut(counts)
        assert sorted(g for g in grades if g >= cut) == sorted(accepted)


def test_secret_rows(spark):
    key = "qZ7fK2mXw9LbT4vRc8NdP1sGh6Jy"
    texts = ODD + [f"the value {key} stands here", "OUIETHENTIONERREAND THEREOFANDWHICHISLONG"]
    rows = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.secret_spans(frame(spark, texts)).collect()}
    assert rows[len(ODD)] == [(3, 10, 10 + len(key))]
    assert all(not v for k, v in rows.items() if k != len(ODD))
    assert secrets.secret_spans(frame(spark, [])).count() == 0


def test_values_after_an_equals_sign_are_found(spark):
    aws, sig = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "qZ7fK2mXw9LbT4vRc8NdP1sGh6Jyu3A"
    texts = [f"AWS_SECRET_ACCESS_KEY={aws}", f"see https://host/a?sig={sig}== there", f"DB_PASS={sig}", f"={sig}=", f"a={aws}=b={sig}", "a=b=c=d=e=f=g=h=i=j=k="]
    want = [[(22, 62)], [(23, 23 + len(sig) + 2)], [(8, 8 + len(sig))], [(1, 2 + len(sig))], [(2, 42), (45, 45 + len(sig))], []]
    rows = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.secret_spans(frame(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [[(3, *x) for x in w] for w in want]
