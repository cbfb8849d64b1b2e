"""Small corpora for the tests of the corpus operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, key long, n string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, len(t or ""), "x", 7, "y") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]


ODD = [None, "", " \n\t ", "one", "Äpfel 🍎 und Öl\r\nzwei", "x " * 30_000, "same text here for all of us today", "same text here for all of us today"]
