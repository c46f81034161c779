"""Small documents with every awkward case."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(sentence(rng, 1) if rng.random() < share else w for w in text.split(" "))


def awkward(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, exact and near copies, and a very long text."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 200)) for _ in range(25)]
    texts = [*base, *[base[0]] * 4, base[1], *[edited(rng, base[i], 0.03) for i in (2, 2, 3, 4)], "", "", " \n\t ", "one", "one", "two words", None, None, sentence(rng, 60_000), base[5] + "\r\n", "  " + base[6], "漢字 " * 40, "A" * 9000, "a" + " " * 100_000 + "b"]
    rows = [(i, t, rng.choice(["en", "de", None]), None if i % 7 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, base[7], "en", "src0", 3), (None, None, None, None, None), (None, "only here " + base[8], None, None, 1)]


def frame(spark, rows=None):
    """With columns whose names clash with the operators' own."""
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    for name in ("id", "text_", "hi", "n", "range", "__norm", "__own", "root", "rate", "quality_score", "bucket", "p"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def empty(spark):
    return frame(spark, [])
