"""A small corpus with what the operators must bear: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""

from __future__ import annotations

import random

CLASHING = ["n", "s", "b", "key", "fp", "node", "root", "size", "before", "words", "position", "row", "c", "level", "target", "first"]
SCHEMA = "doc_id long, text string, lang string, source string"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}{'abcde'[draw.randrange(5)]}" for _ in range(words))


def rows() -> list[tuple]:
    long = prose(1, 20_000)
    base = prose(2, 300)
    words = base.split()
    near = " ".join([*words[:150], "CHANGED", *words[151:]])
    out = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, near, "en", "b"), (4, None, "en", "a"), (5, "", None, None), (6, "one", "en", None),
        (7, "one", "en", None), (7, "one", "en", None), (8, long, "en", "a"), (9, " \t\n ", "en", "a"), (10, "it's éü 中文 \U0001f600 <|endoftext|> 12", "en", "b"),
        (None, base, "en", "a"), (11, "x\ny\nx\ny", None, "c"),
    ]
    return out + [(100 + i, prose(100 + i, 20 + 7 * i), "en", "abc"[i % 3]) for i in range(30)]


def docs(spark, data: list[tuple] | None = None):
    from pyspark.sql import functions as F

    out = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    return out.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
