"""Lexical pairs against brute force, and what they move."""

import random

import pytest

from weftwork.operators import dedup


def moved(spark) -> int:
    """Bytes shuffled, spilled and written by the session's stages so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm, none = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in (stages.apply(i) for i in range(stages.size())))


def test_lexical_pairs_move_each_shingle_once(spark):
    draw = random.Random(5)
    texts = [[f"w{draw.randrange(3000)}" for _ in range(900)] for _ in range(120)]
    texts += [[*x[:at], "other", *x[at + 1 :]] for x in texts[:3] for at in range(100, 800, 70)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "id long, text string").repartition(3).cache()
    df.count()
    before = moved(spark)
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.lexical_pairs(df, "text", "id").collect()}
    assert moved(spark) - before < 7 * sum(len(" ".join(x)) for x in texts)
    sets = [{tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in texts]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.8}, abs=1e-9) and len(got) == 3 * 55


def test_lexical_pairs_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "LOT", 40)
    base = [f"w{i}" for i in range(60)]
    texts = [*[[*base[:i], "x", *base[i + 1 :]] for i in range(20)], ["a", "B"], ["A", "b"], ["a"], ["a"], ["\t"], ["\n", " "], []]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)] + [(None, "a"), (99, None)], "id long, text string")
    sets = [{" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := " ".join(x).lower().split()) else set() for x in texts]
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {(a, b): near(sets[a], sets[b]) for a in range(26) for b in range(a + 1, 26)}
    got = dedup.lexical_pairs(df, "text", "id").collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) and {(r["a"], r["b"]): r["similarity"] for r in got} == pytest.approx({k: v for k, v in want.items() if v >= 0.8}, abs=1e-9)
