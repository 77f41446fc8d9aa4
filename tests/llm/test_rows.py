"""Operators with a row for each document: 4 (language model), 5 (sharding), 6 (mixing), 7 (language ID), and the pipeline's stages."""

from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import docs, prose, rows
from weftwork.llm import language, lm_score, mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_base_scores_against_exact_counts(spark):
    data = rows()
    tokens = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t, *_ in data]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, *_ in data]
    c = Counter(x for own, out in zip(tokens, held, strict=True) if not out for x in own)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(d), out, len(own), sum(c[x] > 0 for x in own), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), 4)) for (d, *_), own, out in zip(data, tokens, held, strict=True))
    for head in (1 << 19, 20):
        got = lm_score.score(docs(spark, data), head=head, bits=1 << 22).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_score.score(docs(spark, []), bits=1 << 22).count() == 0


def test_model_beats_the_base_on_held_out_text(spark):
    line = "the cat sat on a mat and the dog lay by the fire while rain fell on the old roof".split()
    data = [(i, " ".join(line[(i + j) % len(line)] for j in range(40)), "en", "a") for i in range(300)]
    got = [r for r in lm_score.score(docs(spark, data), bits=1 << 22).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)


def test_model_holds_the_bigrams_of_all_words_at_any_block_size(spark):
    scores = lambda **o: [r["score"] for r in lm_score.score(docs(spark), **o).orderBy("doc_id", "n_tokens", "score").collect()]
    whole = scores(bits=1 << 22)
    assert scores(bits=1 << 22, head=1) == pytest.approx(whole)
    assert sum(scores(bits=1 << 10)) == pytest.approx(sum(whole), rel=0.02)


def test_ties_at_the_end_of_the_head_are_cut_by_key(spark):
    words = spark.createDataFrame([(int(k), 3, 3) for k in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 4000)] + [(7, 900, 900), (8, 0, 5)], "key long, c long, a long")
    keys, exact = lm_score.head_words(words, 1000)
    assert 850 <= len(keys) <= 1150 and {7, 8} <= set(keys.tolist()) and sorted(set(exact.tolist())) == [0, 3, 900]
    keys, _ = lm_score.head_words(words, 10_000)
    assert len(keys) == 4002 and lm_score.head_words(words.limit(0), 10)[0].size == 0
    data = [(i, " ".join(f"t{j}" for j in range(30)) * 1, "en", "a") for i in range(20)]
    few = [r["score"] for r in lm_score.score(docs(spark, data), head=20, bits=1 << 22).orderBy("doc_id").collect()]
    all_ = [r["score"] for r in lm_score.score(docs(spark, data), head=64, bits=1 << 22).orderBy("doc_id").collect()]
    assert few == pytest.approx(all_) and min(few) > -0.3 * 31


def test_scores_against_brute_force(spark):
    """The documented formula over exact counts; with so many bits the filter raises next to no level."""
    data, base = rows(), 1.5
    tokens = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t, *_ in data]
    train = [t for (d, *_), t in zip(data, tokens, strict=True) if zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    level = lambda c: 0 if c < 1 else 1 + math.floor(math.log(c) / math.log(base) + 1e-9)
    low = lambda x: math.ceil(base ** (x - 1) - 1e-6)
    at = defaultdict(list)
    for c in one.values():
        at[level(c)].append(c)
    mean = {k: sum(v) / len(v) for k, v in at.items()} | {0: 0.0}
    norm = 0.5 + sum(len(v) * (mean[k] + 0.5) for k, v in at.items())

    def parts(h, w, less):
        of, both, own = level(len(train) if h == "<s>" else one[h]), level(two[h, w]), level(one[w])
        ratio = min(1.0, max(0.0, (low(both) if both else 0) - less) / max(1.0, max(low(of), low(of + 1) - 1) - less)) if of else 0.0
        return of, ratio, (max(0.0, mean[own] - less * (own > 0)) + 0.5) / norm

    seen = [parts(h, w, 1) for t in train for h, w in zip(["<s>", *t], t, strict=False)]
    a = defaultdict(lambda: 0.3)
    for _ in range(50):
        sums = defaultdict(lambda: [1e-3, 1e-2])
        for of, p, q in seen:
            sums[of][0] += a[of] * p / (a[of] * p + (1 - a[of]) * q)
            sums[of][1] += 1
        a = defaultdict(float, {k: n / d for k, (n, d) in sums.items()})
    a = defaultdict(float, {k: min(0.95, v) for k, v in a.items() if k})
    score = lambda t: sum(math.log10(a[of] * p + (1 - a[of]) * q) for of, p, q in (parts(h, w, 0) for h, w in zip(["<s>", *t], t, strict=False)))
    expected = sorted((str(d), len(t), score(t)) for (d, *_), t in zip(data, tokens, strict=True))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_score.score(docs(spark, data), bits=1 << 24, entry_bits=256).collect())
    for (d, n, s), (e, m, t) in zip(got, expected, strict=True):
        assert (d, n) == (e, m) and s == pytest.approx(t, rel=0.01, abs=0.3)


def test_what_training_saw_once_is_known(spark):
    train, held = [i for i in range(40) if not lm_score.held_out(i)], [i for i in range(40) if lm_score.held_out(i)]
    data = [(i, prose(i, 40), "en", "a") for i in train] + [(train[0], "once twice thrice", "en", "a")]
    data += [(held[0], "once twice thrice", "en", "a"), (held[1], "thrice once twice", "en", "a"), (held[2], "never nowhere none", "en", "a")]
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs(spark, data), bits=1 << 22).where("held_out").collect()}
    assert got[held[0]] > got[held[2]] + 1 and got[held[1]] > got[held[2]] + 1 and got[held[0]] >= got[held[1]]


@pytest.mark.parametrize("count", [lm_score.unigrams, lm_score.bigrams])
def test_counting_holds_a_bounded_share_of_a_task(spark, count):
    """One task with 3 million tokens, nearly all their bigrams different: small batches out, and no more memory than a few of its runs take."""
    found = []

    class Task:
        select = groupBy = agg = lambda self, *_: self

        def mapInArrow(self, run, _):  # noqa: N802
            found.append(run)
            return self

    draw = np.random.default_rng(5)
    texts = [" ".join(map(str, draw.integers(0, 2_000_000, 3000).tolist())) for _ in range(1000)]
    ids = [i for i in range(2000) if not lm_score.held_out(i)][:1000]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["doc_id", "text"])
    del texts
    count(Task())
    tokens = sizes = 0
    tracemalloc.start()
    try:
        for out in found[0](iter([batch])):
            tokens, sizes = tokens + sum(out.column(1).to_pylist()), max(sizes, out.num_rows)
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert tokens == 1000 * 3001 and sizes <= 1 << 16 and most < 150, (tokens, sizes, most)


def test_runs_cover_each_row_once():
    texts = ["a" * 600_000, None, "", "é" * 1_500_000, "b", *["c" * 999] * 2500, "d" * 400_000]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(len(texts) - 1), None]), pa.array(texts)], ["doc_id", "text"])
    got = list(lm_score.runs(batch))
    assert [x for _, _, ids, _ in got for x in ids] == batch.column(0).to_pylist() and [x for *_, own in got for x in own] == texts
    assert [at for at, *_ in got] == [0, *(to for _, to, *_ in got[:-1])] and got[-1][1] == len(texts)
    assert all(len(own) == 1 or sum(len((x or "").encode()) for x in own) <= 1_000_000 for *_, own in got) and len(got) == 5
    assert not list(lm_score.runs(batch.slice(0, 0)))


def test_shards(spark):
    data = rows()
    out = sharding.shard(docs(spark, data), shards=4, bucket_bytes=20_000)
    assert out.columns == [*docs(spark).columns, "__shard", "__grown", "__slot"]
    got = out.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(d), str(t)) for d, t, *_ in data)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["__shard"]].append(r["__slot"])
        shard_of[r["doc_id"]].add((r["__shard"], r["__grown"]))
        assert 0 <= r["__shard"] < 4 and r["__grown"] in (r["__shard"], 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard_of.values())
    again = sharding.shard(docs(spark, data).repartition(5), shards=4, bucket_bytes=20_000).collect()
    where = lambda x: sorted((str(r["doc_id"]), str(r["text"]), r["__shard"], r["__slot"]) for r in x if r["doc_id"] != 7)
    assert where(got) == where(again)
    assert sharding.shard(docs(spark, []), shards=4).count() == 0


def test_shards_against_plain_loops(spark):
    """The shard by the jump hash as published, the slots by one shuffle of each bucket, in order of buckets."""
    data = rows()
    table = docs(spark, data)
    got = sharding.shard(table, shards=4, bucket_bytes=20_000).collect()
    per_shard = -(-sum(len((t or "").encode()) for _, t, *_ in data) // (4 * 20_000))
    mask = 2**64 - 1

    def mixed(x, seed):
        x = (x + seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) & mask
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    from pyspark.sql import functions as F

    buckets = defaultdict(list)
    for r in table.select("doc_id", "text", F.xxhash64(F.lit(11), *table.columns).alias("h")).collect():
        key = mixed(r["doc_id"], 11) if r["doc_id"] is not None else mixed(11, 12)
        buckets[jump(key, 4), mixed(r["h"] % 2**64, 13) % per_shard].append((r["doc_id"] is None, r["doc_id"] or 0, r["h"], r["text"], jump(key, 5)))
    expected = []
    for s in range(4):
        slot = 0
        for b in range(per_shard):
            own = sorted(buckets[s, b], key=lambda x: x[:3])
            for i in sharding.fisher_yates(len(own), f"11:{s * per_shard + b}"):
                expected.append((None if own[i][0] else own[i][1], own[i][3], s, own[i][4], slot))
                slot += 1
    assert per_shard > 1 and sorted(map(str, expected)) == sorted(str((r["doc_id"], r["text"], r["__shard"], r["__grown"], r["__slot"])) for r in got)
    order = sharding.fisher_yates(5, "x")
    assert sorted(order) == list(range(5)) and len({tuple(sharding.fisher_yates(3, str(i))) for i in range(200)}) == 6


def test_one_doc_id_is_spread_over_its_shard(spark):
    data = [(None if i % 2 else 7, prose(i, 50), "en", "a") for i in range(400)]
    scattered = sharding.placed(docs(spark, data), shards=4, per_shard=8, seed=1).groupBy("doc_id", "__bucket").count().collect()
    assert len(scattered) == 16 and max(r["count"] for r in scattered) < 60


def test_mix(spark):
    data = rows() + [(1000 + i, prose(i, 30), "en", "a") for i in range(60)]
    got = mixing.assign(docs(spark, data), digits=1).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, _, s in data:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, total, target = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] >= 2 * sizes[s]]
        for s in over or list(left):
            target[s] = 2 * sizes[s] if over else level * weight[s]
            total -= target[s]
            left.discard(s)
    assert len(got) == len(data)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["__size"] == size(r["text"]) and r["__source_size"] == sizes[r["source"]] and r["__target"] == pytest.approx(target[r["source"]])
        assert len(r["__positions"]) <= 2 and all(0 <= p <= 1 for p in r["__positions"])
        taken[r["source"]] += r["__size"] * len(r["__positions"])
        largest[r["source"]] = max(largest[r["source"]], r["__size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    mixed = mixing.mix(docs(spark, data))
    assert mixed.columns == [*docs(spark).columns, "__position"] and mixed.count() == sum(len(r["__positions"]) for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_demand_inverse_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    shares = spark.range(101).select((F.col("id") / 100).alias("q"))
    for place, schedule in enumerate(mixing.SCHEDULES):
        times, weights, sums = mixing._schedule_arrays(schedule)
        for r in shares.select("q", mixing.demand_inverse(F.col("q"), F.lit(place)).alias("t")).collect():
            i = max(k for k in range(len(times) - 1) if times[k] <= r["t"])
            slope = (weights[i + 1] - weights[i]) / (times[i + 1] - times[i])
            dt = r["t"] - times[i]
            assert sums[i] + weights[i] * dt + slope * dt * dt / 2 == pytest.approx(r["q"], abs=1e-9)


def test_language_is_right_on_held_out_documents(spark):
    found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(found, language.fit(found.where("doc_id % 2 = 0")), keys=["doc_id", "lang"], levels=["source"]).where("doc_id % 2 = 1 and accepted and lang is not null").collect()
    assert len(got) > 300 and sum(r["language"] == r["lang"] for r in got) >= 0.97 * len(got)


def test_every_label_is_in_the_language_model(spark):
    words = lambda i: f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 2} " * 5
    data = [(i, words(i), f"l{i:02}", "a") for i in range(70)] + [(1000 + i, "the and of is not", "en", "a") for i in range(4000)]
    names, table = language.fit(docs(spark, data), sample_rows=300)
    assert names == sorted({x[2] for x in data}) and table.shape[1] == 71
    for i in range(70):
        grams, _ = language.trigrams([words(i)])
        assert names[int(table[grams].sum(axis=0).argmax())] == f"l{i:02}"
    assert language._quotas({"a": 10, "b": 5000, "c": 9000}, 3000) == {"a": 10, "b": 1495, "c": 1495}


def test_language_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in language.of_documents(docs(spark)).collect()}
    assert not got[4]["accepted"] and not got[5]["accepted"] and not got[9]["accepted"] and got[1]["language"] == "en" and got[4]["text_language"] is None
    kept = language.keep_identified(docs(spark))
    assert kept.columns == docs(spark).columns and {1, 2, 7, 8} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (4, 5, 9)").count() == 0
    unknown = docs(spark, [(1, "text", None, "a"), (2, None, None, None)])
    assert [r["language"] for r in language.of_documents(unknown).collect()] == [None, None] and language.keep_identified(unknown).count() == 2
    assert language.of_documents(docs(spark, [])).count() == 0


def _posterior(model, texts, levels, declared, suffix, smoothing=20.0):
    """The documented formulas, row by row: (language, confidence) of each."""
    names, table = model
    n, lls, ps = len(names), [], []
    for text in texts:
        grams, _ = language.trigrams([text])
        ll = table[grams].astype(float).sum(axis=0) * min(len(grams), 200) / max(1, len(grams))
        lls.append(ll)
        ps.append(np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum() if len(grams) else None)
    out = []
    for i in range(len(texts)):
        prior = (sum((p for p in ps if p is not None), np.zeros(n)) + 1) / (sum(p is not None for p in ps) + n)
        for depth in range(len(levels[i]) - 1, -1, -1):
            alike = [j for j in range(len(texts)) if levels[j][depth:] == levels[i][depth:] and ps[j] is not None and (depth or j != i)]
            prior = (sum((ps[j] for j in alike), np.zeros(n)) + smoothing * prior) / (len(alike) + smoothing)
        logs = lls[i] + np.log(prior)
        for said, right in ((declared[i], 0.9), (suffix[i], 0.6)):
            if said in names:
                logs = logs + np.log([right if k == said else (1 - right) / (n - 1) for k in names])
        post = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        out.append((names[int(post.argmax())], post.max()))
    return out


def test_languages_against_the_formulas(spark):
    words = {"en": "the and of is not to in", "de": "der die das und nicht ist", "fr": "le la les et est pas"}
    say = lambda i, k, m: " ".join(words[k].split()[(i + j) % 5] for j in range(m))
    data = [(i, say(i, k, 1 + i % 9), k if i % 2 else None, f"s{i % 4}") for i, k in enumerate(["en", "de", "fr"] * 20)] + [(90, None, None, None), (91, "12 34", None, "s1"), (92, 'see <html lang="de"> 1 at http://x.org/fr', None, "s2"), (93, "le http://a.b.fr x", None, None)]
    table = docs(spark, data)
    model = language.fit(table)
    expected = _posterior(model, [r[1] for r in data], [(r[3],) for r in data], ["de" if r[0] == 92 else None for r in data], ["fr" if r[0] == 93 else None for r in data])
    got = {r["doc_id"]: r for r in language.of_documents(table).collect()}
    for (d, *_), (name, sure) in zip(data, expected, strict=True):
        assert got[d]["language"] == name and got[d]["confidence"] == pytest.approx(sure, abs=1e-6)
    kinds = ["de", "en", None]
    pages = [(i, f"http://h{i % 5}.d{i % 2}.{('de', 'com', 'fr')[i % 3]}/{'fr/' if i % 7 == 0 else ''}x", f"<html{f' lang={kinds[i % 3]}' if kinds[i % 3] else ''}><body>{say(i, ('en', 'de', 'fr')[i % 3], i % 4)}</body></html>") for i in range(40)]
    parts = [u.split("/")[2].split(".") for _, u, _ in pages]
    expected = _posterior(
        model, [say(i, ("en", "de", "fr")[i % 3], i % 4) for i in range(40)], [(".".join(p), ".".join(p[-2:]), p[-1]) for p in parts], [kinds[i % 3] for i in range(40)],
        ["fr" if i % 7 == 0 else ("de", None, "fr")[i % 3] for i in range(40)],
    )
    clash = spark.createDataFrame([(*p, 1, 2, "x") for p in pages], "page_id long, url string, html string, n int, prior int, language string")
    got = {r["page_id"]: r for r in language.of_pages(clash, model).collect()}
    for i, (name, sure) in enumerate(expected):
        assert got[i]["language"] == name and got[i]["confidence"] == pytest.approx(sure, abs=1e-6)
    assert language.of_pages(clash.limit(0), model).count() == 0


def test_declared_language_and_host_decide_where_the_text_does_not(spark):
    data = [(i, ("der die das und nicht " if i % 2 else "the and of is not ") * 30, "de" if i % 2 else "en", None) for i in range(60)]
    model = language.fit(docs(spark, data))
    pages = [(i, f"http://h{i % 2}.example.com/x", f"<html><body>{'der die das und nicht ' * 20 if i % 2 else 'the and of is not ' * 20}</body></html>") for i in range(40)]
    pages += [(100, "http://h1.example.com/y", "<html><body>123</body></html>"), (101, "http://other.org/", '<html lang="de"><body>123</body></html>'), (102, None, None)]
    got = {r["page_id"]: r for r in language.of_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert all(got[i]["language"] == ("de" if i % 2 else "en") for i in range(40))
    assert got[100]["language"] == "de" and got[101]["language"] == "de" and not got[100]["accepted"] and len(got) == len(pages)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    item = prose(900, 40)
    data = rows() + [(500, f"{prose(77, 40)} {item}", "en", "c")]
    docs(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == docs(spark).columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    ids = {r["doc_id"] for r in got}
    assert not ids & {2, 3, 4, 5, 9, 500} and {1, 8, 10} & ids
    assert out.columns == [*docs(spark).columns, "shard", "grown_shard", "slot"]
    for s in range(16):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
