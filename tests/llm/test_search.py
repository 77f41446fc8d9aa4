"""Near duplicates, decontamination and line dedup (2, 3, 10) against brute force over all pairs."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tests.llm.common import docs, prose, rows
from weftwork.llm import decontaminate, line_dedup, near_dup, wordhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text) -> int:
    words = SPACE.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes: list, links) -> dict:
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_groups(spark):
    data = [r for r in rows() if r[1] is None or len(r[1]) < 50_000]
    prints = {i: fingerprint(r[1]) for i, r in enumerate(data)}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    group = roots(list(prints), links)
    least: dict = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[group[i]] = min(least.get(group[i], r[0]), r[0])
    expected = sorted((str(r[0]), prints[i], least[group[i]]) for i, r in enumerate(data))
    got = sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in near_dup.near_duplicates(docs(spark, data)).collect())
    assert got == expected
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("choose", [1, 2, 3])
def test_gray_index_finds_all_links_of_an_index(choose):
    draw = np.random.default_rng(choose)
    codes = draw.integers(0, 2**63, 60, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, *(codes ^ (np.uint64(1) << draw.integers(0, 64, 60, dtype=np.uint64)) for _ in range(5))]))
    found = set()
    for mask in near_dup.index_masks(4, choose):
        key = codes & np.uint64(mask)
        order = np.lexsort((near_dup.gray_rank(codes & ~np.uint64(mask)), key))
        own = codes[order]
        group = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        i, j = near_dup.GrayIndex(own, group).pairs(np.arange(len(own)), 4)
        found |= {tuple(sorted((int(own[a]), int(own[b])))) for a, b in zip(i, j, strict=True)}
    assert found == {(a, b) for a, b in combinations(codes.tolist(), 2) if (a ^ b).bit_count() <= 4}


def test_links_of_a_hot_top_node(spark):
    codes = sorted({(1 << a | 1 << b) for a in range(12) for b in range(12)})
    table = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "fp long, node long").repartition(3)
    pairs = [(r["u"], r["v"]) for r in near_dup.links(table, near_dup.index_masks(4, 1), radius=4, bound=8).collect()]
    assert set(roots(list(range(len(codes))), pairs).values()) == {0}


def edited(seed: int, text: str, n: int) -> str:
    draw, words = np.random.default_rng(seed), text.split()
    for at in draw.integers(len(words), size=n):
        words[at] = f"edit{seed}"
    return " ".join(words)


@pytest.mark.parametrize("class_bound", [1024, 3])
def test_one_of_each_group_of_similar_texts_stays(spark, class_bound):
    base = [prose(300 + i, 120) for i in range(12)]
    data = rows() + [(1000 + 10 * i + k, edited(10 * i + k, b, k % 6), "en", "a") for i, b in enumerate(base) for k in range(8)]
    data += [(None, base[0], "en", "a"), (None, "quite alone in the table", "en", "a"), (1000, base[0], "en", "b")]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    bags = [shingles(SPACE.findall(lower(r[1]))) for r in data]
    same = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    near = [(a, b) for a, b in combinations(range(len(data)), 2) if same(bags[a], bags[b])]
    group = roots(list(range(len(data))), near)
    table = docs(spark, data)
    kept = near_dup.keep_one(table, class_bound=class_bound)
    assert kept.columns == table.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    order = lambda i: (data[i][0] is None, data[i][0] or 0)
    best = {}
    for i, g in group.items():
        best[g] = min(best.get(g, i), i, key=order)
    expected = [data[i][:2] for i in best.values()]
    missed = Counter(got) - Counter(expected)
    assert not Counter(expected) - Counter(got) and sum(missed.values()) <= 0.1 * (len(data) - len(expected))
    assert near_dup.keep_one(docs(spark, [])).count() == 0


def test_sampled_masks_find_similar_fingerprints():
    draw = np.random.default_rng(3)
    for n in (1000, 300_000, 10**9):
        masks = np.array(near_dup.sampled_masks(n), np.uint64)
        flips = np.array([sum(1 << int(b) for b in np.flatnonzero(draw.random(64) < np.arccos(2 * 0.8 / 1.8) / np.pi)) for _ in range(2000)], np.uint64)
        assert ((flips[:, None] & masks) == 0).any(axis=1).mean() >= 0.9
        assert n / 2 ** int(masks[0]).bit_count() <= 2048


def test_contaminated(spark):
    items = [(1, prose(900, 40)), (2, prose(901, 12)), (3, prose(902, 3)), (4, None), (5, ""), (None, prose(903, 20)), (6, prose(900, 40))]
    words = {k: t.split() for k, t in items if t}
    data = [
        (1, prose(1, 50) + " " + items[0][1].upper() + "! " + prose(2, 50), "en", "a"), (2, prose(3, 30) + " " + " ".join([*words[1][:39], "other"]), "en", "a"), (3, items[1][1], "en", "b"),
        (4, items[2][1], "en", "b"), (5, " ".join(words[1][:20]), "en", "a"), (6, None, "en", "a"), (7, "", "en", "a"), (8, prose(4, 3000), "en", "a"), (None, items[5][1], None, None), (3, items[1][1], "en", "b"),
    ]
    clean = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", lower(t)).split()
    shingles = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    bags = [(k, len(clean(t)), Counter(shingles(clean(t), min(5, len(clean(t)))))) for k, t in items if clean(t or "")]
    seen = Counter(s for _, _, b in bags for s in b)
    weight = lambda s: float(np.log1p(len(bags) / max(1, seen[s])))

    def similarity(a, b):
        both = sum(min(n, b[x]) * weight(x) for x, n in a.items())
        return both / (sum(n * weight(x) for x, n in a.items()) + sum(n * weight(x) for x, n in b.items()) - both)

    expected = []
    for doc, text, *_ in data:
        own = clean(text)
        for item, n, bag in bags:
            size, best = min(5, n), None
            for at in range(max(1, len(own) - n + 1)):
                window = Counter(shingles(own[at : at + n], size))
                score = similarity(bag, window) if window else 0
                if window and score >= 0.8 and (best is None or score > best[0] + 1e-12):
                    best = (score, at)
            if best:
                expected.append((str(doc), str(item), round(best[0], 5), best[1], n))
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, n int")
    for block in (20_000, 2):
        got = decontaminate.contaminated(docs(spark, data), bench, block_items=block).collect()
        assert sorted((str(r[0]), str(r[1]), round(r[2], 5), r[3], r[4]) for r in got) == sorted(expected)
    kept = decontaminate.drop_contaminated(docs(spark, data), bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in data if str(r[0]) not in {x[0] for x in expected})
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0 and decontaminate.contaminated(docs(spark, data), bench.limit(0)).count() == 0


def _lines() -> list[tuple]:
    draw = np.random.default_rng(5)
    base = [f"k{i} " + " ".join(f"t{draw.integers(60)}" for _ in range(draw.integers(1, 40))) for i in range(12)]
    out = []
    for d in range(40):
        lines = []
        for _ in range(4):
            words = base[draw.integers(12)].split()
            for _ in range(draw.integers(0, 4)):
                words[draw.integers(len(words))] = f"t{draw.integers(60)}"
            lines.append(" ".join(words).upper() if draw.integers(2) else " ".join(words))
        out.append((d, "\n".join([*lines, "", "   "]), "en", "a"))
    return [*out, (41, None, "en", "a"), (42, "", "en", "a"), (None, out[0][1], "en", "a"), (3, out[3][1], "en", "b")]


@pytest.mark.parametrize(("bound", "class_bound"), [(20_000, 2048), (6, 5), (20_000, 30)])
def test_line_dedup(spark, bound, class_bound):
    data = _lines()
    lines = {}
    for doc, text, *_ in data:
        for i, line in enumerate((text or "").split("\n")):
            if line.split():
                lines[(float("inf") if doc is None else doc, i)] = frozenset(lower(line).split())
    sets = set(lines.values())
    near = {s: {o for o in sets if o != s and len(s & o) >= 0.8 * len(s | o) - 1e-9} for s in sets}
    removed = {at for at, s in lines.items() if any(o < at and (t == s or t in near[s]) for o, t in lines.items())}
    got = line_dedup.duplicate_lines(docs(spark, data), bound=bound, class_bound=class_bound)
    got = {(float("inf") if r["doc_id"] is None else r["doc_id"], r["line"]): (r["removed"], r["links"]) for r in got.collect()}
    again = {(d, i) for d, i in removed if d != 3}
    assert {at for at, (gone, _) in got.items() if gone and at[0] != 3} == again and set(got) == set(lines)
    assert {at: n for at, (_, n) in got.items()} == {at: len(near[s]) for at, s in lines.items()}
    report = line_dedup.line_report(docs(spark, data))
    assert report.count() == len(data)
    assert line_dedup.line_report(docs(spark, [])).count() == 0
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(docs(spark, data), report.where("doc_id <> 3")).where("doc_id <> 3 or doc_id is null").collect()}
    for doc, text, *_ in data:
        if doc not in (3, None):
            assert kept[doc] == (text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (doc, i) not in removed))


def test_word_hashes_are_those_of_words():
    texts = ["One  two\tone", None, "", "two x one", "  "]
    hashes, counts, _ = wordhash.words(texts)
    assert counts.tolist() == [3, 0, 0, 2, 0] and hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3
