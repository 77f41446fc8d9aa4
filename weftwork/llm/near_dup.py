"""Operator 2: SimHash near duplicates, found with a Gray-order hierarchical index.

Each text has a 64-bit SimHash over word shingles; documents whose fingerprints differ in at most `radius` bits are
linked, and the components of the links are the groups. Only distinct fingerprints are compared.

Each index has a mask of bits, whose patterns are its top nodes: they are the shuffle key, and a search opens only the
top node that it agrees with. Within it, the fingerprints are sorted by Gray rank and every 16 neighbours form a node,
every 16 nodes a node above. A node holds the bit pattern that all below it share; a search adds up the differences
from the patterns on its way down and drops a whole group once they exceed the radius. Patterns further down hold only
the bits that the nodes above don't.

For a small radius, masks promise all links: the bits are cut into radius + r blocks, two fingerprints within the
radius agree on r of them at least, and each choice of r blocks is a mask. For the radius that a similarity of shingle
sets needs (pairs at 0.8 are ten bits apart in the mean, half of them more), no small number of masks promises that;
masks of random bits are drawn, as many as find a pair at that similarity with a chance of `recall`, and groups() verifies
what they find by the exact Jaccard similarity of the shingle sets.

A top node that is larger than its bound (a group of near copies) is dealt in chunks to tasks for all pairs of chunks.
Tasks return a forest of their links rather than all pairs, and components.py joins the forests.

Defined results: a text without words, null or empty, has fingerprint zero and is linked like any other; texts of fewer
words than a shingle are one shingle; repeated rows are rows of one group; a null doc_id takes part only through its
fingerprint, and in keep_one() comes last of its group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common, sets
from weftwork.llm.components import components
from weftwork.llm.wordhash import mix

FAN = 16
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's shingles of `size` words, in their order; ASCII letters count as lower case."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(whole, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.array([digest(whole[s:e], seed) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    places = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(places.reshape(-1), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int(np.packbits((counts.reshape(-1) * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text, as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((simhash(shingle_hashes(x.as_py(), size, seed)) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def index_masks(radius: int, choose: int) -> list[int]:
    """A mask for each choice of blocks that two fingerprints within the radius may agree on."""
    n = radius + choose
    bounds = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, choose)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the order of the reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in groups; each group is a tree over its Gray order."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        """codes in Gray order within contiguous groups; group: 0, 1, ... for each."""
        self.codes, self.group = codes, group
        n = len(codes)
        new = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.flatnonzero(new)
        self.sizes = np.diff(np.concatenate([first, [n]]))
        within = np.arange(n) - np.repeat(first, self.sizes)
        start = np.flatnonzero(new | (within % FAN == 0))
        both, any_ = np.bitwise_and.reduceat(codes, start), np.bitwise_or.reduceat(codes, start)
        levels = [(start, np.concatenate([start[1:], [n]]), both, ~(both ^ any_), group[start])]
        while len(levels[-1][0]) > len(first):
            _, _, both, _, owner = levels[-1]
            any_ = both | ~levels[-1][3]
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            heads = np.flatnonzero(new)
            within = np.arange(len(owner)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(owner)]])))
            start = np.flatnonzero(new | (within % FAN == 0))
            both, any_ = np.bitwise_and.reduceat(both, start), np.bitwise_or.reduceat(any_, start)
            levels.append((start, np.concatenate([start[1:], [len(owner)]]), both, ~(both ^ any_), owner[start]))
        self.levels = levels
        #: Of each level's nodes: the last row below, and the bits that they hold besides their parents'.
        self.last, self.own = [levels[0][1]], []
        for below, level in zip(levels, levels[1:], strict=False):
            self.last.append(self.last[-1][level[1] - 1])
            parent = np.repeat(np.arange(len(level[0])), level[1] - level[0])
            self.own.append(below[3] & ~level[3][parent])
        self.own.append(levels[-1][3])

    def pairs(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): rows of one group within the radius, i of query, i < j."""
        top = len(self.levels) - 1
        node = self.group[query]
        held = np.bitwise_count((self.codes[query] ^ self.levels[top][2][node]) & self.own[top][node]).astype(np.int64)
        for level in range(top, -1, -1):
            keep = (held <= radius) & (self.last[level][node] > query + 1)
            query, node, held = query[keep], node[keep], held[keep]
            start, end, _, fixed, _ = self.levels[level]
            many = end[node] - start[node]
            ends = np.cumsum(many)
            child = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(start[node], many)
            query, held = np.repeat(query, many), np.repeat(held, many)
            if level:
                below = self.levels[level - 1]
                held += np.bitwise_count((self.codes[query] ^ below[2][child]) & self.own[level - 1][child])
                node = child
            else:
                held += np.bitwise_count((self.codes[query] ^ self.codes[child]) & ~fixed[np.repeat(node, many)])
                keep = (held <= radius) & (child > query)
        return query[keep], child[keep]

    def forest(self, radius: int, allowed=None, pairs_at_once: int = 2_000_000) -> np.ndarray:
        """For each row, the least row that its links lead to: rows within the radius that, if given, allowed(i, j) lets pass."""
        label = np.arange(len(self.codes))
        rows = np.flatnonzero(self.sizes[self.group] > 1)
        if not len(rows):
            return label
        share = np.cumsum(self.sizes[self.group[rows]]) // pairs_at_once
        for part in np.split(rows, np.flatnonzero(np.diff(share)) + 1):
            i, j = self.pairs(part, radius)
            if allowed is not None:
                keep = allowed(i, j)
                i, j = i[keep], j[keep]
            label = sets.merged(label, i, j)
        return label


def sampled_masks(n: int, *, least: float = 0.8, radius: int = 16, recall: float = 0.9, top_node: int = 2048, seed: int = 5) -> list[int]:
    """Masks of random bits for n fingerprints: so wide that unlike texts share a top node with about top_node others, so many that a pair at the similarity `least` shares one with the chance `recall`."""
    wide = min(40, max(4, (n // top_node).bit_length()))
    # Sets of like size at a Jaccard of `least` have a cosine of 2 least / (1 + least), which gives the chance of each bit to differ.
    differs = np.arccos(2 * least / (1 + least)) / np.pi
    apart = np.array([comb(64, d) * differs**d * (1 - differs) ** (64 - d) for d in range(radius + 1)])
    shared = np.array([comb(64 - d, wide) / comb(64, wide) for d in range(radius + 1)])  # by a mask of so many bits that no differing bit is in it
    many = 1
    while apart @ (1 - (1 - shared) ** many) < recall:
        many += 1
    draw = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in draw.permutation(64)[:wide]) for _ in range(many)]


def links(distinct: DataFrame, masks: list[int], *, radius: int, both: int | None = None, bound: int = 8192) -> DataFrame:
    """(u, v): links between nodes of distinct (fp, fp2, node) that join all that share a top node of some mask and are within the radius, and within `both` if the bits of fp2 are counted too."""
    spark = distinct.sparkSession
    second = F.lit(0).cast("long") if both is None else F.col("fp2")
    distinct = distinct.select("fp", second.alias("fp2"), "node")
    at = F.posexplode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])).alias("t", "mask")
    keyed = distinct.where("node is not null").select("fp", "fp2", "node", at).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "fp2", "node")
    hot = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > bound).select(F.col("t").alias("ht"), F.col("key").alias("hk"), F.ceil(F.col("n") / bound).cast("int").alias("k"))
    hot = common.stage(hot, "hot")
    many = hot.count()
    keyed = keyed.withColumn("pair", F.lit(0))
    if many:
        hot = F.broadcast(hot) if many <= 1_000_000 else hot  # 16 MB
        chunk = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.coalesce("k", F.lit(1))).cast("int")
        other = F.explode(F.expr("sequence(0, coalesce(k, 1) - 1)")).alias("other")
        keyed = keyed.join(hot, (F.col("t") == F.col("ht")) & (F.col("key") == F.col("hk")), "left").select("t", "key", "fp", "fp2", "node", F.coalesce("k", F.lit(1)).alias("k"), chunk.alias("chunk"), other)
        keyed = keyed.select("t", "key", "fp", "fp2", "node", (F.least("chunk", "other") * F.col("k") + F.greatest("chunk", "other")).alias("pair"))
    parts = common.parts_for(spark, distinct.count() * len(masks), 500_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(c) for c in b.columns] for b in batches]
        if not held:
            return
        t, key, fp, fp2, node, pair = (np.concatenate(c) for c in zip(*held, strict=True))
        codes, more = fp.view(np.uint64) & ~np.array(masks, np.uint64)[t], fp2.view(np.uint64)
        order = np.lexsort((gray_rank(codes), pair, key, t))
        t, key, codes, more, node, pair = (x[order] for x in (t, key, codes, more, node, pair))
        new = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
        near = lambda i, j: np.bitwise_count(codes[i] ^ codes[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j]) <= both
        label = GrayIndex(codes, np.concatenate([[0], np.cumsum(new)])).forest(radius, None if both is None else near)
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["u", "v"])

    return keyed.repartition(parts, "t", "key", "pair").select("t", "key", "fp", "fp2", "node", "pair").mapInArrow(run, "u long, v long")


def sure_masks(n: int, radius: int, *, top_node: int = 4096) -> list[int]:
    """index_masks() with blocks so many that n unlike fingerprints share a top node with about top_node others."""
    choose = 1
    while n >> (64 * choose // (radius + choose)) > top_node and choose < 4:
        choose += 1
    return index_masks(radius, choose)


def near_duplicates(docs: DataFrame, *, size: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of docs (doc_id, text): the component's id is its smallest doc_id."""
    prints = common.stage(fingerprints(docs, size=size), "fingerprints")
    distinct = common.stage(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    roots = components(links(distinct, sure_masks(distinct.count(), radius), radius=radius))
    classes = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def set_prints(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, __file, __at, fp, fp2, key, check): two fingerprints of each text's set of shingles, and the identity of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 4), np.uint64)
            for i, text in enumerate(batch.column(0)):
                hashes = np.unique(shingle_hashes(text.as_py(), size))
                if len(hashes):
                    mixed = mix(hashes)
                    out[i] = simhash(hashes), simhash(mixed), int(np.bitwise_xor.reduce(mixed)), int(np.sum(mix(mixed)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(out[:, i].view(np.int64)) for i in range(4))], [*batch.schema.names[1:], "fp", "fp2", "key", "check"])

    return rows.select("text", F.col("doc_id").cast("long").alias("doc_id"), "__file", "__at").mapInArrow(run, "doc_id long, __file long, __at long, fp long, fp2 long, key long, check long")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(key, check, words): the packed set of shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                held = [np.unique(shingle_hashes(x.as_py(), size)) for x in part.column(0)]
                many = np.array([len(x) for x in held])
                words = sets.packed(np.concatenate(held), np.cumsum(many) - many, many, np.arange(len(many)))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), words], ["key", "check", "words"])

    return rows.select("text", "key", "check").mapInArrow(run, "key long, check long, words binary")


def groups(rows: DataFrame, *, size: int = 5, least: float = 0.8, radius: int = 16, both: int = 28, recall: float = 0.9, class_bound: int = 1024) -> DataFrame:
    """(__file, __at, doc_id, group) of rows, from common.with_row(): groups are the components of links between texts whose shingle sets have a Jaccard similarity of `least` and that the index finds.

    Fingerprints are of the sets. The index only proposes classes of sets; within the wide radius of 64 bits many unlike texts are, so a second
    fingerprint of 64 bits is counted before two join a class. Each class then meets, with its whole shingle sets, in one
    task (a large one in pairs of chunks), so a group is linked by verified pairs alone.
    """
    prints = common.stage(set_prints(rows, size), "prints")
    distinct = common.stage(prints.groupBy("key", "check", "fp", "fp2").agg(F.min(F.struct("__file", "__at")).alias("first")), "sets")
    masks = sampled_masks(distinct.count(), least=least, radius=radius, recall=recall)
    roots = components(links(distinct.select("fp", "fp2", F.col("key").alias("node")), masks, radius=radius, both=both))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = common.stage(distinct.join(roots, F.col("key") == F.col("node")).select("key", "check", "root", "first"), "members")
    wanted = members.select("key", "check", F.col("first.__file").alias("f"), F.col("first.__at").alias("a"))
    if members.count() <= 500_000:  # 16 MB
        wanted = F.broadcast(wanted)
    texts = rows.select("text", "__file", "__at").join(wanted, (F.col("__file") == F.col("f")) & (F.col("__at") == F.col("a"))).select("text", "key", "check")
    held = shingle_sets(texts, size).withColumnsRenamed({"key": "k", "check": "c"})
    members = common.stage(members.join(held, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c"))).select("root", "key", "check", "words"), "members")
    dealt = sets.dealt(members, ["key", "check"], class_bound).select("root", "low", "high", "chunk", "key", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        root, low, high, chunk, key = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in range(5))
        label = np.arange(len(root))
        for x, y in sets.links(root, low, high, chunk, pa.concat_arrays([b.column(5) for b in held]), least):
            label = sets.merged(label, x, y)
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(key[linked]), pa.array(key[label[linked]])], ["u", "v"])

    parts = common.parts_for(rows.sparkSession, members.count(), 10_000)
    same = components(dealt.repartition(parts, "root", "low", "high").mapInArrow(run, "u long, v long")).select("node", F.col("root").alias("group"))
    return prints.join(same, F.col("key") == F.col("node"), "left").select("__file", "__at", "doc_id", F.coalesce("group", "key").alias("group"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row of the smallest doc_id of each group of docs, of several the one first in its files; all columns stay."""
    rows = common.with_row(docs)
    found = common.stage(groups(rows, **options), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__at")
    first = found.groupBy(F.col("group").alias("g")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = found.join(first, F.col("group") == F.col("g")).where((F.col("first.__file") != F.col("__file")) | (F.col("first.__at") != F.col("__at")))
    return common.without_rows(rows, gone)
