"""Operator 3: benchmark decontamination.

For each benchmark item, documents are read in windows of as many words as the item has. Windows and items have 64-bit
SimHashes over shingles of five words, weighted by their rarity in the whole benchmark. The index cuts a fingerprint
into six blocks of ten or eleven bits and lists, for every value of a block, the items whose block is within two bits of
it; any two fingerprints within 6 * 3 - 1 = 17 bits agree that well in one block at least, so it finds all items within
the radius. Candidates are then verified by the exact weighted Jaccard similarity of their shingle multisets. (At a
similarity of 0.8 fingerprints are ten bits apart in the mean, with a standard deviation of three.)

A window that has no shingle in common with any item has similarity 0, so windows are only fingerprinted where they
overlap such a shingle; this leaves out nothing that the verification would keep.

A shingle's weight is log(1 + n / k) for n items, of which k have a shingle in its bucket (1 if none has). The table of buckets is worked
out once for the whole benchmark and has four for each shingle, up to 2^24. The items are broadcast in blocks of at most
`block_items` items and `block_bytes` bytes, and documents are read once for each block; how they are cut changes no result.

Defined results: ASCII case and signs don't count; items of fewer than five words are one shingle; an item or document
without words, null or empty, matches nothing; documents shorter than an item are one window; equal items match alike,
each with its row; repeated documents have rows of their own; of windows of equal similarity the first is reported;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common, wordhash

SIZE, RADIUS = 5, 17
#: (first bit, bits) of the blocks of a fingerprint.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 bits as 1 and -1 for each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits((sums > 0).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]


def near_values(bits: int) -> np.ndarray:
    """The differences of at most two bits between blocks of so many."""
    one = [1 << i for i in range(bits)]
    return np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])])


class Weights:
    """Weights of shingles by bucket; as many buckets as a power of two of them."""

    def __init__(self, items: int, counts: np.ndarray):
        self.table = np.log1p(items / np.maximum(1, counts)).astype(np.float32).astype(float)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        return self.table[bucket(shingles, len(self.table))]


def bucket(shingles: np.ndarray, buckets: int) -> np.ndarray:
    return (shingles & np.uint64(buckets - 1)).astype(np.int64)


def item_shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles of all items in a row, their number in each, words of each)."""
    hashes, counts, _ = wordhash.words(texts, wordhash.LETTERS)
    ends = np.cumsum(counts)
    held = [wordhash.grams(hashes[e - n : e], min(SIZE, n)) if n else np.zeros(0, np.uint64) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
    return np.concatenate([*held, np.zeros(0, np.uint64)]), np.array([len(x) for x in held], np.int64), counts


def similarity(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, weights: Weights) -> float:
    """Weighted Jaccard of two multisets, each as distinct shingles in order and how often they occur."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = a[at] == b
    both = float(np.minimum(na[at[same]], nb[same]) @ weights.of(b[same]))
    total = float(na @ weights.of(a)) + float(nb @ weights.of(b)) - both
    return both / total if total else 0.0


class Items:
    """A block of benchmark items and their index, in arrays."""

    def __init__(self, rows: list[tuple[int | None, str | None]], weights: Weights):
        flat, many, words = item_shingles([t for _, t in rows])
        self.weights = weights
        self.ids = [k for (k, _), n in zip(rows, words.tolist(), strict=True) if n]
        self.words, many = words[words > 0], many[words > 0]
        #: Of each item its distinct shingles, in order, and how often they occur.
        bags = [np.unique(flat[e - n : e], return_counts=True) for n, e in zip(many.tolist(), np.cumsum(many).tolist(), strict=True)]
        self.start = np.concatenate([[0], np.cumsum([len(u) for u, _ in bags], dtype=np.int64)])
        self.shingles, self.times = (np.concatenate([x[i] for x in bags]) if bags else np.zeros(0, np.uint64) for i in range(2))
        self.known = np.unique(self.shingles)
        self.codes = np.array([pack((signs(u) * (n * weights.of(u))[:, None]).sum(axis=0)[None])[0] for u, n in bags], np.uint64)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        #: By number of words, for each block: where the list of a value starts, and the lists of items near it.
        self.by_words: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n in np.unique(self.words).tolist():
            of, lists = np.flatnonzero(self.words == n), []
            for low, bits in BLOCKS:
                value = (self.codes[of] >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
                near = (value[:, None] ^ near_values(bits)).reshape(-1)
                order = np.argsort(near, kind="stable")
                lists.append((np.searchsorted(near[order], np.arange((1 << bits) + 1)).astype(np.int32), np.repeat(of, len(near) // len(of)).astype(np.int32)[order]))
            self.by_words[n] = lists

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.filter[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
        return at[np.isin(shingles[at], self.known, assume_unique=False)] if len(at) else at

    def matches(self, shingles: np.ndarray, hits: np.ndarray, n_words: int, size: int, least: float) -> dict[int, tuple[float, int]]:
        """Item -> (similarity, first word) of the best window of one document; shingles of `size` words, hits: those in some item."""
        found: dict[int, tuple[float, int]] = {}
        for n, lists in self.by_words.items():
            if min(SIZE, n) != size:
                continue
            span = min(n, n_words) - size + 1  # shingles of a window
            last = len(shingles) - span
            if span < 1:
                continue
            over = np.zeros(last + 2, np.int64)
            np.add.at(over, np.maximum(0, hits - span + 1), 1)
            np.add.at(over, np.minimum(hits, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(over)[:-1] > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
                for at in range(0, len(run), 20_000):
                    self._windows(shingles, run[at : at + 20_000], span, lists, least, found)
        return found

    def candidates(self, codes: np.ndarray, lists: list, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(fingerprint's place, item) of those within the radius, by the lists of each block; at most about `most` are compared at once."""
        for (low, bits), (first, held) in zip(BLOCKS, lists, strict=True):
            value = (codes >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1)
            many = (first[value + 1] - first[value]).astype(np.int64)
            share = np.cumsum(many) // most
            for part in np.split(np.arange(len(codes)), np.flatnonzero(np.diff(share)) + 1):
                m = many[part]
                at = np.repeat(part, m)
                item = held[np.arange(len(at)) + np.repeat(first[value[part]] - (np.cumsum(m) - m), m)]
                close = np.bitwise_count(codes[at] ^ self.codes[item]) <= RADIUS
                yield at[close], item[close]

    def _windows(self, shingles, starts, span, lists, least, found) -> None:
        if not len(starts):
            return
        low, high = int(starts[0]), int(starts[-1]) + span
        own = shingles[low:high]
        sums = np.concatenate([np.zeros((1, 64)), np.cumsum(signs(own) * self.weights.of(own)[:, None], axis=0)])
        codes = pack(sums[starts - low + span] - sums[starts - low])
        near = [np.stack(x, axis=1) for x in self.candidates(codes, lists) if len(x[0])]
        for w, i in np.unique(np.concatenate(near), axis=0).tolist() if near else ():
            s = int(starts[w])
            a, b = int(self.start[i]), int(self.start[i + 1])
            score = similarity(self.shingles[a:b], self.times[a:b], *np.unique(shingles[s : s + span], return_counts=True), self.weights)
            if score >= least and score > found.get(i, (0.0, 0))[0] + 1e-12:
                found[i] = (score, s)


def find(docs: DataFrame, items: Items, least: float) -> DataFrame:
    """(the columns of docs besides its first, the text; item_id, similarity, start_word, n_words)"""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items)
    schema = ", ".join(f"{c} long" for c in docs.columns[1:]) + ", item_id long, similarity double, start_word long, n_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sizes = sorted({min(SIZE, n) for n in index.words.tolist()})
        for batch in batches:
            texts, rows, out = batch.column(0).to_pylist(), [], []
            for at, to in wordhash.chunks(texts):
                hashes, counts, _ = wordhash.words(texts[at:to], wordhash.LETTERS)
                ends = np.cumsum(counts)
                for size in sizes:
                    shingles = wordhash.grams(hashes, size)
                    hits = index.hits(shingles)
                    owner = np.searchsorted(ends, hits, side="right")
                    inside = hits + size <= ends[np.minimum(owner, len(ends) - 1)]
                    hits, owner = hits[inside], owner[inside]
                    for doc in np.unique(owner).tolist():
                        n, first = int(counts[doc]), int(ends[doc] - counts[doc])
                        best = index.matches(shingles[first : first + n - size + 1], hits[owner == doc] - first, n, size, least)
                        rows += [at + doc] * len(best)
                        out += [(index.ids[i], score, start, int(index.words[i])) for i, (score, start) in best.items()]
            if out:
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[1:]), *columns], [x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def weights_of(bench: DataFrame) -> Weights:
    """Weights over the whole benchmark, from a grouped sum by bucket."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, many, words = item_shingles(batch.column(0).to_pylist())
            distinct = [np.unique(flat[e - n : e]) for n, e in zip(many.tolist(), np.cumsum(many).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*distinct, np.zeros(0, np.uint64)]).view(np.int64))], ["shingle"])

    shingles = bench.select("text").mapInArrow(tasks, "shingle long")
    items = bench.where(F.coalesce(F.regexp_like("text", F.lit("[0-9A-Za-z]|[^\\x00-\\x7F]")), F.lit(False))).count()
    buckets = 1 << min(24, max(10, (4 * shingles.count()).bit_length()))
    rows = shingles.groupBy(F.col("shingle").bitwiseAND(buckets - 1).alias("b")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(buckets, np.int64)
    counts[rows["b"].to_numpy().astype(np.int64)] = rows["n"].to_numpy()
    return Weights(items, counts)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, keys: tuple = ("doc_id",), least: float = 0.8, block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """(keys, item_id, similarity, start_word, n_words): a row for each row of docs and item that it has a window of; keys: whole-number columns of docs."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    rows = docs.select("text", *(F.col(c).cast("long").alias(c) for c in keys))
    n, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    weights, out = weights_of(bench), None
    for block in range(blocks):
        held = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        items = Items(sorted(((r["item_id"], r["text"]) for r in held), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), weights)
        if items.ids:
            found = find(rows, items, least)
            out = found if out is None else out.unionByName(found)
    if out is None:
        none = [F.lit(None).cast(k).alias(c) for c, k in (("item_id", "long"), ("similarity", "double"), ("start_word", "long"), ("n_words", "long"))]
        return rows.limit(0).select(*keys, *none)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that have a window of an item; all columns stay."""
    rows = common.with_row(docs)
    return common.without_rows(rows, contaminated(rows, benchmark, keys=("__file", "__at"), **options).select("__file", "__at").distinct())
