"""Operator 10: line deduplication by an exact set-similarity join.

A line is the set of its words. All words are ordered by rarity: by the count, over the whole corpus, of the bucket of
words that theirs is hashed to, then by their hash; the table of buckets has a fixed size, and any fixed order gives
exact results. Two sets with a Jaccard similarity of t share a word among their first |x| - ceil(t |x|) + 1, their
prefixes, so the join deals prefix words to tasks. Sets that meet at a word are candidates if they pass the length
filter, the positional filter (what can still follow the shared word must reach the overlap that t asks for) and a
filter by signatures: parities of classes of words, of which sets differ in at most as many as they differ in words.
The smaller set of a pair must meet within its first |x| - ceil(2t / (1 + t) |x|) + 1 words, as the overlap that t
asks for is at least 2t / (1 + t) of it. Words that head very many sets are dealt in pairs of chunks.

Candidate pairs never become rows. A task hands on the forest that joins its candidates, and the components of all
forests are classes within which every pair of sets that reaches t lies. The whole sets of a class then meet in one
task (a large class in pairs of chunks), which compares all its pairs exactly and hands on, for each set, the number of
its links and the first place of a partner. So the rows grow with the lines, whatever the size of a group.

A line is removed if an earlier one (by doc_id, then line) matches it: it has the same set or a similarity of t.
A set's identity is 128 bits of hash of its 64-bit word hashes; sets are compared by 40 bits of each word's hash.

Defined results: ASCII case doesn't count; lines without words never match; null and empty texts have no lines that
match; rows of one doc_id share their line numbers, equal lines among them are one; a null doc_id comes last; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common, sets, wordhash
from weftwork.llm.components import components
from weftwork.llm.sets import merged, packed, unpacked
from weftwork.llm.wordhash import mix

BUCKETS = 18  # bits of the table of counts
LAST = (1 << 63) - 1
MOST = 0xFFFF
WIDEST = 1024  # bits of the longest signature
AT_ONCE = 2_000_000


def line_sets(texts: list[str | None]):
    """(text, line number, key, second key, size, first word) of each line that has words, and the words of all sets in a row."""
    raw = [x or "" for x in texts]
    hashes, _, start = wordhash.words(raw, wordhash.LINES)
    joined = np.frombuffer("\n".join(raw).encode("utf-8", "surrogatepass"), np.uint8)
    line = np.searchsorted(np.flatnonzero(joined == 10), start)
    lengths = np.fromiter((x.count("\n") + 1 for x in raw), np.int64, len(raw))
    first_line = np.cumsum(lengths) - lengths
    # Lines stand in order already; within a line by hash.
    order = np.lexsort((hashes, line))
    line, hashes = line[order], hashes[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
    line, hashes = line[new], hashes[new]
    at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([at, [len(line)]]))
    mixed = mix(hashes)
    key, check = (mix(np.add.reduceat(m, at) + size.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64) for m in (mixed, mixed * mixed | np.uint64(1)))
    text = np.searchsorted(first_line, line[at], side="right") - 1
    return text, line[at] - first_line[text], key, check, size, at, hashes


def stored_lines(docs: DataFrame) -> DataFrame:
    """(key, check, doc_id, line, words): every line that has words; words for one line of each set in a task, at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, to in wordhash.chunks(texts):
                text, line, key, check, size, first, hashes = line_sets(texts[at:to])
                if not len(key):
                    continue
                _, one = np.unique(key, return_index=True)
                place = np.minimum(np.searchsorted(seen, key[one]), max(0, len(seen) - 1))
                one = one[seen[place] != key[one]] if len(seen) else one
                seen = np.sort(np.concatenate([seen, key[one]])) if len(seen) < 1_000_000 else np.sort(key[one])
                words = packed(hashes, first, size, np.sort(one))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), ids.slice(at, to - at).take(pa.array(text)), pa.array(line), words], ["key", "check", "doc_id", "line", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key long, check long, doc_id long, line long, words binary")


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (mix(words) >> np.uint64(64 - BUCKETS)).astype(np.int64)


def bucket_counts(lines: DataFrame) -> np.ndarray:
    """Of each bucket of words the number of stored sets that hold them: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(bucket_of(unpacked(batch.column(0))[0]), minlength=1 << BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    rows = lines.where("words is not null").select("words").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << BUCKETS, np.int64)
    counts[rows["bucket"].to_numpy().astype(np.int64)] = rows["n"].to_numpy()
    return counts


def signature_bits(size: np.ndarray) -> np.ndarray:
    """The length of a set's signature: a power of two, the first from 64 on that is no less than its size, at most WIDEST."""
    return np.minimum(WIDEST, 64 << np.ceil(np.log2(np.maximum(1, size / 64))).astype(np.int64))


def folded(bits: np.ndarray, to: int) -> np.ndarray:
    """Rows of signatures (64-bit words) at the length `to`: words that a shorter signature has in one class are added up."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), bits.shape[1] * 64 // to, to // 64), axis=1)


def prefixes(lines: DataFrame, t: float, ranks) -> DataFrame:
    """(head, key, bits): the prefix words of each set. head packs the word's 32-bit hash with the set's size and the word's place, bits is the set's signature.

    Sizes and places beyond 16 bits stand at their bound, where the filters let pairs pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            key = np.asarray(batch.column(0))
            flat, size = unpacked(batch.column(1))
            # Sets that only an equal set can match need no search: no other size or overlap reaches t.
            keep = (np.floor(size / t + 1e-9) > size) | (np.ceil(2 * size * t / (1 + t) - 1e-9) < size)
            flat, key, size = flat[np.repeat(keep, size)], key[keep], size[keep]
            if not len(key):
                continue
            first, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
            long = signature_bits(size)
            start = np.cumsum(long // 64) - long // 64
            held = np.zeros(int((long // 64).sum()), np.uint64)
            where = (flat & (long[owner] - 1).astype(np.uint64)).astype(np.int64)
            np.bitwise_xor.at(held, start[owner] + (where >> 6), np.uint64(1) << (where & 63).astype(np.uint64))
            flat = flat[np.lexsort((flat, owner.astype(np.uint64) << np.uint64(BUCKETS) | rank[bucket_of(flat)]))]
            many = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
            of = np.repeat(np.arange(len(size)), many)
            place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            word = flat[first[of] + place] >> np.uint64(8) << np.uint64(32)
            head = word | np.minimum(size, MOST).astype(np.uint64)[of] << np.uint64(16) | np.minimum(place, MOST).astype(np.uint64)
            wide = (long // 64)[of]
            ends = np.cumsum(wide)
            data = held[np.arange(int(ends[-1])) + np.repeat(start[of] - (ends - wide), wide)]
            bits = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(np.concatenate([[0], ends * 8]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), pa.array(key[of]), bits], ["head", "key", "bits"])

    return lines.where("words is not null").select("key", "words").mapInArrow(run, "head long, key long, bits binary")


def hot_words(lines: DataFrame, t: float, ranks, counts, bound: int) -> list[tuple[int, int]]:
    """(word, chunks) of the prefix words of more than `bound` sets. Only words of buckets with so many sets can be hot."""
    large = np.zeros(1 << BUCKETS, bool)
    large[np.flatnonzero(counts > bound)] = True
    if not large.any():
        return []
    shared = lines.sparkSession.sparkContext.broadcast(large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = unpacked(batch.column(0))
            hot, owner = shared.value[bucket_of(flat)], np.repeat(np.arange(len(size)), size)
            # The most frequent words stand last: only sets with fewer other words than a prefix has can be headed by one.
            others = np.bincount(owner, ~hot, len(size))
            many = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
            headed = (others < many)[owner]
            flat, owner, hot = flat[headed], owner[headed], hot[headed]
            order = np.lexsort((flat, owner.astype(np.uint64) << np.uint64(BUCKETS) | ranks.value[bucket_of(flat)]))
            flat, owner, hot = flat[order], owner[order], hot[order]
            new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
            place = np.arange(len(owner)) - np.repeat(new, np.diff(np.concatenate([new, [len(owner)]])))
            words, n = np.unique(flat[hot & (place < many[owner])] >> np.uint64(8) & np.uint64(0xFFFFFFFF), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.uint32).view(np.int32).astype(np.int64)), pa.array(n)], ["word", "n"])

    found = lines.where("words is not null").select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [(r["word"], -(-r["n"] // bound)) for r in found.where(F.col("n") > bound).collect()]


def alike(bits: pa.Array, sizes: np.ndarray):
    """A function of rows x, y and the words they may differ in: whether their signatures allow it."""
    data = np.frombuffer(bits.buffers()[2], np.uint64)
    wide = signature_bits(sizes) // 64
    start = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits)].astype(np.int64) // 8
    levels, at, to = [], np.zeros(0, np.int64), WIDEST
    held = np.zeros((0, WIDEST // 64), np.uint64)
    while to >= 64:
        own = np.flatnonzero(wide == to // 64)
        rows = data[start[own][:, None] + np.arange(to // 64)]
        at, held = np.concatenate([at, own]), np.concatenate([folded(held, to), rows])
        index = np.full(len(sizes), -1)
        index[at] = np.arange(len(at))
        levels.append((to // 64, index, held))
        to //= 2

    def check(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for w, index, held in reversed(levels):
            live = np.flatnonzero(ok & (np.minimum(wide[x], wide[y]) >= w))
            if not len(live):
                break
            apart = np.bitwise_count(held[index[x[live]]] ^ held[index[y[live]]]).sum(axis=1)
            ok[live] = apart <= most[live]
        return ok

    return check


def candidate_forest(lines: DataFrame, t: float, ranks, counts, *, bound: int = 20_000) -> DataFrame:
    """(u, v): links between set keys that join all pairs of sets that share a prefix word and pass the filters."""
    spark = lines.sparkSession
    hot = hot_words(lines, t, ranks, counts, bound)
    keyed, word = prefixes(lines, t, ranks), F.shiftright("head", 32)
    if hot:
        k = F.coalesce("k", F.lit(1))
        chunk = F.pmod(F.xxhash64("key", F.lit("chunk")), k).cast("int")
        keyed = keyed.join(F.broadcast(spark.createDataFrame(hot, "hot long, k int")), word == F.col("hot"), "left").withColumns({"k": k, "chunk": chunk})
        keyed = keyed.withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).withColumn("pair", F.least("chunk", "other") * F.col("k") + F.greatest("chunk", "other"))
        # Chunks of a hot word take a hash as their word; words that share one only give more pairs to the filters.
        dealt = F.shiftleft(F.xxhash64(word, "pair"), 32).bitwiseOR(F.col("head").bitwiseAND(0xFFFFFFFF))
        keyed = keyed.select(F.when(F.col("k") > 1, dealt).otherwise(F.col("head")).alias("head"), "key", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        head, key = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in range(2))
        head, bits = head.view(np.uint64), pa.concat_arrays([b.column(2) for b in held])
        order = np.lexsort((head & np.uint64(MOST), key, head >> np.uint64(16)))
        head, key = head[order], key[order]
        new = np.ones(len(key), bool)  # a set that several tasks have stored is here more than once
        new[1:] = (head[1:] != head[:-1]) | (key[1:] != key[:-1])
        head, key = head[new], key[new]
        size, place = (head >> np.uint64(16) & np.uint64(MOST)).astype(np.int64), (head & np.uint64(MOST)).astype(np.int64)
        group = np.concatenate([[0], np.cumsum(head[1:] >> np.uint64(32) != head[:-1] >> np.uint64(32))])
        similar = alike(bits.take(pa.array(order[new])), size)
        # The partners of a row: those after it in its group whose size is at most size / t; they are a range.
        most = np.where(size >= MOST, 1 << 30, np.floor(size / t + 1e-9).astype(np.int64))
        upto = np.searchsorted(group * (1 << 32) + size, group * (1 << 32) + most, side="right")
        many = upto - np.arange(len(key)) - 1
        short = (place <= size - np.ceil(2 * t / (1 + t) * size - 1e-9)) | (size >= MOST)
        rows = np.flatnonzero((many > 0) & short)
        keys, node = np.unique(key, return_inverse=True)
        label = np.arange(len(keys))
        ends = np.cumsum(many[rows])
        for part in np.split(rows, np.flatnonzero(np.diff(ends // AT_ONCE)) + 1):
            m = many[part]
            x = np.repeat(part, m)
            y = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + x + 1
            both = size[x] + size[y]
            need = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
            ok = np.flatnonzero((np.minimum(size[x] - place[x], size[y] - place[y]) >= need) & (label[node[x]] != label[node[y]]) | (size[y] >= MOST))
            x, y, apart = x[ok], y[ok], (both - 2 * need)[ok]
            ok = similar(x, y, apart) | (size[y] >= MOST)
            label = merged(label, node[x[ok]], node[y[ok]])
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[linked]), pa.array(keys[label[linked]])], ["u", "v"])

    parts = common.parts_for(spark, lines.where("words is not null").count() * 10, 500_000)
    return keyed.repartition(parts, F.shiftright("head", 32)).mapInArrow(run, "u long, v long")


def linked_sets(members: DataFrame, t: float, *, bound: int = 2048) -> DataFrame:
    """(key, check, links, doc, at) of members (key, check, root, doc, at, words): of each set with partners, their number and the first place among them.

    A class of more than `bound` sets is dealt in pairs of chunks; pairs within a chunk are compared where it meets itself.
    """
    spark = members.sparkSession
    dealt = sets.dealt(members, ["key", "check"], bound).select("root", "low", "high", "chunk", "key", "check", "doc", "at", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        root, low, high, chunk, key, check, doc, line = (np.concatenate([np.asarray(b.column(i)) for b in held]) for i in range(8))
        links, best = np.zeros(len(root), np.int64), np.full(len(root), len(root))
        by_place = np.lexsort((line, doc))
        place = np.empty(len(root), np.int64)  # of each row in the order of documents and lines
        place[by_place] = np.arange(len(root))
        for x, y in sets.links(root, low, high, chunk, pa.concat_arrays([b.column(8) for b in held]), t):
            links += np.bincount(np.concatenate([x, y]), minlength=len(links))
            np.minimum.at(best, np.concatenate([x, y]), place[np.concatenate([y, x])])
        at = np.flatnonzero(links)
        of = by_place[best[at]]
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(check[at]), pa.array(links[at]), pa.array(doc[of]), pa.array(line[of])], ["key", "check", "links", "doc", "at"])

    parts = common.parts_for(spark, members.count(), 50_000)
    out = dealt.repartition(parts, "root", "low", "high").mapInArrow(run, "key long, check long, links long, doc long, at long")
    return out.groupBy("key", "check").agg(F.sum("links").alias("links"), F.min(F.struct("doc", "at")).alias("other"))


def duplicate_lines(docs: DataFrame, *, t: float = 0.8, bound: int = 20_000, class_bound: int = 2048) -> DataFrame:
    """(doc_id, line, removed, links) of each line that has words; links: the number of other sets that match the line's."""
    spark = docs.sparkSession
    lines = common.stage(stored_lines(docs), "lines")
    counts = bucket_counts(lines)
    ranks = np.empty(1 << BUCKETS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << BUCKETS, dtype=np.uint64)
    roots = components(candidate_forest(lines, t, spark.sparkContext.broadcast(ranks), counts, bound=bound))
    roots = common.stage(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "classes")
    if roots.count() <= 500_000:  # 8 MB
        roots = F.broadcast(roots)
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.col("line").alias("at"))
    members = lines.join(roots, lines["key"] == roots["node"]).groupBy("key", "check", "root").agg(F.min(place).alias("first"), F.max("words").alias("words"))
    members = common.stage(members.select("key", "check", "root", "first.doc", "first.at", "words"), "members")
    near = common.stage(linked_sets(members, t, bound=class_bound), "links")
    # What can remove a line: an earlier line of the same set, or the first partner of its set.
    firsts = lines.groupBy("key", "check").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = firsts.join(near, ["key", "check"], "full").select(F.col("key").alias("k"), F.col("check").alias("c"), "first", "other", "links")
    out = lines.drop("words").join(known, (lines["key"] == F.col("k")) & (lines["check"] == F.col("c")), "left")
    removed = F.coalesce(F.col("first") < place, F.lit(False)) | F.coalesce(F.col("other") < place, F.lit(False))
    return out.select("doc_id", "line", removed.alias("removed"), F.coalesce("links", F.lit(0)).alias("links"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, removed): a row for each document; removed: the numbers of its lines that go."""
    lines = duplicate_lines(docs, **options)
    of = lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count(F.when(F.col("removed"), 1)).alias("n_removed"), F.sum("links").alias("n_links"), F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line")))).alias("removed")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    return ids.join(of, F.col("id").eqNullSafe(F.col("doc_id")), "left").select(F.col("id").alias("doc_id"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_removed", "n_links")), F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))


def without_lines(docs: DataFrame, report: DataFrame) -> DataFrame:
    """docs with texts that lack the lines that the report removes; all columns stay."""
    gone = report.select(F.col("doc_id").alias("__id"), F.col("removed").alias("__removed")).where(F.size("removed") > 0)
    kept = F.array_join(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("i"), x.alias("x"))), lambda s: ~F.array_contains("__removed", s["i"])), lambda s: s["x"]), "\n")
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left").withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
