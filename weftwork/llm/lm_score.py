"""Operator 4: scores of a bigram language model kept in a log-frequency Bloom filter.

The counts of all training words and bigrams are gathered exactly, in two grouped sums over hashes. An n-gram with count
c enters the filter once for each level 1 .. 1 + floor(log_b c), so that its quantised count comes back by probing
level after level until one is missing; level 1 stands for a count of 1. All bits of an entry lie in one 64-bit word of
the filter. The size of the filter follows the sum of all levels. It is cut into blocks by key, of at most `bits` bits
each, which tasks fill and leave in the shared folder; a task that probes sorts the n-grams of many texts by block and
reads block after block, so that it never holds more than one. All words and bigrams of all training documents are in it.

P(w | h) = a_h * c(h w) / c(h) + (1 - a_h) * P(w), with quantised counts (the lower bound above, the upper below, so
that quantising can't add up to more than 1) and P(w) from the mean count of the word's level. Every factor follows
from three levels: those of the context, the bigram and the word. So the texts are probed once, and their levels are
written down, three bytes a token. The a_h, by the level of the context, come from expectation maximisation over the
number of tokens at each triple of levels in all training documents, with each token's own count taken out; then the
written levels give the scores.

The base score needs exact counts. The `head` most frequent words, or fewer by chance where many share the least
count (those are cut by key), have them by broadcast, of bounded size; the rest, each in few documents, meet their
counts in one shuffle by word, and no word of it is frequent enough to be hot.

Defined results: a null or empty text is the end token alone; a null doc_id is learned from; each repeated row counts;
without training rows N and V are 0 and every token has the probability of an unknown one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm import common, wordhash
from weftwork.llm.wordhash import Counts, mix

END, BEGIN = np.uint64(0x5EED0E4D), np.uint64(0x5EED0BE6)
#: What a task holds at once, whatever its share of the rows: bytes of texts, tokens probed together, n-grams counted, keys of a step over arrays, rows handed on.
RUN_BYTES, GROUP, HELD, STEP, OUT_ROWS = 1_000_000, 1 << 21, 1 << 20, 1 << 18, 1 << 16


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of a bigram."""
    return mix(h * np.uint64(wordhash.ODD) + mix(w))


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    """0 for none, else 1 + floor(log_base(c))."""
    return np.where(counts < 1, 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9)).astype(np.int64)


def least_count(levels: np.ndarray, base: float) -> np.ndarray:
    """The least count of each level above 0."""
    return np.ceil(base ** (levels - 1.0) - 1e-6)


def steps(n: int) -> Iterator[slice]:
    """Slices of n rows whose temporary arrays stay small."""
    return (slice(at, min(n, at + STEP)) for at in range(0, n, STEP))


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows of at most `most` in all; a larger row is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list, list]]:
    """(from, to, ids, texts) of runs of a batch (doc_id, text), so that only one run's texts are Python objects."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64) + 1
    for at, to in spans(sizes, RUN_BYTES):
        yield at, to, batch.column(0).slice(at, to - at).to_pylist(), batch.column(1).slice(at, to - at).to_pylist()


def handed_on(total: Counts, names: list[str], least: int = 0) -> Iterator[pa.RecordBatch]:
    """Merges what is counted; if more than `least` keys, hands them on in small batches and forgets them."""
    total.merge()
    if len(total.keys) > least:
        keys, sums = total.keys.view(np.int64), total.sums
        total.keys, total.sums = np.zeros(0, np.uint64), np.zeros((0, total.columns), np.int64)
        for at in range(0, len(keys), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), *(pa.array(sums[part, i]) for i in range(total.columns))], names)


class LogFilter:
    """A Bloom filter of (key, level) in blocks by key, each a file of the shared folder that one task fills; a probe holds one block at a time."""

    def __init__(self, path: str, filled: set[int], blocks: int, block_words: int, most: int):
        self.path, self.filled, self.blocks, self.block_words, self.most = path, filled, blocks, block_words, most

    @staticmethod
    def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
        """Blocks are ranges of the keys, which are spread evenly."""
        return ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def places(keys: np.ndarray, level: int, block_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, its bits) of an entry: four bits of one 64-bit word."""
        a = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
        one, low = np.uint64(1), np.uint64(63)
        bits = one << (a & low) | one << (a >> np.uint64(6) & low) | one << (a >> np.uint64(12) & low) | one << (a >> np.uint64(18) & low)
        return ((a >> np.uint64(32)) * np.uint64(block_words) >> np.uint64(32)).astype(np.int64), bits

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The quantised level of each key: probed upwards until a level is missing."""
        out = np.zeros(len(keys), np.uint8)
        if not len(keys):
            return out
        system, path = common.file_system(self.path)
        block = np.empty(len(keys), np.uint16 if self.blocks < 1 << 16 else np.int64)
        for own in steps(len(keys)):
            block[own] = self.block_of(keys[own], self.blocks)
        order = np.argsort(block, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=self.blocks))])
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            if b in self.filled:
                with system.open_input_stream(f"{path}/{b:06d}", compression=None) as stream:
                    bits = np.frombuffer(stream.read(), np.uint64)
                at = order[bounds[b] : bounds[b + 1]]
                for own in steps(len(at)):
                    out[at[own]] = self._probe(bits, keys[at[own]])
        return out

    def _probe(self, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for level in range(1, self.most + 1):
            word, own = self.places(keys, level, self.block_words)
            found = np.flatnonzero(bits[word] & own == own)
            if not len(found):
                break
            live, keys = live[found], keys[found]
            out[live] = level
        return out


def token_rows(texts: list):
    """(hashes of all words and an end for each text, number of tokens of each)."""
    hashes, counts, _ = wordhash.words(texts)
    counts = counts + 1
    ends = np.cumsum(counts)
    out = np.full(int(ends[-1]), END)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = hashes
    return out, counts


def contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each, BEGIN for the first of a text."""
    out = np.concatenate([[BEGIN], tokens[:-1]])
    out[np.cumsum(counts) - counts] = BEGIN
    return out


def unigrams(docs: DataFrame) -> DataFrame:
    """(key, c, a): the count of each token in training documents and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts(2, 1 << 62)
        for batch in batches:
            for _, _, ids, texts in runs(batch):
                tokens, counts = token_rows(texts)
                train = np.repeat([not held_out(x) for x in ids], counts)
                keys, back, n = np.unique(tokens, return_inverse=True, return_counts=True)
                total.add(keys, np.stack([np.bincount(back, train, len(keys)).astype(np.int64), n], axis=1))
                if total.size > HELD:
                    yield from handed_on(total, ["key", "c", "a"], HELD // 2)
        yield from handed_on(total, ["key", "c", "a"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, c long, a long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def pairs_of(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bigram that ends in each token."""
    out = contexts(tokens, counts)
    for own in steps(len(out)):
        out[own] = pair(out[own], tokens[own])
    return out


def token_groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, tokens, number of tokens of each) of runs of texts of about GROUP tokens, which are probed at once."""
    held, size, first = [], 0, 0
    for _, to, _, texts in runs(batch):
        held.append(token_rows(texts))
        size += len(held[-1][0])
        if size >= GROUP or to == batch.num_rows:
            tokens, counts = np.concatenate([t for t, _ in held]), np.concatenate([c for _, c in held])
            held, size = [], 0
            yield first, to, tokens, counts
            first = to


def bigrams(docs: DataFrame) -> DataFrame:
    """(key, c): the count of each bigram in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts(1, 1 << 62)
        for batch in batches:
            for _, _, ids, texts in runs(batch):
                texts = [t for i, t in zip(ids, texts, strict=True) if not held_out(i)]
                if not texts:
                    continue
                total.add(*np.unique(pairs_of(*token_rows(texts)), return_counts=True))
                if total.size > HELD:
                    yield from handed_on(total, ["key", "c"], HELD // 2)
        yield from handed_on(total, ["key", "c"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def build_filter(grams: DataFrame, total: int, *, base: float, bits: int, entry_bits: int, most: int) -> LogFilter:
    """grams (key, c): the filter of those with a level, of total levels in all; its size follows total, that of a block is at most bits."""
    blocks = max(1, -(-total * entry_bits // bits))
    # Keys are dealt by chance: room for a small block's share above the mean.
    block_words = int(total * entry_bits / blocks * (1 + 4 / np.sqrt(max(1, total / blocks)))) // 64 + 1
    path = common.new_path(grams.sparkSession, "filter")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = LogFilter.block_of(np.asarray(batch.column(0)).view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block)], ["key", "c", "block"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, counts, block = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            levels = np.minimum(level_of(counts, base), most)
            for b in np.unique(block).tolist():
                own = held.setdefault(b, np.zeros(block_words, np.uint64))
                of, upto = keys[block == b], levels[block == b]
                for level in range(1, int(upto.max()) + 1):
                    of, upto = of[upto >= level], upto[upto >= level]
                    np.bitwise_or.at(own, *LogFilter.places(of, level, block_words))
        for b, own in held.items():
            common.put_file(f"{path}/{b:06d}", lambda f, own=own: f.write(own.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b])], ["block"])

    filled = grams.mapInArrow(numbered, "key long, c long, block long").repartition(blocks, "block").mapInArrow(fill, "block long")
    return LogFilter(path, {r["block"] for r in filled.collect()}, blocks, block_words, most)


def factors(triples: np.ndarray, base: float, means: np.ndarray, norm: float, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bigram probability, word probability) at (context, bigram, word) levels; less: own counts to take out."""
    context, both, word = triples.T
    seen = np.where(both > 0, least_count(both, base), 0.0)
    of = np.where(context > 0, np.maximum(least_count(context, base), least_count(context + 1, base) - 1), 1.0)
    ratio = np.minimum(1.0, np.maximum(0.0, seen - less) / np.maximum(1.0, of - less))
    return np.where(context > 0, ratio, 0.0), (np.maximum(0.0, means[word] - less * (word > 0)) + 0.5) / norm


def fit_mixture(triples: np.ndarray, n: np.ndarray, base: float, means: np.ndarray, norm: float, *, steps: int = 50) -> np.ndarray:
    """The mixture weights by context level, from the number of training tokens at each triple of levels."""
    levels = len(means)
    two, one = factors(triples, base, means, norm, less=1)
    a, total = np.full(levels, 0.3), np.bincount(triples[:, 0], n, levels)
    for _ in range(steps):
        own = a[triples[:, 0]]
        share = own * two / (own * two + (1 - own) * one)
        a = (np.bincount(triples[:, 0], n * share, levels) + 1e-3) / (total + 1e-2)
    a = np.minimum(a, 0.95)
    a[(total == 0) | (np.arange(levels) == 0)] = 0
    return a


def head_words(words: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, training counts) of the most frequent words (key, c, a) by a, about `head`: classes of like counts, of the last one those with the least keys."""
    # Classes of counts, finer than a twentieth: at most some thousand rows, whatever the counts are.
    cls = F.floor(F.log2("a") * 32).cast("int")
    sizes = sorted(((r["cls"], r["n"]) for r in words.where("a > 0").groupBy(cls.alias("cls")).agg(F.count("*").alias("n")).collect()), reverse=True)
    upto, held, cut = 1 << 30, 0, None
    for k, n in sizes:
        if held + n > head:
            cut = (k, (head - held) / n)
            break
        upto, held = k, held + n
    keep = cls >= upto
    if cut:  # keys are hashes, spread evenly over all 64-bit numbers
        keep = keep | (cls == cut[0]) & (F.col("key") < int((cut[1] - 0.5) * 2**64) if cut[1] < 1 else F.lit(True))
    table = words.where((F.col("a") > 0) & keep).select("key", "c").toPandas()
    keys = table["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["c"].to_numpy().astype(np.int64)[order]


SCHEMA = "kind int, row long, doc_id long, n_tokens long, n_known long, base double, levels binary, key long, times long, train boolean, triple long, n long"


def probed(docs: DataFrame, filter_: LogFilter, starts_level: int, known: np.ndarray, exact: np.ndarray, smooth: float) -> DataFrame:
    """Rows of three kinds: 0 a document with the levels of its tokens and the base score of its head words, 1 a rarer word of a document, 2 how many training tokens of a task are at a triple of levels."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((filter_, known, exact))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(size, t) for k, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lm, head, counts_of = shared.value
        row = TaskContext.get().partitionId() << 40
        seen = Counts(1)
        for batch in batches:
            ids = batch.column(0)
            for at, to, tokens, counts in token_groups(batch):
                n, first = to - at, np.cumsum(counts) - counts
                both = lm.levels(pairs_of(tokens, counts))
                words, back = np.unique(tokens, return_inverse=True)
                back, size, tokens = back.astype(np.int32), len(tokens), None
                word = lm.levels(words)[back]
                before = np.concatenate([np.array([starts_level], np.uint8), word[:-1]])
                before[first] = starts_level
                levels = np.stack([before, both, word], axis=1)
                place = np.minimum(np.searchsorted(head, words), max(0, len(head) - 1))
                in_head = head[place] == words if len(head) else np.zeros(len(words), bool)
                c = np.where(in_head, counts_of[place], 0) if len(head) else np.zeros(len(words), np.int64)
                logs = np.where(in_head, np.log10((c + 0.5) / smooth), 0.0)
                out_ids = ids.slice(at, n)
                train = np.array([not held_out(x) for x in out_ids.to_pylist()])
                number = np.arange(row, row + n)
                row += n
                ends = np.concatenate([first, [size]]).astype(np.int64) * 3
                packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(levels.tobytes())])
                yield rows(n, kind=pa.array(np.zeros(n, np.int32)), row=pa.array(number), doc_id=out_ids, n_tokens=pa.array(counts), n_known=pa.array(np.add.reduceat((c > 0)[back].astype(np.int64), first)), base=pa.array(np.add.reduceat(logs[back], first)), levels=packed, train=pa.array(train))
                codes, learned = before.astype(np.int32), np.repeat(train, counts)
                for own in (both, word):
                    codes <<= 8
                    codes |= own
                kinds, times = np.unique(codes[learned], return_counts=True)
                seen.add(kinds.astype(np.uint64), times)
                seen.merge()
                rare = np.flatnonzero(~in_head[back])
                if len(rare):
                    owner = np.searchsorted(first, rare, "right") - 1
                    owner *= len(words)
                    owner += back[rare]
                    code, times = np.unique(owner, return_counts=True)
                    for s in range(0, len(code), OUT_ROWS):
                        owner, rare = np.divmod(code[s : s + OUT_ROWS], len(words))
                        m = len(owner)
                        yield rows(m, kind=pa.array(np.ones(m, np.int32)), row=pa.array(number[owner]), key=pa.array(words[rare].view(np.int64)), times=pa.array(times[s : s + OUT_ROWS]), train=pa.array(train[owner]))
        m = len(seen.keys)
        yield rows(m, kind=pa.array(np.full(m, 2, np.int32)), triple=pa.array(seen.keys.view(np.int64)), n=pa.array(seen.sums[:, 0]))

    return docs.mapInArrow(run, SCHEMA)


def score(docs: DataFrame, *, head: int = 1 << 19, base: float = 1.5, bits: int = 1 << 25, entry_bits: int = 12) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text), a row for each.

    entry_bits: bits of the filter for each level of an n-gram; 12 raise about one level in a hundred.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = common.stage(unigrams(docs), "unigrams")
    total, kinds, starts = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.max(F.when(F.col("key") == int(END), F.col("c"))), F.lit(0))).first()
    most = int(level_of(np.array([max(1, total)]), base)[0])
    known, exact = head_words(words, head)
    pairs = common.stage(bigrams(docs), "bigrams")

    # Levels of the filter: how many words are at each, and their mean count. Levels by the same rule as level_of().
    level = F.when(F.col("c") < 1, F.lit(0)).otherwise(F.lit(1) + F.floor(F.log("c") / F.lit(float(np.log(base))) + 1e-9)).cast("int")
    means, norm = np.zeros(most + 1), 0.5
    for r in words.where("c > 0").groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect():
        means[r["l"]] = r["s"] / r["n"]
        norm += r["n"] * (means[r["l"]] + 0.5)
    grams = words.select("key", "c").unionByName(pairs).where("c > 0")
    levels = grams.agg(F.coalesce(F.sum(level), F.lit(0))).first()[0]
    filter_ = build_filter(grams, levels, base=base, bits=bits, entry_bits=entry_bits, most=most)
    common.unstage(pairs)
    smooth = total + 0.5 * (kinds + 1)
    seen = common.stage(probed(docs, filter_, min(most, int(level_of(np.array([starts]), base)[0])), known, exact, smooth), "probed")

    table = seen.where("kind = 2").groupBy("triple").agg(F.sum("n").alias("n")).toPandas()
    triples = table["triple"].to_numpy().astype(np.int64)
    triples = np.stack([triples >> 16, triples >> 8 & 255, triples & 255], axis=1)
    mixture = fit_mixture(triples, table["n"].to_numpy().astype(float), base, means, norm) if len(triples) else np.zeros(most + 1)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(batch.num_columns - 1)]
            out = np.zeros(len(flat))
            for at, to in spans(np.array([len(x) // 3 for x in flat], np.int64), STEP):
                part = flat[at:to]
                own = np.concatenate(part).reshape(-1, 3).astype(np.int64)
                kind, back = np.unique(own[:, 0] << 16 | own[:, 1] << 8 | own[:, 2], return_inverse=True)
                kind = np.stack([kind >> 16, kind >> 8 & 255, kind & 255], axis=1)
                two, one = factors(kind, base, means, norm)
                a = mixture[kind[:, 0]]
                logs = np.log10(a * two + (1 - a) * one)[back]
                sizes = np.array([len(x) // 3 for x in part])
                out[at:to] = np.add.reduceat(logs, np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*batch.schema.names[:-1], "score"])

    whole = seen.where("kind = 0").select("row", "doc_id", "train", "n_tokens", "n_known", "base", "levels")
    whole = whole.mapInArrow(scores, "row long, doc_id long, train boolean, n_tokens long, n_known long, base double, score double")
    # Rarer words meet their counts, then their documents.
    c = F.sum(F.when(F.col("train"), F.col("times")).otherwise(0)).over(Window.partitionBy("key"))
    rare = seen.where("kind = 1").select("row", "key", "times", "train").withColumn("c", c).groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(float(smooth)))).alias("logs")
    )
    out = whole.join(rare, "row", "left")
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), "score",
    )
