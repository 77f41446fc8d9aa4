"""Operator 1: token-ID files.

Every text is tokenised, an end id is appended, and the ids of all documents are written in ascending order of
doc_id. Ids are replaced by their frequency rank over the whole corpus (most frequent: 0), so that most take one byte,
and coded in blocks as Stream VByte: control bytes, each with the byte lengths of four values, stand apart from the
data bytes. Reading looks each control byte up in a table of byte masks, without a loop over values.

Defined results: a null or empty text is the end id alone; repeated doc_ids are ordered by the crc32 of their ids; a
null doc_id comes first; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import common

MAGIC = b"WEFTTOK1"
BLOCK = "<IIIII"
#: Values of a control byte -> which of 16 bytes (four values of up to four bytes) are stored.
MASKS = (np.arange(4)[None, None, :] <= ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)[:, :, None]).reshape(256, 16)


def vbyte_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    codes = (values > 0xFF).astype(np.uint8)
    codes += values > 0xFFFF
    codes += values > 0xFFFFFF
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = codes
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    mask = np.arange(4, dtype=np.uint8) <= codes[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[mask].tobytes()


def vbyte_decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of vbyte_encode: a table look-up per control byte says where the data bytes go."""
    mask = MASKS[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[mask] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordTable:
    """64-bit hashes -> entries 0, 1, ...: an open-addressing table that numpy probes for many hashes at once."""

    def __init__(self, bits: int):
        self.bits, self.total = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their entries; -1 for those that aren't in."""
        slots = self._slots(hashes)
        out = self.values[slots]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slots] != hashes))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.values[slots[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slots[open_]] != hashes[open_])]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Enters distinct new hashes, in their order."""
        slots, values = self._slots(hashes), np.arange(self.total, self.total + len(hashes), dtype=np.int32)
        left = np.arange(len(hashes))
        while len(left):
            free = self.values[slots[left]] < 0
            _, first = np.unique(slots[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slots[put]], self.values[slots[put]] = hashes[put], values[put]
            left = left[self.keys[slots[left]] != hashes[left]]
            taken = self.values[slots[left]] >= 0
            slots[left[taken]] = (slots[left[taken]] + 1) & ((1 << self.bits) - 1)
        self.total += len(hashes)


class WordEncoder:
    """Encodes texts with a byte-level tokenizers file, each distinct word once while it is kept.

    The words are those of the byte-level pattern, whose runs of letters, digits, other signs and white space numpy
    finds for many texts at once; the library's model turns a word into ids. Texts with an apostrophe, which may start
    a contraction, or with an added token go to the library whole, as do all if the file isn't of this kind. added: the
    content of an added token in a text is that token, as by the library's default; else special tokens are plain text.
    """

    def __init__(self, path: str, bits: int = 22, added: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.known = kind["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.model, self.letters, self.bits = self.tokenizer.model, _byte_letters(), bits
        self.table_of = str.maketrans({chr(b): c for b, c in enumerate(self.letters)})
        self.whole = ["'", *(t["content"] for t in kind["added_tokens"] if t["content"] and (added or not t["special"]))]
        self.kinds = np.array([self._kind(chr(i)) for i in range(0x3000)] if self.known else [], np.uint8)
        self.powers = np.ones(1, np.uint64)
        self._clear()

    def _kind(self, c: str) -> int:
        """1 letter, 2 number, 3 white space, 0 other: what the library's pattern joins c with."""
        if "\ud800" <= c <= "\udfff":
            return 0
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return next((k for k, x in ((1, "a"), (2, "1"), (0, "!")) if len(split(x + c)) == 1), 3)

    def _clear(self) -> None:
        self.table = WordTable(self.bits)
        self.flat, self.start, self.count = np.zeros(1 << 20, np.uint32), np.zeros(1 << 20, np.int64), np.zeros(1 << 20, np.int32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        got = [[t.id for t in self.model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table_of))] for w in words]
        count = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(count.sum()))
        n, total = self.table.total, self.table.total + len(words)
        for name, size in (("flat", self.used + len(flat)), ("start", total), ("count", total)):
            while len(held := getattr(self, name)) < size:
                setattr(self, name, np.concatenate([held, np.zeros_like(held)]))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n:total], self.count[n:total] = self.used + np.cumsum(count) - count, count
        self.used += len(flat)
        self.table.add(hashes)

    def _powers(self, n: int) -> None:
        if len(self.powers) <= n:
            odd = 0xD1342543DE82EF95
            self.powers, self.inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)])) for m in (odd, pow(odd, -1, 2**64)))

    def starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the pattern's matches start in code points; first: where texts do."""
        kind = self.kinds[np.minimum(codes, len(self.kinds) - 1)]
        high = np.flatnonzero(codes >= len(self.kinds))
        if len(high):
            which, back = np.unique(codes[high], return_inverse=True)
            kind[high] = np.array([self._kind(chr(c)) for c in which.tolist()], np.uint8)[back]
        heads = np.zeros(len(codes), bool)
        heads[first] = True
        start = heads.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last of some white space before another word is a start; a plain space takes the word along.
        ends = np.flatnonzero(start[1:] & ~heads[1:] & (kind[:-1] == 3)) + 1
        start[ends - 1] = True
        start[ends[codes[ends - 1] == 32]] = False
        return np.flatnonzero(start)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        odd = [i for i, x in enumerate(texts) if x and (not self.known or any(k in x for k in self.whole))]
        if odd:
            whole = {i: np.array(e.ids, np.uint32) for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True)}
            ids, sizes = self.encode(["" if i in whole else x for i, x in enumerate(texts)])
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            parts = [whole.get(i, x) for i, x in enumerate(parts)]
            return np.concatenate(parts), np.array([len(x) for x in parts])
        if self.table.total > 0.55 * (1 << self.bits):
            self._clear()
        text = "".join(texts)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(codes):
            return self.flat[:0], np.zeros(len(texts), np.int64)
        self._powers(len(codes))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lengths) - lengths
        start = self.starts(codes, first[lengths > 0])
        end = np.append(start[1:], len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.powers[: len(codes)], out=sums[1:])
        hashes = (sums[end] - sums[start]) * self.inverse[start] ^ (end - start).astype(np.uint64) << np.uint64(56)
        entry = self.table.find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            own, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            self._learn(own, [text[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            entry[new] = self.table.find(hashes[new])
        count = self.count[entry].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[entry] - (ends - count), count) + np.arange(int(ends[-1]))]
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, np.append(first, len(codes)))]
        return ids, np.diff(bounds)


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def _encoder(path: str, added: bool) -> WordEncoder:
    """One for each Python worker; it serves all tasks of the worker."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = WordEncoder(path, added=added)
    return _ENCODERS[path, added]


def width(tokenizer_path: str) -> str:
    """The numpy type of the ids between the steps: 16 bits where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, chunk_chars: int = 1_000_000, added: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of each whole text and the end id, little-endian and unsigned, of width()."""
    kind = width(tokenizer_path)
    unit = int(kind[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, added)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= chunk_chars):
                    size += len(texts[to])
                    to += 1
                ids, sizes = encoder.encode(texts[at:to])
                ends = np.cumsum(sizes + 1)
                out = np.full(int(ends[-1]), end_id, kind)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                buffers = [None, pa.py_buffer(np.concatenate([[0], ends * unit]).astype(np.int32)), pa.py_buffer(out)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.Array.from_buffers(pa.binary(), to - at, buffers)], ["doc_id", "ids"])
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def id_ranks(tokens: DataFrame, kind: str = "<u4") -> np.ndarray:
    """Ids by falling count over all tokens, ties by id. Its size is that of the vocabulary, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                got = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(got) > len(total):
                    got, total = total, got
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], dtype="<u4")


def write_files(tokens: DataFrame, by_rank: np.ndarray, out_uri: str, *, files: int, kind: str = "<u4", block_tokens: int = 1 << 20) -> DataFrame:
    """Writes one file for each range of doc_ids; (file, first, n_docs, n_tokens, n_bytes), a row for each file."""
    spark = tokens.sparkSession
    ranks = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, "<u4")
    ranks[by_rank] = np.arange(len(by_rank))
    common.put_file(f"{out_uri}/ranks.bin", lambda f: f.write(by_rank.tobytes()))
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank, unit = shared.value, int(kind[2])
        name = f"part-{TaskContext.get().partitionId():06d}.wtok"
        total = {"docs": 0, "tokens": 0, "bytes": 0}
        first = None

        def block(stream, keys: list, ids: list[bytes]) -> None:
            flat = np.frombuffer(b"".join(ids), kind)
            control, data = vbyte_encode(rank[flat])
            known = np.array([k is not None for k in keys], np.uint8).tobytes()
            body = known + np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([len(x) // unit for x in ids], "<u4").tobytes() + control + data
            stream.write(struct.pack(BLOCK, len(keys), len(flat), len(control), len(data), zlib.crc32(body)) + body)
            total["docs"] += len(keys)
            total["tokens"] += len(flat)
            total["bytes"] += struct.calcsize(BLOCK) + len(body)

        def write(stream) -> None:
            nonlocal first
            head = json.dumps({"coding": "stream-vbyte", "ids": len(by_rank), "ranks": "ranks.bin"}).encode()
            stream.write(MAGIC + struct.pack("<I", len(head)) + head)
            keys, ids, size = [], [], 0
            for batch in batches:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    first = (key,) if first is None else first
                    keys.append(key)
                    ids.append(value)
                    size += len(value) // unit
                    if size >= block_tokens:
                        block(stream, keys, ids)
                        keys, ids, size = [], [], 0
            if keys:
                block(stream, keys, ids)
            stream.write(struct.pack(BLOCK, 0, 0, 0, 0, 0))

        common.put_file(f"{out_uri}/{name}", write)
        if total["docs"]:
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [int(name[5:11])], "n_docs": [total["docs"]], "n_tokens": [total["tokens"]], "n_bytes": [total["bytes"]]})

    ordered = tokens.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.crc32("ids"), "ids")
    return ordered.mapInArrow(run, "file string, part long, n_docs long, n_tokens long, n_bytes long")


def read_block(stream) -> tuple[list, np.ndarray, np.ndarray] | None:
    """(doc_ids, ids in each document, ranks of all ids) of the next block; None at the end of the file."""
    n_docs, n_tokens, n_control, n_data, crc = struct.unpack(BLOCK, stream.read(struct.calcsize(BLOCK)))
    if not n_docs:
        return None
    body = stream.read(n_docs * 13 + n_control + n_data)
    if len(body) != n_docs * 13 + n_control + n_data or zlib.crc32(body) != crc:
        raise ValueError("a block of the token file is broken")
    known, keys = body[:n_docs], np.frombuffer(body, "<i8", n_docs, n_docs).tolist()
    counts = np.frombuffer(body, "<u4", n_docs, n_docs * 9).astype(np.int64)
    at = n_docs * 13
    return [k if ok else None for k, ok in zip(keys, known, strict=True)], counts, vbyte_decode(body[at : at + n_control], body[at + n_control :], n_tokens)


def blocks_of(uri: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, counts, ids) of each block of a file, in its order."""
    system, path = common.file_system(uri)
    with system.open_input_stream(f"{path.rpartition("/")[0]}/ranks.bin", compression=None) as stream:
        by_rank = np.frombuffer(stream.read(), "<u4")
    with system.open_input_stream(path, compression=None) as stream:
        if stream.read(8) != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        stream.read(struct.unpack("<I", stream.read(4))[0])
        while (got := read_block(stream)) is not None:
            yield got[0], got[1], by_rank[got[2]]


def read_files(spark: SparkSession, out_uri: str, manifest: list, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files. manifest: the rows of write_files, one for each file."""
    starts, at = [], 0
    for row in sorted(manifest, key=lambda r: r["part"]):
        starts.append((row["file"], at))
        at += row["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for keys, counts, ids in blocks_of(f"{out_uri}/{name}"):
                    ends = np.cumsum(counts)
                    raw = ids.astype("<u4").tobytes()
                    texts = [raw[(e - n) * 4 : e * 4] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                    out = {"doc_id": pa.array(keys, pa.int64()), "start": start + ends - counts, "n_tokens": counts, "ids_crc32": np.array([zlib.crc32(x) for x in texts], np.int64)}
                    yield pa.RecordBatch.from_pydict(out | ({"ids": texts} if with_ids else {}))
                    start += int(ends[-1])

    files = spark.createDataFrame(starts, "file string, start long").repartition(max(1, len(starts)))
    return files.mapInArrow(run, schema)


def write_token_files(docs: DataFrame, tokenizer_path: str, out_uri: str, *, end_id: int = 0, file_bytes: int = 16 << 20, added: bool = False) -> list:
    """Tokenises docs (doc_id, text) and writes the files; their manifest, a row for each file."""
    kind = width(tokenizer_path)
    tokens = common.stage(tokenize(docs, tokenizer_path, end_id=end_id, added=added), "tokens")
    size = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    files = common.parts_for(docs.sparkSession, size, file_bytes)
    manifest = write_files(tokens, id_ranks(tokens, kind), out_uri, files=files, kind=kind).collect()
    common.unstage(tokens)
    return manifest


def token_digests(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, added: bool = False) -> DataFrame:
    """Writes the files to the shared folder and reads them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    out = common.new_path(spark, "token-files")
    return read_files(spark, out, write_token_files(docs, tokenizer_path, out, end_id=end_id, added=added), with_ids=False)
