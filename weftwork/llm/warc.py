"""Operator 9: WARC archives in Zstandard, written and read.

An archive starts with its dictionary in a skippable frame; each record is a frame of its own, compressed with that
dictionary. The reader loads the dictionary, decodes frame by frame and checks the headers, the lengths and the
digests of every record. Records whose payloads are equal and long enough are revisits of the one with the smallest id.

Defined results: a null html is an empty payload; a null url leaves out the target; rows of one page_id and payload are
all responses or all revisits; a null page_id never is what others refer to, unless no other has the payload, when all
are responses; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import common

SKIPPABLE = 0x184D2A5D
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2026-01-01T00:00:00Z"
_ID = re.compile(rb"<urn:page:(-?\d+|none)>")


class BadArchive(ValueError):
    """A frame, header or length that isn't as it must be."""


def _uri(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of a response record, or of a revisit record, which has the payload's digest and length only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id), b"WARC-Date: " + DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _uri(url))
    head += [b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode()]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + PROFILE]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record's bytes; BadArchive if its headers, lengths or digests don't hold."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise BadArchive(f"no record starts with {raw[:20]!r}")
    fields: dict[bytes, bytes] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name) or name.lower() in fields:
            raise BadArchive(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    missing = {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"} - fields.keys()
    if missing or not fields[b"content-length"].isdigit():
        raise BadArchive(f"headers are missing or bad: {sorted(missing)}")
    length = int(fields[b"content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"the block has {len(rest) - 4} bytes, its header says {length}")
    if fields.get(b"warc-block-digest", b"sha256:" + hashlib.sha256(block).hexdigest().encode()) != b"sha256:" + hashlib.sha256(block).hexdigest().encode():
        raise BadArchive("the block's digest differs")
    kind = fields[b"warc-type"].decode("ascii", "replace")
    out = {"type": kind, "fields": fields, "block": block}
    if kind not in ("response", "revisit"):
        return out
    named = _ID.fullmatch(fields[b"warc-record-id"])
    http, found, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: (\d+)", http)
    digest = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha256:")
    if not (named and found and size and re.fullmatch("[0-9a-f]{64}", digest)):
        raise BadArchive("a response without its id, HTTP head or payload digest")
    out |= {"page_id": None if named[1] == b"none" else int(named[1]), "payload_bytes": int(size[1]), "digest": digest, "refers_to": None}
    if kind == "revisit":
        to = _ID.fullmatch(fields.get(b"warc-refers-to", b""))
        if payload or not to or fields.get(b"warc-profile") != PROFILE:
            raise BadArchive("a revisit with a payload, or without what it revisits")
        return out | {"refers_to": int(to[1])}
    if len(payload) != int(size[1]) or hashlib.sha256(payload).hexdigest() != digest:
        raise BadArchive("the payload differs from its length or digest")
    return out


def train(samples: list[bytes], size: int):
    """A dictionary from a bounded sample of an archive's first records; None where they are too few."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


def write_archive(stream, records: Iterator[bytes], *, level: int = 3, sample_bytes: int = 2 << 20, dictionary_bytes: int = 32 << 10) -> int:
    """Writes the records, each a frame; the number of records."""
    import zstandard

    held, size, n = [], 0, 0
    for raw in records:
        held.append(raw)
        size += len(raw)
        if size >= sample_bytes:
            break
    trained = train([x[:65536] for x in held], dictionary_bytes)
    if trained is not None:
        raw = trained.as_bytes()
        stream.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    info = b"format: WARC File Format 1.1\r\n"
    stream.write(packer.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:warcinfo>\r\nWARC-Date: " + DATE + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(info) + info + b"\r\n\r\n"))
    for source in (held, records):
        for raw in source:
            stream.write(packer.compress(raw))
            n += 1
    return n


def read_archive(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of each record of an archive, a frame each."""
    import zstandard

    data = stream.read(chunk)
    dictionary = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0] + 8
        while len(data) < size:
            more = stream.read(size - len(data))
            if not more:
                raise BadArchive("the dictionary's frame is cut short")
            data += more
        raw, data = data[8:size], data[size:]
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(chunk)):
        frame, out = reader.decompressobj(), []
        try:
            out.append(frame.decompress(data))
            while not frame.eof:
                data = stream.read(chunk)
                if not data:
                    raise BadArchive("the last frame is cut short")
                out.append(frame.decompress(data))
        except zstandard.ZstdError as e:
            raise BadArchive(f"a frame can't be decoded: {e}") from e
        data = frame.unused_data
        yield b"".join(out)


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    firsts = own.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = own.join(firsts, own["digest"] == firsts["d"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, out_uri: str, *, least_bytes: int = 100, archive_bytes: int = 256 << 20) -> list:
    """Writes the archives of each partition, a new one after about archive_bytes of records; their manifest (file, records), a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ahead, number = next(rows, None), 0

        def raw() -> Iterator[bytes]:
            nonlocal ahead
            size = 0
            while ahead is not None and size < archive_bytes:
                out = record(ahead[0], ahead[1], ahead[2].encode("utf-8", "surrogatepass"), ahead[3], ahead[4])
                ahead, size = next(rows, None), size + len(out)
                yield out

        while ahead is not None:
            name, counts = f"part-{TaskContext.get().partitionId():06d}-{number:04d}.warc.zst", []
            common.put_file(f"{out_uri}/{name}", lambda stream, counts=counts: counts.append(write_archive(stream, raw())))
            yield pa.RecordBatch.from_pydict({"file": [name], "records": counts})
            number += 1

    return with_revisits(pages, least_bytes).mapInArrow(run, "file string, records long").collect()


def read_archives(spark: SparkSession, out_uri: str, manifest: list) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records of the archives."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = common.file_system(f"{out_uri}/{name}")
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for raw in read_archive(stream):
                        x = parse(raw)
                        if x["type"] in ("response", "revisit"):
                            rows.append((x["page_id"], x["payload_bytes"], x["digest"], x["type"], x["refers_to"]))
                if len(rows) != expected:
                    raise BadArchive(f"{name} has {len(rows)} records; {expected} were written")
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.createDataFrame([(r["file"], r["records"]) for r in manifest], "file string, records long").repartition(max(1, len(manifest)))
    return files.mapInArrow(run, schema)
