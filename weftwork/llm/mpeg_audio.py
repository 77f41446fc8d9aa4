"""Operator 8: MPEG audio columns.

parse() reads MPEG audio of any version and layer: it skips and reads ID3 tags, finds frame headers again after
anything that isn't a frame, also those of free bitrate, reads the variable-bitrate table (Xing, Info or VBRI), verifies
each frame's CRC-16 (over the side information of Layer III, the allocation of Layer I, allocation and scale factor selection of Layer II), and
gives the exact duration and the offset of every frame, to seek by.

store() keeps bytes losslessly as such a file: Layer III frames of silence (their side information claims no main data)
hold the payload as ancillary data, in frames of 320 kbit/s and a last one of the least rate that fits; the first frame
has the variable-bitrate table, and an ID3 tag the payload's length.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal media; a null doc_id stays
null; repeated rows stay; an empty table gives no rows; other columns are ignored. A file without any frame has no
duration; a frame whose CRC differs is counted, and its body isn't payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common

#: kbit/s by (version 1, layer) or (version 2, layer); index 0 (free) and 15 are no rates here.
RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Layer II: subbands by the bits of their allocation, of each table: (subbands, bits), in order.
ALLOCATION = {
    "high rates at 48 kHz, middle rates": ((11, 4), (12, 3), (4, 2)),
    "high rates at 44.1 and 32 kHz": ((11, 4), (12, 3), (7, 2)),
    "low rates at 48 and 44.1 kHz": ((2, 4), (6, 3)),
    "low rates at 32 kHz": ((2, 4), (10, 3)),
    "version 2": ((4, 4), (7, 3), (19, 2)),
}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


@lru_cache(maxsize=4096)
def header(raw: bytes) -> dict | None:
    """The fields of a frame's four header bytes; None if they are none. A free bitrate has no length of its own."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 2.5}.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or index == 15 or rate == 3 or raw[3] & 3 == 2:
        return None
    kind = (1 if version == 1 else 2, layer)
    bits = RATES[kind][index - 1] * 1000 if index else 0
    hertz = (44100, 48000, 32000)[rate] // {1: 1, 2: 2, 2.5: 4}[version]
    pad, mode = raw[2] >> 1 & 1, raw[3] >> 6
    length = None if not index else (12 * bits // hertz + pad) * 4 if layer == 1 else SAMPLES[kind] // 8 * bits // hertz + pad
    mono = mode == 3
    side = 0 if layer != 3 else {(1, True): 17, (1, False): 32, (2, True): 9, (2, False): 17}[kind[0], mono]
    joint = 4 * ((raw[3] >> 4 & 3) + 1) if mode == 1 else None  # the subband from which two channels share their allocation
    return {"version": version, "layer": layer, "bits": bits, "hertz": hertz, "length": length, "pad": pad * (4 if layer == 1 else 1), "samples": SAMPLES[kind], "crc": not raw[1] & 1, "side": side, "channels": 1 if mono else 2, "joint": joint}


def allocation_bits(found: dict, length: int) -> list[int]:
    """Bits of the allocation of each subband of a Layer I or II frame."""
    if found["layer"] == 1:
        return [4] * 32
    rate = (found["bits"] or length * 8 * found["hertz"] // found["samples"]) // found["channels"] // 1000
    if found["version"] != 1:
        name = "version 2"
    elif found["hertz"] == 48000 and rate >= 56 or 56 <= rate <= 80:
        name = "high rates at 48 kHz, middle rates"
    elif found["hertz"] != 48000 and rate >= 96:
        name = "high rates at 44.1 and 32 kHz"
    else:
        name = "low rates at 48 and 44.1 kHz" if found["hertz"] != 32000 else "low rates at 32 kHz"
    return [bits for many, bits in ALLOCATION[name] for _ in range(many)]


def covered(frame: bytes, found: dict) -> tuple[bytes, int]:
    """(what a frame's CRC covers besides the header's last two bytes, its number of bits)."""
    if found["layer"] == 3:
        return frame[6 : 6 + found["side"]], 8 * found["side"]
    stream, size = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6)
    at = selected = 0
    for band, bits in enumerate(allocation_bits(found, len(frame))):
        shared = found["joint"] is not None and band >= found["joint"]
        for _ in range(1 if shared else found["channels"]):
            at += bits
            if at <= size and stream >> (size - at) & ((1 << bits) - 1):
                selected += found["channels"] if shared else 1
    at += 2 * selected if found["layer"] == 2 else 0
    return frame[6 : 6 + -(-at // 8)], at


def free_length(media: bytes, at: int, end: int) -> int | None:
    """The length, without padding, of a frame of free bitrate: up to the next header like its own."""
    own = header(media[at : at + 4])
    to = at + 4
    while (to := media.find(media[at : at + 2], to, end)) >= 0:
        then = header(media[to : to + 4])
        if then is not None and then["length"] is None and (then["hertz"], then["channels"]) == (own["hertz"], own["channels"]):
            return to - at - own["pad"]
        to += 1
    return None


@lru_cache(maxsize=65536)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The CRC of MPEG audio over the first bits of data, or all: polynomial 0x8005 from 0xFFFF, most significant bit first."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        crc ^= byte << 8 & (0xFFFF << max(0, 16 - left))
        for _ in range(min(8, left)):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        left = max(0, left - 8)
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def id3(texts: dict[str, str]) -> bytes:
    """An ID3v2.3 tag of user texts."""
    body = b""
    for name, value in texts.items():
        text = b"\0" + name.encode("latin-1") + b"\0" + value.encode("latin-1")
        body += b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\0\0" + _syncsafe(len(body)) + body


def read_id3(media: bytes) -> tuple[dict[str, str], int]:
    """(user texts, bytes of the tag at the start of media); an empty tag of 0 bytes if there is none."""
    if len(media) < 10 or media[:3] != b"ID3" or any(b & 128 for b in media[6:10]):
        return {}, 0
    size = media[6] << 21 | media[7] << 14 | media[8] << 7 | media[9]
    body, at, texts = media[10 : 10 + size], 0, {}
    while at + 10 <= len(body) and body[at : at + 4].isalnum():
        (n,) = struct.unpack(">I", body[at + 4 : at + 8]) if media[3] == 3 else (body[at + 4] << 21 | body[at + 5] << 14 | body[at + 6] << 7 | body[at + 7],)
        if body[at : at + 4] == b"TXXX" and body[at + 10 : at + 11] == b"\0":
            name, _, value = body[at + 11 : at + 10 + n].partition(b"\0")
            texts[name.decode("latin-1")] = value.decode("latin-1")
        at += 10 + n
    return texts, 10 + size + 10 * bool(media[5] & 16)


@lru_cache(maxsize=1)
def _frames() -> list[tuple[bytes, int]]:
    """(header, CRC and side information; room for payload) of the frames that store() writes, by bitrate."""
    out = []
    for index in range(1, 15):
        head = bytes([0xFF, 0xFA, index << 4, 0xC4])
        found = header(head)
        start = head + struct.pack(">H", crc16(head[2:] + bytes(17))) + bytes(17)
        out.append((start, found["length"] - len(start)))
    return out


def store(payload: bytes) -> bytes:
    """payload as a variable-bitrate MPEG-1 Layer III file."""
    frames = _frames()
    full, room = frames[-1]
    body = [full + payload[at : at + room] for at in range(0, len(payload) - room + 1, room)]
    offsets = [i * (len(full) + room) for i in range(len(body))]
    rest = payload[len(body) * room :]
    if rest:
        start, least = next(x for x in frames if x[1] >= len(rest))
        offsets.append(len(body) * (len(full) + room))
        body.append(start + rest + bytes(least - len(rest)))
    start, least = next(x for x in frames if x[1] >= 116)
    lead = len(start) + least
    total = lead + sum(map(len, body))
    toc = bytes(min(255, 256 * (lead + offsets[len(offsets) * i // 100]) // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(body), total) + toc
    return id3({"payload-bytes": str(len(payload))}) + start + table + bytes(least - len(table)) + b"".join(body)


def parse(media: bytes) -> dict:
    """tags, table, frames, samples, hertz, bad_crc, skipped (bytes that are no frame), offsets and bodies of the frames."""
    tags, at = read_id3(media)
    end = len(media) - 128 * (media[-128:-125] == b"TAG" and len(media) >= 128)
    out = {"tags": tags, "table": None, "frames": 0, "samples": 0, "hertz": None, "bad_crc": 0, "skipped": 0, "offsets": [], "bodies": [], "layer": None, "version": None}
    synced, free = False, None

    def at_place(place: int) -> dict | None:
        """The header at a place, with the length of a free bitrate filled in."""
        nonlocal free
        found = header(media[place : place + 4]) if place + 4 <= end else None
        if found is not None and found["length"] is None:
            free = free_length(media, place, end) if free is None else free
            found = None if free is None else found | {"length": free + found["pad"]}
        return found

    while at + 4 <= end:
        found = at_place(at)
        if found is not None and at + found["length"] <= end and not synced:
            # A header counts anew only if another follows its frame, or the end does.
            after = at + found["length"]
            then = at_place(after)
            if after != end and (then is None or (then["version"], then["layer"], then["hertz"]) != (found["version"], found["layer"], found["hertz"])):
                found = None
        if found is None or at + found["length"] > end:
            synced, free = False, None
            to = media.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out["skipped"] += to - at
            at = to
            continue
        synced = True
        frame = media[at : at + found["length"]]
        data = 4 + 2 * found["crc"] + found["side"]
        first = out["hertz"] is None
        if first:
            out |= {k: found[k] for k in ("hertz", "layer", "version")}
        own, bits = covered(frame, found) if found["crc"] else (b"", 0)
        if found["crc"] and struct.unpack_from(">H", frame, 4)[0] != crc16(frame[2:4] + own, 16 + bits):
            out["bad_crc"] += 1
        elif first and frame[data : data + 4] in (b"Xing", b"Info"):
            out["table"] = _table(frame[data:])
            at += found["length"]
            continue
        elif first and frame[36:40] == b"VBRI":
            out["table"] = _vbri(frame[36:])
            at += found["length"]
            continue
        else:
            out["bodies"].append(frame[data:])
        out["offsets"].append(at)
        out["frames"] += 1
        out["samples"] += found["samples"]
        at += found["length"]
    out["skipped"] += max(0, end - at)
    return out


def _table(raw: bytes) -> dict:
    """The variable-bitrate table: frames, bytes and 100 seek points, where its flags say so."""
    (flags,), at, out = struct.unpack_from(">I", raw, 4), 8, {"frames": None, "bytes": None, "toc": None}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            (out[name],) = struct.unpack_from(">I", raw, at)
            at += 4
    if flags & 4:
        out["toc"] = list(raw[at : at + 100])
    return out


def _vbri(raw: bytes) -> dict:
    """The other kind of table: seek points are byte counts of equal runs of frames, summed up here."""
    size, frames, n, scale, width, each = struct.unpack_from(">IIHHHH", raw, 10)
    steps = [int.from_bytes(raw[26 + i * width : 26 + (i + 1) * width], "big") * scale for i in range(n)]
    return {"frames": frames, "bytes": size, "toc": [sum(steps[: i + 1]) for i in range(n)], "frames_each": each}


def seek(parsed: dict, second: float) -> int | None:
    """The offset of the frame that sounds at a time; None beyond the end."""
    at = int(second * parsed["hertz"] * len(parsed["offsets"]) // max(1, parsed["samples"])) if parsed["hertz"] else 0
    return parsed["offsets"][at] if 0 <= at < len(parsed["offsets"]) else None


def media_column(docs: DataFrame, pad: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple, as a media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for at in range(0, batch.num_rows, 256):
                raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts.slice(at, 256).to_pylist()]
                media = [store(x + bytes(max(pad, -(-len(x) // pad) * pad) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "samples long, hertz int, frames long, bad_crc long, skipped long, table_frames long, table_bytes long, offsets array<long>, payload binary"


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media and what FEATURES names) of media (doc_id, n_bytes, media): exact durations are samples / hertz."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [parse(x.as_buffer().to_pybytes()) for x in part.column(2)]
                table = [x["table"] or {} for x in found]
                payload = [b"".join(x["bodies"])[: int(x["tags"].get("payload-bytes", 0))] for x in found]
                columns = [[x[k] for x in found] for k in ("samples", "hertz", "frames", "bad_crc", "skipped")] + [[x.get(k) for x in table] for k in ("frames", "bytes")] + [[x["offsets"] for x in found], payload]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary()]
                names = [x.split()[0] for x in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "media", *names])

    return media.mapInArrow(run, f"doc_id long, n_bytes long, media binary, {FEATURES}")


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores all texts as media in the shared folder, reads them back and gives their digests and features."""
    stored = common.stage(media_column(docs), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, sizes, files = batch.slice(at, 256).columns
                out: list[tuple] = []
                for buffer in files:
                    media = buffer.as_buffer().to_pybytes()
                    x = parse(media)
                    payload = b"".join(x["bodies"])[: int(x["tags"]["payload-bytes"])]
                    seeks = zlib.crc32(struct.pack(f">{len(x['offsets'])}Q", *x["offsets"]))
                    whole = x["table"]["frames"] == x["frames"] and not x["bad_crc"] and not x["skipped"]
                    feature = f"mpeg{x['version']}-layer{x['layer']} samples={x['samples']} hertz={x['hertz']} frames={x['frames']} seek={seeks:08x} {'whole' if whole else 'broken'}"
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, x["samples"], x["hertz"], x["offsets"]))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "hertz", "offsets"]
                yield pa.RecordBatch.from_arrays([ids, sizes, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, hertz int, offsets array<long>")
