"""Operators that write and read files: 1 (token ids), 8 (MPEG audio), 9 (WARC)."""

from __future__ import annotations

import hashlib
import io
import os
import struct
import zlib

import numpy as np
import pytest

from tests.llm.common import docs, rows
from weftwork.llm import mpeg_audio, queries, token_store, warc

TOKENIZER = queries.tokenizer_path()


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_vbyte_round_trip(n):
    values = np.random.default_rng(n).integers(0, 2 ** np.random.default_rng(n + 1).integers(1, 33, n, dtype=np.int64), dtype=np.int64).astype("<u4")
    assert token_store.vbyte_decode(*token_store.vbyte_encode(values), n).tolist() == values.tolist()


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    expected, at = [], 0
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, (_, t, *_) in enumerate(rows())}
    raw = {i: struct.pack(f"<{len(x)}I", *x) for i, x in ids.items()}
    keys = [d for d, *_ in rows()]
    for i in sorted(ids, key=lambda i: (keys[i] is not None, keys[i] or 0)):
        expected.append((keys[i], at, len(ids[i]), zlib.crc32(raw[i])))
        at += len(ids[i])
    got = [tuple(r) for r in token_store.token_digests(docs(spark), TOKENIZER).collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert token_store.token_digests(docs(spark, []), TOKENIZER).count() == 0


def test_op1_is_the_default_encode(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    data = [(1, "a<|endoftext|>b", "en", "a"), (2, "x\ua7cb1\U00010d40 \ua7cb!", "en", "a"), *((d, t, "en", "a") for d, t, *_ in rows() if d and d > 7)]
    docs(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    expected = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in data}
    assert 50256 in expected[1]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op1_token_files(spark, str(tmp_path)).collect()}
    assert got == {d: (len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for d, x in expected.items()}


def test_word_classes_are_the_library_s():
    encoder = token_store.WordEncoder(TOKENIZER)
    assert [encoder._kind(c) for c in "\ua7cb\U00010d40\x1c\x85"] == [1, 2, 0, 3]
    texts = [f"a{c}1{c} {c}" for c in map(chr, [*range(0x20, 0xD800, 7), *range(0xE000, 0x20000, 7), 0xA7CB, 0x10D40, 0x1C, 0x85])]
    ids, counts = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_media_of_texts(spark):
    got = mpeg_audio.media_digests(docs(spark)).collect()
    texts = sorted((d is not None, d or 0, (t or "").encode()) for d, t, *_ in rows())
    assert len(got) == len(texts)
    for row, (_, doc, raw) in zip(sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), texts, strict=True):
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (row["doc_id"] or 0, row["n_bytes"], row["payload_bytes"]) == (doc, len(raw), len(payload))
        assert (row["payload_sha256"], row["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = mpeg_audio.store(payload)
        assert (row["media_bytes"], row["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest()) and row["feature"].endswith("whole")
        parsed = mpeg_audio.parse(media)
        assert (row["samples"], row["hertz"], row["offsets"]) == (parsed["samples"], 44100, parsed["offsets"])
    assert mpeg_audio.media_digests(docs(spark, [])).count() == 0


def test_parser_finds_frames_again_and_counts_bad_checksums():
    payload = bytes(range(256)) * 40
    media = mpeg_audio.store(payload)
    whole = mpeg_audio.parse(media)
    assert b"".join(whole["bodies"])[: len(payload)] == payload and whole["table"]["frames"] == whole["frames"]
    assert whole["samples"] == whole["frames"] * 1152 and mpeg_audio.seek(whole, 0.0) == whole["offsets"][0] and mpeg_audio.seek(whole, 1e6) is None
    assert media[whole["offsets"][3]] == 0xFF
    at = whole["offsets"][2]
    torn = mpeg_audio.parse(media[:at] + b"\xff\xfa junk \xff" + media[at:] + b"TAG" + bytes(125))
    assert torn["frames"] == whole["frames"] and torn["skipped"] == 9 and torn["bodies"] == whole["bodies"]
    broken = bytearray(media)
    broken[at + 8] ^= 1
    broken = mpeg_audio.parse(bytes(broken))
    assert broken["bad_crc"] == 1 and broken["frames"] == whole["frames"]
    nothing = mpeg_audio.parse(b"no audio \xff\xfb here")
    assert nothing["frames"] == 0 and nothing["hertz"] is None


def _crc_of_bits(bits: str) -> int:
    crc = 0xFFFF
    for bit in bits:
        top = crc >> 15 ^ int(bit)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def _bits(data: bytes) -> str:
    return "".join(f"{b:08b}" for b in data)


def _frame(head: bytes, checked: str, length: int) -> bytes:
    body = checked + "01" * (4 * length)
    crc = _crc_of_bits(_bits(head[2:4]) + checked)
    return (head + struct.pack(">H", crc) + int(body[: 8 * (length - 6)], 2).to_bytes(length - 6, "big"))[:length]


@pytest.mark.parametrize(
    ("head", "checked", "length"),
    [
        (b"\xff\xfe\x40\xc0", "0101" * 32, 136),  # Layer I, 128 kbit/s, one channel
        (b"\xff\xfe\x40\x50", "0011" * 2 * 8 + "1001" * 24, 136),  # joint stereo from subband 8
        (b"\xff\xfc\x84\x00", ("0001" * 22 + "010" * 24 + "01" * 8) + "10" * 54, 384),  # Layer II, 128 kbit/s at 48 kHz, two channels: 27 subbands, all selected
        (b"\xff\xfc\x14\xc0", "0000" * 2 + "001" * 6 + "11" * 6, 96),  # 32 kbit/s: 8 subbands, two of them empty
        (b"\xff\xf4\x84\xc0", "1111" * 4 + "000" * 7 + "00" * 19 + "01" * 4, 384),  # version 2
    ],
)
def test_checksums_of_other_layers(head, checked, length):
    frame = _frame(head, checked, length)
    assert mpeg_audio.header(head)["length"] == length
    good = mpeg_audio.parse(frame * 3)
    assert (good["frames"], good["bad_crc"], good["skipped"]) == (3, 0, 0)
    torn = bytearray(frame * 3)
    torn[length + 6] ^= 4
    assert mpeg_audio.parse(bytes(torn))["bad_crc"] == 1
    torn = bytearray(frame * 3)
    torn[2 * length - 1] ^= 4  # beyond what the checksum covers
    assert mpeg_audio.parse(bytes(torn))["bad_crc"] == 0


def test_free_bitrate_and_the_other_table():
    head = b"\xff\xfb\x00\xc4"
    frames = [head + bytes(17) + bytes([i]) * 500 for i in (1, 2, 3)]
    padded = b"\xff\xfb\x02\xc4" + bytes(17) + b"\x09" * 501
    found = mpeg_audio.parse(b"".join([*frames, padded, frames[0]]))
    assert found["frames"] == 5 and not found["skipped"] and found["offsets"] == [0, 521, 1042, 1563, 2085] and found["samples"] == 5 * 1152
    payload = bytes(range(250)) * 20
    plain = mpeg_audio.store(payload)
    start = mpeg_audio.parse(plain)["offsets"][0]
    first, room = mpeg_audio._frames()[4]
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 9999, 5, 2, 1, 2, 3) + struct.pack(">HH", 1000, 500)
    lead = (first + bytes(36 - len(first)) + table).ljust(len(first) + room, b"\0")
    found = mpeg_audio.parse(lead + plain[start:])
    assert found["table"] == {"frames": 5, "bytes": 9999, "toc": [1000, 1500], "frames_each": 3} and b"".join(found["bodies"])[: len(payload)] == payload


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, digest string, first long, n int").repartition(2)


def test_archives(spark, tmp_path):
    big = "<p>" + "same page " * 30
    data = [(5, "http://a/ b", big), (3, None, big), (9, "http://c/", big), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", "é" * 5000), (8, "u", "other " * 100), (8, "u", "other " * 100)]
    out = f"file://{tmp_path}/warc"
    got = warc.read_archives(spark, out, warc.write_archives(pages(spark, [(*x, "d", 1, 2) for x in data]), out)).collect()
    expected = []
    for page, _, html in data:
        raw = (html or "").encode()
        same = [p for p, _, h in data if (h or "") == (html or "") and p is not None]
        to = min(same) if len(raw) >= 100 and min(same) != page else None
        expected.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to is not None else "response", to))
    key = lambda x: tuple((v is not None, v or 0) for v in x[:2])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    small = warc.write_archives(pages(spark, [(*x, "d", 1, 2) for x in data]), f"file://{tmp_path}/small", archive_bytes=900)
    assert len(small) > 4 and sum(r["records"] for r in small) == len(data)
    assert sorted(map(tuple, warc.read_archives(spark, f"file://{tmp_path}/small", small).collect()), key=key) == sorted(expected, key=key)
    assert not os.path.exists(tmp_path / "none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none", warc.write_archives(pages(spark, []), f"file://{tmp_path}/none")).count() == 0


def test_archive_reader_checks_what_it_reads():
    raws = [warc.record(i, "http://x/", b"payload %d " % i * 50, hashlib.sha256(b"payload %d " % i * 50).hexdigest(), None) for i in range(40)]
    stream = io.BytesIO()
    assert warc.write_archive(stream, iter(raws)) == 40
    archive = stream.getvalue()
    assert struct.unpack_from("<I", archive)[0] == warc.SKIPPABLE  # the dictionary leads
    read = list(warc.read_archive(io.BytesIO(archive), chunk=100))
    assert read[1:] == raws and warc.parse(read[0])["type"] == "warcinfo"
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(io.BytesIO(archive[:-3])))
    with pytest.raises(warc.BadArchive):
        warc.parse(raws[0].replace(b"payload 0 payload", b"payload 1 payload"))
    with pytest.raises(warc.BadArchive):
        warc.parse(raws[0].replace(b"WARC-Date", b"WARC-Time"))
    with pytest.raises(warc.BadArchive):
        warc.parse(raws[0] + b"x")
