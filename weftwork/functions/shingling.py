"""Shingles of many texts at once as 64-bit hashes, without an expression evaluated for each."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at once; a longer text is taken whole.
RUN = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


def runs(texts: pa.Array, most: int = RUN):
    """(from, to) of rows whose texts have about so many bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, to
        at = to


def shingle_sets(texts: pa.Array, groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of hashes of each text): the sorted set of three words in a row of each text, told apart by its group; fewer words: of all; none: empty.

    Words are what ASCII white space parts; texts come in lower case.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, many = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    said = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    of = np.repeat(np.arange(len(texts)), many)[said]
    coded = flat.dictionary_encode()
    known = np.array([digest(w.encode("utf-8", "surrogatepass")) for w in coded.dictionary.to_pylist()], np.uint64)
    v = mix(known[coded.indices.to_numpy(zero_copy_only=False)[said]]) if len(known) else np.zeros(0, np.uint64)
    own = {g: np.uint64(digest(g.encode("utf-8", "surrogatepass"))) for g in set(groups)}
    salt = np.array([own[g] for g in groups], np.uint64)
    words = np.bincount(of, minlength=len(texts))
    start = np.concatenate([[0], np.cumsum(words)])
    whole = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
    parts = [(of[whole], mix(mix(v[whole] + np.uint64(3)) + v[whole + 1]) + v[whole + 2])]
    one, two = np.flatnonzero(words == 1), np.flatnonzero(words == 2)
    parts.append((one, v[start[one]] + np.uint64(1)))
    parts.append((two, mix(v[start[two]] + np.uint64(2)) + v[start[two] + 1]))
    of = np.concatenate([p[0] for p in parts])
    w = np.concatenate([p[1] for p in parts])
    w = mix(mix(w) + salt[of])
    order = np.lexsort((w, of))
    of, w = of[order], w[order]
    first = np.ones(len(w), bool)
    first[1:] = (w[1:] != w[:-1]) | (of[1:] != of[:-1])
    return w[first], np.bincount(of[first], minlength=len(texts))


def set_hashes(w: np.ndarray, n: np.ndarray, groups: list[str]) -> np.ndarray:
    """A hash of each set and its group, signed as Spark's longs."""
    ends = np.cumsum(n)
    found = [digest(w[e - k : e].tobytes() + g.encode("utf-8", "surrogatepass")) for e, k, g in zip(ends, n, groups, strict=True)]
    return np.array(found, np.uint64).view(np.int64)
