"""64-bit hashes of the words of many texts at once, without a Python object per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ODD = 0xD1342543DE82EF95
SPACES = (9, 10, 11, 12, 13, 32)
#: Bytes as they count: ASCII letters in lower case, white space as spaces.
PLAIN = bytes(32 if b in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with line ends apart.
LINES = bytes(10 if b == 10 else c for b, c in enumerate(PLAIN))
#: The same as PLAIN, with ASCII signs as spaces.
LETTERS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in PLAIN)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, m, np.uint64)])) for m in (ODD, pow(ODD, -1, 2**64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[str | None], table: bytes = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words in a row, number of words of each text, first byte of each word in the joined texts); words are what the table leaves between spaces."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    joined = b"\n".join(raw).translate(table) + b" "
    codes = np.frombuffer(joined, np.uint8)
    space = (codes == 32) | (codes == 10)
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    powers, inverse = _powers(max(20, len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    return hashes, np.diff(bounds), start


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each `size` words in a row."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(ODD) + hashes[i : i + n]
    return mix(out)


def chunks(texts: list[str | None], chars: int = 1_000_000):
    """(from, to) of runs of texts of about so many characters; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= chars):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


class Counts:
    """Sums by 64-bit key of what one task has seen."""

    def __init__(self, columns: int, most: int = 2_000_000):
        self.keys, self.sums, self.columns, self.most = np.zeros(0, np.uint64), np.zeros((0, columns), np.int64), columns, most
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.waiting.append((keys, sums.reshape(len(keys), self.columns)))
        self.size += len(keys)
        if self.size > self.most:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        sums = np.concatenate([self.sums, *(s for _, s in self.waiting)])
        self.waiting, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.sums = keys[at], np.add.reduceat(sums, at, axis=0) if len(at) else sums


def unique_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)
