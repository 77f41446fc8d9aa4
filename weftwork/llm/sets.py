"""Sets of hashes, packed for tables, and exact Jaccard links within classes of sets.

A class is a group of sets in which all links of its members lie; what led to it doesn't matter here. A class of more
than its bound is dealt in pairs of chunks, so that no task holds more than two chunks of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = 5  # bytes of a member's hash in a stored set


def packed(words: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> pa.Array:
    """The sets whose rows are `at` as binary values, null for the other rows; words: 64-bit hashes."""
    many = size[at]
    of = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    data = words[of].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()
    present = np.zeros(len(size), bool)
    present[at] = True
    ends = np.concatenate([[0], np.cumsum(np.where(present, size, 0) * WIDE)]).astype(np.int32)
    valid = pa.py_buffer(np.packbits(present, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(size), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def unpacked(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of all sets in a row, their sizes) of binary values without nulls."""
    ends = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64)
    data = np.frombuffer(sets.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(sets) and sets.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.zeros((len(data) // WIDE, 8), np.uint8)
    out[:, :WIDE] = data.reshape(-1, WIDE)
    return out.reshape(-1).view("<u8"), np.diff(ends) // WIDE


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the least row that each row's links lead to) with the links a, b added."""
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]


def _large(flat: np.ndarray, size: np.ndarray, first: np.ndarray, rows: np.ndarray, t: float, apart: np.ndarray | None, width: int = 2048):
    """Pairs (x, y), x < y, of one class whose Jaccard similarity reaches t, in blocks; apart: only pairs of different values of it."""
    many = size[rows]
    of = np.repeat(np.arange(len(rows)), many)
    words = flat[np.repeat(first[rows] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    for low in range(0, len(rows), 512):
        high = min(len(rows), low + 512)
        mine = (of >= low) & (of < high)
        known = np.unique(words[mine])
        column = np.minimum(np.searchsorted(known, words), len(known) - 1)
        inside = known[column] == words
        column, owner = column[inside], of[inside]
        both = np.zeros((high - low, len(rows) - low), np.float32)
        for at in range(0, len(known), width):
            here = (column >= at) & (column < at + width) & (owner >= low)
            grid = np.zeros((len(rows) - low, min(width, len(known) - at)), np.float32)
            grid[owner[here] - low, column[here] - at] = 1
            both += grid[: high - low] @ grid.T
        total = many[low:high, None] + many[None, low:]
        x, y = np.nonzero(both.astype(float) * (1 + t) >= t * total - 1e-6)
        keep = x < y
        x, y = x[keep] + low, y[keep] + low
        if apart is not None:
            keep = apart[rows[x]] != apart[rows[y]]
            x, y = x[keep], y[keep]
        yield rows[x], rows[y]


def _small(flat: np.ndarray, size: np.ndarray, first: np.ndarray, x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Which of the pairs x, y reach t, by their whole sets."""
    keep = np.zeros(len(x), bool)
    for at in range(0, len(x), 20_000):
        i, j = x[at : at + 20_000], y[at : at + 20_000]
        many = size[i] + size[j]
        owner = np.repeat(np.arange(len(i)), many)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        left = within < size[i][owner]
        of = np.where(left, first[i][owner] + within, first[j][owner] + within - size[i][owner])
        tagged = np.sort(owner.astype(np.uint64) << np.uint64(8 * WIDE) | flat[of])
        shared = np.bincount((tagged[1:][tagged[1:] == tagged[:-1]] >> np.uint64(8 * WIDE)).astype(np.int64), minlength=len(i))
        keep[at : at + 20_000] = shared * (1 + t) >= t * many - 1e-6
    return keep


def dealt(members: DataFrame, chunk_by: list[str | Column], bound: int) -> DataFrame:
    """members (root, ...) with low, high and chunk: a row for each task that needs it."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > bound).select(F.col("root").alias("__r"), F.ceil(F.col("n") / bound).cast("int").alias("__k"))
    if sizes.count() <= 1_000_000:  # 12 MB
        sizes = F.broadcast(sizes)
    chunk = F.pmod(F.xxhash64(*chunk_by), F.coalesce("__k", F.lit(1))).cast("int")
    out = members.join(sizes, F.col("root") == F.col("__r"), "left").withColumn("chunk", chunk).withColumn("__other", F.explode(F.expr("sequence(0, coalesce(__k, 1) - 1)")))
    return out.withColumns({"low": F.least("chunk", "__other"), "high": F.greatest("chunk", "__other")}).drop("__r", "__k", "__other")


def links(root: np.ndarray, low: np.ndarray, high: np.ndarray, chunk: np.ndarray, sets: pa.Array, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) of one class whose sets have a similarity of t, in blocks; each pair once over all tasks: those of one chunk where it meets itself."""
    flat, size = unpacked(sets)
    first = np.cumsum(size) - size
    order = np.lexsort((high, low, root))
    apart = (root[order][1:] != root[order][:-1]) | (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    new = np.flatnonzero(np.concatenate([[True], apart]))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
        rows = order[a:b]
        two = low[rows[0]] != high[rows[0]]
        if len(rows) > 24:
            yield from _large(flat, size, first, rows, t, chunk if two else None)
        elif len(rows) > 1:
            x, y = np.triu_indices(len(rows), 1)
            x, y = rows[x], rows[y]
            near = np.minimum(size[x], size[y]) >= t * np.maximum(size[x], size[y]) - 1e-9
            keep = near & (chunk[x] != chunk[y]) if two else near
            waiting.append((x[keep], y[keep]))
    if waiting:
        x, y = (np.concatenate(c) for c in zip(*waiting, strict=True))
        ok = _small(flat, size, first, x, y, t)
        yield x[ok], y[ok]
