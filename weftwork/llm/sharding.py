"""Operator 5: sharding by a two-pass external shuffle.

The first pass scatters the records by seeded hashes into buckets of a size that fits in memory; the second shuffles
each bucket (Fisher-Yates, seeded by the bucket) and writes it. A bucket belongs to one shard. The shard is the jump
consistent hash of the seeded doc_id and the number of shards alone (law "key"), so one more shard takes rows only into
itself; a record's slot is its place among the shuffled buckets of its shard. Within its shard a record's bucket comes
from a hash of its whole row, so that the rows of one doc_id, or those without one, are spread over the shard's buckets;
only rows that are equal in all columns share one.

Defined results: a null text has size 1 and crc32 0; a null doc_id hashes as such; rows that share a doc_id share a
shard, each with its slot; equal texts with different ids are independent; an empty table gives no rows; all columns of
the input are written.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm import common


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Seeded 64-bit hashes of 64-bit keys (the finaliser of SplitMix64)."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash: with one more shard a key stays or moves to the new one."""
    key, out, at = keys.copy(), np.zeros(len(keys), np.int64), np.zeros(len(keys))
    live = np.ones(len(keys), bool)
    while live.any():
        out[live] = at[live].astype(np.int64)
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        at = np.where(live, np.floor((out + 1) * (2.0**31 / ((key >> np.uint64(33)).astype(np.float64) + 1))), at)
        live = at < shards
    return out


def placed(docs: DataFrame, *, shards: int, per_shard: int, seed: int) -> DataFrame:
    """docs with __shard, __grown (with one more shard), __bucket and __hash, that of the whole row; only ids and hashes go to Python."""

    @F.pandas_udf("struct<shard: int, grown: int, bucket: long>")
    def place(ids, hashes):
        import pandas as pd

        null = ids.isna().to_numpy()
        keys = mixed(ids.fillna(0).to_numpy().astype(np.int64).view(np.uint64), seed)
        keys[null] = mixed(np.array([seed], np.uint64), seed + 1)
        shard = jump_hash(keys, shards)
        sub = mixed(hashes.to_numpy().astype(np.int64).view(np.uint64), seed + 2) % np.uint64(per_shard)
        return pd.DataFrame({"shard": shard.astype(np.int32), "grown": jump_hash(keys, shards + 1).astype(np.int32), "bucket": shard * per_shard + sub.astype(np.int64)})

    own = docs.withColumn("__hash", F.xxhash64(F.lit(seed), *docs.columns))
    own = own.withColumn("__place", place(F.col("doc_id").cast("long"), "__hash"))
    return own.withColumns({"__shard": F.col("__place.shard"), "__grown": F.col("__place.grown"), "__bucket": F.col("__place.bucket")}).drop("__place")


def fisher_yates(n: int, seed: str) -> list[int]:
    """A permutation of n; any order is as likely as any other."""
    draw, order = random.Random(seed), list(range(n))
    for i in range(n - 1, 0, -1):
        j = draw.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def shard(docs: DataFrame, *, shards: int = 16, bucket_bytes: int = 16 << 20, seed: int = 11) -> DataFrame:
    """Shards docs (doc_id, text, ...) and writes them to the shared folder; what it reads back has all columns, __shard, __grown and __slot."""
    size = common.text_bytes(docs)
    per_shard = max(1, -(-size // (shards * bucket_bytes)))
    scattered = placed(docs, shards=shards, per_shard=per_shard, seed=seed)
    schema = scattered.withColumn("__pos", F.lit(0).cast("long")).schema
    columns = schema.names[:-1]

    def run(key: tuple, records: pa.Table) -> pa.Table:
        stable = records.append_column("__row", pa.array(range(len(records)))).sort_by([("doc_id", "ascending"), ("__hash", "ascending"), ("__row", "ascending")])
        order = fisher_yates(len(stable), f"{seed}:{key[0].as_py()}")
        return stable.select(columns).take(pa.array(order, pa.int64())).append_column("__pos", pa.array(range(len(stable)), pa.int64()))

    parts = common.parts_for(docs.sparkSession, shards * per_shard, 1)
    written = common.stage(scattered.repartition(parts, "__bucket").groupBy("__bucket").applyInArrow(run, schema), "shards")
    counts = written.groupBy("__shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = written.join(offsets, written["__bucket"] == offsets["__b"])
    return out.select(*docs.columns, "__shard", "__grown", (F.col("__before") + F.col("__pos")).alias("__slot"))

