"""Connected components of an edge table, in the shared folder: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm import common


def _starred(sides: DataFrame, at_least_self: bool) -> DataFrame:
    """sides (u, v): with m, the least neighbour of u, or u itself. Minima are combined before the shuffle; hot nodes are split by the join."""
    least = F.least(F.min("v"), F.col("u")) if at_least_self else F.min("v")
    return sides.join(sides.groupBy("u").agg(least.alias("m")), "u")


def components(edges: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(node, root) for each node of edges (u long, v long) that isn't the least of its component. Null ends are ignored."""
    held = common.stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.stage(large, "edges")
        small = _starred(large, False)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = common.stage(small, "edges")
        common.unstage(held, large)
        held = small
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return held.select(F.col("u").alias("node"), F.col("v").alias("root"))
