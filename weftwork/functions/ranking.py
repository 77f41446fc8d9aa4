"""Positions in a global order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, name: str, value: Column, tie: str, *, by: list[str] | None = None, pieces: int = 128, spread: int = 64) -> DataFrame:
    """df with `name`, the place (from 0) of each row by (value, tie), within the groups of `by`; nulls first.

    Quantiles of the value cut the order into buckets; a frequent value has a bucket of its own, cut by ranges of
    the tie. Counts of buckets give each its offset, so that windows span one bucket only.
    """
    by = by or []
    held = df.withColumn("__v", value.cast("double"))
    points = [i / pieces for i in range(1, pieces)]
    bounds = sorted(set(held.approxQuantile("__v", points, 1 / (4 * pieces)))) if held.columns else []
    low, high = held.agg(F.min(tie), F.max(tie)).first()
    span = max(1, (high or 0) - (low or 0) + 1)
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("__v"))) if bounds else F.lit(0)
    exact = F.array_contains(F.array(*map(F.lit, bounds)), F.col("__v")) if bounds else F.lit(False)
    bucket = F.when(F.col("__v").isNull(), -1).otherwise(at * 2 + exact.cast("int"))
    sub = F.when(F.col("__v").isNull() | exact, F.floor((F.col(tie).cast("double") - F.lit(float(low or 0))) * spread / F.lit(float(span)))).otherwise(0)
    held = held.withColumns({"__b": bucket.cast("int"), "__s": sub.cast("int")})
    # Strictly between bounds a bucket comes before the bound that ends it: 2i is below bound i, 2i + 1 is bound i.
    counts = held.groupBy(*by, "__b", "__s").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b", "__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    offsets = offsets.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*by, "__b", "__s"])], "__o")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*by, "__b", "__s"])]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    inner = Window.partitionBy(*by, "__b", "__s").orderBy(F.col("__v").asc_nulls_first(), tie)
    out = held.join(offsets, condition).withColumn(name, F.col("__o") + F.row_number().over(inner) - 1)
    return out.select(*df.columns, name)
