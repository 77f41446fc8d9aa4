"""Operator 6: mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source has a target of words. Its documents stand in a seeded order, epoch after epoch, so that each copy of a
document takes an interval of the source's cumulative words; copies whose middle is below the target are taken. Each
source also has a weight schedule over training time 0 to 1, piecewise linear between knots. Its integral, scaled to
the target, is the source's cumulative demand; inverting it at a copy's middle gives the copy's position in training,
and the mix is range-sorted by position.

Cumulative words are summed in two levels, within buckets of a source's order and over its buckets, so that a source
with a third of all rows is no task of its own.

Defined results: a null text has size 0; sizes of 0 take nothing; null sources are one source, the last; a source
without words has target 0; equal rows may stand in either order, with equal totals; an empty table gives no rows;
the columns of the input stay, and those added carry names that start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Weight schedules over training time, by the source's place like WEIGHTS: (time, weight) knots. They shape when a source is read, not how much of it.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0)), ((0.0, 2.0), (0.4, 1.0), (1.0, 0.5)))


def size_of(text: Column | str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_plan(docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, place) of docs (source, __size); a row for each source, whose windows see these rows only.

    Targets are share times all words by weight; those above `most` times their source stop there, and the excess goes
    to the others by weight, until none is above. In order of stop / weight the sources that stop come first, so one
    pass of running sums finds the level of the others.
    """
    sums = docs.groupBy("source").agg(F.sum("__size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    sums = sums.withColumn("place", place).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("place") + 1))
    sums = sums.withColumn("stop", F.lit(most) * F.col("source_size"))
    by_stop = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.lit(share) * F.sum("source_size").over(everything)
    level = (wanted - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    sums = sums.withColumn("level", level)
    found = F.min(F.when(F.col("level") * F.col("w") < F.col("stop"), F.struct(F.col("stop") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(found.isNull(), F.col("stop")).otherwise(F.least("stop", found * F.col("w")))
    return sums.select("source", "source_size", target.alias("target"), "place")


def _schedule_arrays(schedule: tuple) -> tuple[list[float], list[float], list[float]]:
    """(times, weights scaled to an integral of 1, integral up to each knot)."""
    times, weights = [float(t) for t, _ in schedule], [float(w) for _, w in schedule]
    areas = [(b - a) * (v + w) / 2 for a, b, v, w in zip(times, times[1:], weights, weights[1:], strict=False)]
    total, sums = sum(areas), [0.0]
    for area in areas:
        sums.append(sums[-1] + area / total)
    return times, [w / total for w in weights], sums


def demand_inverse(q: Column, place: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time by which the share q of a source's demand is due: the inverse of its schedule's integral."""
    out = None
    for i, schedule in reversed(list(enumerate(schedules))):
        times, weights, sums = _schedule_arrays(schedule)
        due = F.lit(times[-1])
        for t, u, v, w, start, end in reversed(list(zip(times, times[1:], weights, weights[1:], sums, sums[1:], strict=False))):
            r = q - F.lit(start)
            within = F.lit(t) + F.lit(2.0) * r / (F.lit(v) + F.sqrt(F.greatest(F.lit(0.0), F.lit(v * v) + F.lit(2.0 * (w - v) / (u - t)) * r)))
            due = F.when(q < F.lit(end), within).otherwise(due)
        out = due if out is None else F.when(place == i, due).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def assign(docs: DataFrame, *, id_col: str = "doc_id", seed: int = 7, size: Column | None = None, epochs: int = 2, digits: int | None = None) -> DataFrame:
    """docs with __size, __source_size, __target, __order and __positions: the training positions of the copies taken, at most `epochs`."""
    own = docs.withColumn("__size", size_of("text") if size is None else size)
    own = own.withColumn("__order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))
    if digits is None:
        digits = 2
        rows = docs.count()
        while rows >> (4 * digits) > 50_000:
            digits += 1
    bucket = F.substring("__order", 1, digits)
    plan = source_plan(own.select("source", "__size"))
    sums = own.groupBy("source", bucket.alias("__bucket")).agg(F.sum("__size").alias("n"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    sums = sums.join(plan.withColumnRenamed("source", "__s"), sums["source"].eqNullSafe(F.col("__s")))
    sums = sums.select("__s", F.col("__bucket").alias("__b"), "__before", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("place").alias("__place"))
    own = own.withColumn("__bucket", bucket)
    inner = Window.partitionBy("source", "__bucket").orderBy("__order", id_col, "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("__upto", F.sum("__size").over(inner))
    own = own.join(sums, own["source"].eqNullSafe(sums["__s"]) & (own["__bucket"] == sums["__b"])).drop("__s", "__b")
    start = F.col("__before") + F.col("__upto") - F.col("__size")
    middle = [start + F.lit(e) * F.col("__source_size") + F.col("__size") / F.lit(2.0) for e in range(epochs)]
    taken = F.array(*[F.when((F.col("__size") > 0) & (m < F.col("__target")), demand_inverse(m / F.col("__target"), F.col("__place"))) for m in middle])
    own = own.withColumn("__positions", F.filter(taken, lambda x: x.isNotNull()))
    return own.drop("__bucket", "__before", "__upto", "__place")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix: a row for each copy taken, with the columns of docs and __position, in ranges of position."""
    columns = docs.columns
    taken = assign(docs, **options).select(*columns, "__order", F.explode("__positions").alias("__position"))
    return taken.repartitionByRange("__position", "__order").sortWithinPartitions("__position", "__order").select(*columns, "__position")
