"""Removing repeated texts: exact, lexical (shared word trigrams) and by embeddings, the first in order stays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import shingling
from weftwork.functions import text as T
from weftwork.staging import stage, unstage


def exact(df: DataFrame, text: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The first row of each normalised text in a group; blank texts go."""
    key = F.md5(T.normalized(F.col(text)))
    firsts = df.where(F.trim(text) != "").groupBy(*(by or []), key.alias("__key")).agg(F.min(order).alias("__first"))
    return df.join(firsts.select("__first"), F.col(order) == F.col("__first"), "left_semi")


#: Hashes of shingles, and pairs, that are compared in one task, about; and sets whose lists of shingles a batch hands on.
LOT, BATCH = 1_000_000, 1_000


def _sets(batches, emit):
    """emit(ids, hashes of the sets, their sizes, all shingles) of batches of (id, group, text in lower case)."""
    for batch in batches:
        texts, groups = batch.column("t"), batch.column("g").to_pylist()
        for at, to in shingling.runs(texts):
            w, n = shingling.shingle_sets(texts.slice(at, to - at), groups[at:to])
            yield emit(batch.column("id").slice(at, to - at), shingling.set_hashes(w, n, groups[at:to]), n, w.view(np.int64))


def _runs_of(batches, key: str):
    """Batches of rows sorted by key, cut so that no key is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))  # the last key may go on
        if held and (cut or held[0].column(key)[0].as_py() != k[0]):
            first = int(np.searchsorted(k, held[0].column(key)[0].as_py(), side="right"))
            yield pa.Table.from_batches([*held, batch.slice(0, first)]).combine_chunks()
            if cut > first:
                yield pa.Table.from_batches([batch.slice(first, cut - first)])
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _shared(batches):
    """(h, c, w) of the shingles w that c > 1 sets h have, from (w, h) in order; a set that comes again counts once."""
    for part in _runs_of(batches, "w"):
        w, h = part["w"].to_numpy(), part["h"].to_numpy()
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (h[1:] != h[:-1])
        w, h = w[new], h[new]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        c = np.repeat(np.diff(np.append(first, len(w))), np.diff(np.append(first, len(w))))
        many = c > 1
        yield from pa.table({"h": h[many], "c": c[many], "w": w[many]}).to_batches(100_000)


def _listed(batches):
    """(h, s): each set's shared shingles, the rarest first, from (h, c, w) in order."""
    for part in _runs_of(batches, "h"):
        h, w = part["h"].to_numpy(), part["w"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(w, pa.int64()))
        yield from pa.table({"h": h[first], "s": lists}).to_batches(BATCH)


def _compared(least: float):
    """Of a task's pairs (ha, hb) and sets (h, n, s): the pairs' similarities, where they reach `least`. What two sets share is in both lists."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        h = sets["h"].to_numpy()
        order = np.argsort(h)
        lists, n = sets["s"].combine_chunks(), sets["n"].to_numpy()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        held: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in held:
                held[i] = np.sort(flat[ends[i] : ends[i + 1]])
            return held[i]

        pairs = pairs.sort_by("ha")
        ha, hb = pairs["ha"].to_numpy(), pairs["hb"].to_numpy()
        ia, ib = order[np.searchsorted(h, ha, sorter=order)], order[np.searchsorted(h, hb, sorter=order)]
        both = np.zeros(len(ha), np.int64)
        for k, (i, j) in enumerate(zip(ia.tolist(), ib.tolist(), strict=True)):
            a, b = of(i), of(j)
            at = np.searchsorted(a, b)
            both[k] = np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b)
        similarity = both / (n[ia] + n[ib] - both)
        reached = similarity >= least
        return pa.table({"ha": ha[reached], "hb": hb[reached], "similarity": similarity[reached]})

    return run


def lexical_pairs(df: DataFrame, text: str, key: str, *, least: float = 0.8, by: str | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs with a Jaccard of at least `least` over word trigrams, a < b.

    Shingles are ordered by rarity. Sets that reach the threshold share one of the first n - ceil(least n) + 1, the
    smaller one of its first n - ceil(2 least / (1 + least) n) + 1, so only those are joined, and what can still follow the
    shared one must reach the overlap that the threshold asks for. Each set's shingles are shuffled once, as hashes, to be
    counted; those of one set alone end there, as they come first in the order and no two sets share them. Candidates meet
    at a shingle that they share, where each set comes once for all its pairs; a shingle of many sets is cut into chunks
    that meet in pairs. Equal sets are compared once and spread at the end.
    """
    group = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit(""))
    own = df.where(F.trim(text) != "").where(F.col(key).isNotNull()).select(F.col(key).alias("id"), group.alias("g"), F.lower(F.col(text)).alias("t"))
    kind = own.schema["id"].dataType.simpleString()
    ids = stage(own.mapInArrow(lambda x: _sets(x, lambda i, h, n, w: pa.RecordBatch.from_arrays([i, pa.array(h), pa.array(n, pa.int64())], ["id", "h", "n"])), f"id {kind}, h long, n long"), "sets")
    unique = ids.groupBy("h").agg(F.first("n").alias("n"))

    def spread(batches):
        seen: set[int] = set()

        def emit(_, h, n, w):
            new = np.array([x not in seen and not seen.add(x) for x in h.tolist()], bool)
            return pa.RecordBatch.from_arrays([pa.array(w[np.repeat(new, n)]), pa.array(np.repeat(h[new], n[new]))], ["w", "h"])

        yield from _sets(batches, emit)

    counted = own.mapInArrow(spread, "w long, h long").repartition("w").sortWithinPartitions("w", "h").mapInArrow(_shared, "h long, c long, w long")
    lists = counted.repartition("h").sortWithinPartitions("h", "c", "w").mapInArrow(_listed, "h long, s array<long>")
    lists = stage(lists.join(unique.withColumnRenamed("h", "k"), F.col("h") == F.col("k")).select("h", "n", "s"), "lists")

    alone = F.col("n") - F.size("s")  # shingles of this set only come before
    most = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1 - alone).cast("int")
    heads = lists.select("h", "n", alone.alias("alone"), F.posexplode(F.slice("s", 1, most)).alias("p", "w")).select("h", "n", (F.col("p") + F.col("alone")).alias("p"), "w")
    share = least / (1 + least)
    x = heads.where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * F.lit(2 * share) - 1e-9)).select("w", F.col("h").alias("ha"), F.col("n").alias("na"), F.col("p").alias("pa"))
    y = heads.select(F.col("w").alias("v"), F.col("h").alias("hb"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    smaller = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("ha") < F.col("hb"))
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.ceil((F.col("na") + F.col("nb")) * F.lit(share) - 1e-9)
    near = x.join(y, F.col("w") == F.col("v")).where(smaller & (F.col("na") >= F.col("nb") * least - 1e-9) & reach)
    near = stage(near.groupBy("ha", "hb").agg(F.min("w").alias("w")), "candidates")

    meet = near.select("w", F.explode(F.array("ha", "hb")).alias("h")).distinct().join(lists.select(F.col("h").alias("k"), F.size("s").alias("m")), F.col("h") == F.col("k")).select("w", "h", "m")
    sums = meet.groupBy("w").agg(F.sum("m").alias("m")).join(near.groupBy(F.col("w").alias("v")).agg(F.count("*").alias("c")), F.col("w") == F.col("v"))
    sums = stage(sums.select("v", (F.col("m") + F.col("c")).alias("m"), F.greatest(F.ceil(F.col("m") / LOT), F.ceil(F.sqrt(F.col("c") / LOT))).cast("int").alias("k")), "lots")
    lots = max(1, (sums.where("k = 1").agg(F.sum("m")).first()[0] or 0) // LOT)
    chunk = lambda h: F.pmod(F.xxhash64(h), F.col("k")).cast("int")
    task = lambda one, other: F.when(F.col("k") == 1, F.pmod(F.xxhash64("w"), F.lit(lots))).otherwise(F.xxhash64("w", F.least(one, other), F.greatest(one, other)))
    met = near.join(sums, F.col("w") == F.col("v")).select(task(chunk("ha"), chunk("hb")).alias("task"), "ha", "hb")
    members = meet.join(sums.select("v", "k"), F.col("w") == F.col("v")).withColumn("o", F.explode(F.expr("sequence(0, k - 1)")))
    members = members.select("h", task(chunk("h"), F.col("o")).alias("task")).distinct()
    sets = members.join(lists.withColumnRenamed("h", "k"), F.col("h") == F.col("k")).select("task", "h", "n", "s")
    pairs = met.groupBy("task").cogroup(sets.groupBy("task")).applyInArrow(_compared(least), "ha long, hb long, similarity double")

    same = unique.select(F.col("h").alias("ha"), F.col("h").alias("hb"), F.lit(1.0).alias("similarity"))
    ids = ids.select("h", "id")
    out = pairs.unionByName(same).join(ids.withColumnsRenamed({"h": "ha", "id": "a"}), "ha").join(ids.withColumnsRenamed({"h": "hb", "id": "b"}), "hb")
    out = out.where((F.col("ha") != F.col("hb")) | (F.col("a") < F.col("b")))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("similarity", 9).alias("similarity"))


def cosine_pairs(df: DataFrame, vector: str, key: str, by: str, *, least: float, block: int = 512) -> DataFrame:
    """(a, b, similarity) within groups: blocks of vectors meet in pairs, each multiplied as matrices in a task of its own."""
    counts = df.groupBy(F.col(by).alias("__g")).agg(F.count("*").alias("__n")).withColumn("__k", F.ceil(F.col("__n") / block).cast("int"))
    own = df.select(F.col(by).alias("g"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).join(counts, F.col("g").eqNullSafe(F.col("__g")))
    own = own.withColumn("c", F.pmod(F.xxhash64("id"), F.col("__k")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, __k - 1)")))
    own = own.select(F.concat_ws(":", F.col("g").cast("string"), F.least("c", "o"), F.greatest("c", "o")).alias("task"), "c", "id", "v")

    def run(task: pa.Table) -> pa.Table:
        ids, c = task["id"].to_numpy(), task["c"].to_numpy()
        m = np.array(task["v"].to_pylist(), dtype=float)
        norm = np.linalg.norm(m, axis=1)
        m = m / np.where(norm == 0, 1, norm)[:, None]
        alone = len(np.unique(c)) == 1 and task["task"][0].as_py().split(":")[-1] == task["task"][0].as_py().split(":")[-2]
        s = m @ m.T
        a, b = np.nonzero((s >= least) & (ids[:, None] < ids[None, :]))
        keep = np.ones(len(a), bool) if alone else c[a] != c[b]
        a, b = a[keep], b[keep]
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64()), "similarity": pa.array(np.round(s[a, b], 5))})

    return own.groupBy("task").applyInArrow(run, "a long, b long, similarity double")


def greedy(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """df without rows that are near one that stays and comes before: in rounds, rows whose earlier partners are all decided are decided."""
    left, gone = stage(pairs.select("a", "b").where("a <> b").distinct(), "pairs"), []
    while left.limit(1).count():
        later = left.select(F.col("b").alias("n")).distinct()
        stays = stage(left.select(F.col("a").alias("n")).distinct().join(later, "n", "left_anti"), "stays")
        falls = stage(left.join(stays, F.col("a") == F.col("n"), "left_semi").select(F.col("b").alias("__gone")).distinct(), "falls")
        gone.append(falls)
        undecided = left.join(falls, F.col("a") == F.col("__gone"), "left_anti").join(falls, F.col("b") == F.col("__gone"), "left_anti").join(stays, F.col("a") == F.col("n"), "left_anti")
        further = stage(undecided, "pairs")
        unstage(left, stays)
        left = further
    for falls in gone:
        df = df.join(falls, F.col(key) == F.col("__gone"), "left_anti")
    return df


def near(df: DataFrame, text: str, key: str, *, method: str = "lexical", threshold: float = 0.8, vector: str | None = None, by: str | None = None) -> DataFrame:
    """Exact duplicates go first; then, by method lexical, embedding or none, near ones after one that stays."""
    kept = exact(df, text, key, [by] if by else None)
    if method == "none":
        return kept
    if method == "embedding" and vector:
        own = kept if by else kept.withColumn("__all", F.lit(0))
        pairs = cosine_pairs(own, vector, key, by or "__all", least=threshold)
    else:
        pairs = lexical_pairs(kept, text, key, least=min(threshold, 0.8), by=by)
    return greedy(kept, pairs, key)
