"""Validation of tables against their schema: one wide aggregate for each table, a join or two for each relation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import pools
from weftwork.plans.generate import Dataset
from weftwork.plans.schema import Field, Schema, Table, bounds, is_key, window
from weftwork.staging import stage, unstage

NOTICE = "Synthetic data: checks hold the tables against their schema, not against the world."


@dataclass
class Check:
    name: str
    table: str
    field: str | None
    passed: bool
    detail: str = ""
    bad: int = 0


@dataclass
class Report:
    checks: list[Check] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(c.passed for c in self.checks)

    def failures(self) -> list[Check]:
        return [c for c in self.checks if not c.passed]

    def add(self, *check, **more) -> None:
        self.checks.append(Check(*check, **more))

    def render(self) -> str:
        lines = [f"{'ok  ' if c.passed else 'FAIL'} {c.table}{'.' + c.field if c.field else ''} {c.name}: {c.detail}" for c in self.checks]
        return "\n".join([*lines, f"{sum(c.passed for c in self.checks)} of {len(self.checks)} checks passed", NOTICE])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.name, c.table, c.field, c.passed, c.detail, c.bad) for c in self.checks], "name string, table string, field string, passed boolean, detail string, n_bad long")


def same(a: Column, b: Column) -> Column:
    """Null-safe equality; numbers within a relative 1e-9."""
    return a.eqNullSafe(b)


def close(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)), F.lit(False))


def in_range(f: Field, c: Column, params: Field | None = None) -> Column:
    low, high = bounds(params or f)
    return (c >= F.lit(float(low))) & (c <= F.lit(float(high)))


def type_ok(schema: Schema, t: Table, f: Field, c: Column, raw: Column | None) -> Column:
    """Whether a value that isn't null is what the field declares; raw: its text in a file, where the typed value may be null."""
    readable = F.lit(True) if raw is None else raw.isNull() | c.isNotNull()
    if f.type in ("int", "float"):
        return readable & (F.lit(True) if f.get("when") else in_range(f, c))
    if f.type == "email":
        return c.rlike(pools.RESERVED)
    if f.type == "phone":
        return c.rlike(pools.PHONE)
    if f.type == "ipv4":
        return c.rlike(pools.IPV4)
    if f.type == "uuid" or f.type == "id" and f.get("strategy") == "uuid":
        return c.rlike(pools.UUID)
    if f.type in ("date", "datetime"):
        if f.anchors and f.params.get("start") is None and f.params.get("end") is None:
            return readable
        low, high = window(f)
        cast = "date" if f.type == "date" else "timestamp_ntz"
        ok = readable
        if f.params.get("start") is not None or not f.anchors:
            ok = ok & (c >= F.lit(low).cast(cast))
        if f.params.get("end") is not None or not f.anchors:
            ok = ok & (c <= F.lit(high).cast(cast))
        return ok
    if f.type in ("foreign_key", "formula", "lookup"):
        return F.lit(True)
    return readable


def case_column(f: Field, df: DataFrame) -> Column:
    key = f.get("when")["field"]
    text = F.col(key).cast("string")
    out = F.lit(None).cast("string")
    for c in f.get("when")["cases"]:
        out = F.when(text == (c.lower() if dict(df.dtypes)[key] == "boolean" else c), c).otherwise(out)
    return out


def validate(data: Dataset, *, tolerance: float = 0.05) -> Report:
    """All checks, in the order of tables and fields."""
    report = Report()
    for t in data.schema.tables:
        _table_checks(report, data, t, tolerance)
    return report


def _raw(df: DataFrame, name: str) -> Column | None:
    return F.col(f"__raw_{name}") if f"__raw_{name}" in df.columns else None


def _table_checks(report: Report, data: Dataset, t: Table, tolerance: float) -> None:
    df, schema = data[t.name], data.schema
    exprs: dict[str, Column] = {"rows": F.count("*")}
    for f in t.fields:
        c, raw = F.col(f.name), _raw(df, f.name)
        present = c.isNotNull() if raw is None else raw.isNotNull()
        bad = present & ~F.coalesce(type_ok(schema, t, f, c, raw), F.lit(False))
        exprs[f"{f.name}/bad"] = F.count(F.when(bad, 1))
        exprs[f"{f.name}/example"] = F.first(F.when(bad, (c if raw is None else raw).cast("string")), ignorenulls=True)
        exprs[f"{f.name}/nulls"] = F.count(F.when(~present, 1))
        if f.unique or f.type == "id":
            exprs[f"{f.name}/twice"] = F.count(c) - F.count_distinct(c)
        if f.get("when") and f.type != "bool":
            exprs[f"{f.name}/outside"] = F.count(F.when(c.isNotNull() & ~F.coalesce(_case_ok(f, df), F.lit(False)), 1))
    got = df.agg(*(e.alias(k) for k, e in exprs.items())).first().asDict()
    n = got["rows"]
    report.add("row_count", t.name, None, n == t.rows, f"{n} rows, {t.rows} declared", bad=abs(n - t.rows))
    for f in t.fields:
        at = lambda k, f=f: got[f"{f.name}/{k}"]
        report.add("type", t.name, f.name, at("bad") == 0, f"{at('bad')} values aren't {f.type}" + (f", such as {at('example')!r}" if at("bad") else ""), bad=at("bad"))
        if f.unique or f.type == "id":
            report.add("uniqueness", t.name, f.name, at("twice") == 0, f"{at('twice')} values repeat", bad=at("twice"))
        own = bool(f.references) and f.references[0] == t.name
        if f.type == "id" or f.type == "foreign_key":
            nulls = at("nulls")
            ok = nulls >= 1 or n == 0 if own else nulls == 0 or f.type == "foreign_key" and f.null_rate > 0
            report.add("not_null", t.name, f.name, ok, f"{nulls} nulls" + (" (roots)" if own else ""), bad=0 if ok else max(1, nulls))
        if f.type == "category":
            _distribution(report, df, t, f, tolerance)
        if f.references:
            _relation(report, data, t, f)
        if f.type == "lookup":
            _lookup(report, data, t, f)
        if f.get("when"):
            outside = 0 if f.type == "bool" else at("outside")
            report.add("when_bounds", t.name, f.name, outside == 0, f"{outside} values are outside their case", bad=outside)
        for option in f.anchors:
            _order(report, data, t, f, option)


def _case_ok(f: Field, df: DataFrame) -> Column:
    case, c = case_column(f, df), F.col(f.name)
    ok = F.lit(True)
    for label in [None, *f.get("when")["cases"]]:
        own = f.merged(label)
        fits = c.isin(*own.get("categories")) if f.type == "category" else in_range(f, c, own)
        ok = F.when(case.eqNullSafe(F.lit(label).cast("string")), fits).otherwise(ok)
    return ok


def deviation(counts: dict, weights: dict) -> tuple[float, object, list]:
    """(largest difference of shares, its label, labels that aren't declared)."""
    n, total = sum(counts.values()), sum(weights.values())
    gaps = {k: abs(counts.get(k, 0) / n - w / total) for k, w in weights.items()} if n else {}
    worst = max(gaps, key=gaps.get, default=None)
    return gaps.get(worst, 0.0), worst, sorted((k for k in counts if k not in weights), key=str)


def label_counts(df: DataFrame, name: str, labels: list) -> tuple[dict, int, object]:
    """(counts of the labels, rows of any other, the least of those): what reaches the driver is bounded by what is declared."""
    c = F.col(name)
    declared = c.isin(*labels) if labels else F.lit(False)
    rows = df.where(c.isNotNull()).groupBy(F.when(declared, c).alias("label")).agg(F.count("*").alias("n"), F.min(F.when(~declared, c)).alias("example")).collect()
    counts = {r["label"]: r["n"] for r in rows if r["label"] is not None}
    other = next((r for r in rows if r["label"] is None), None)
    return counts, other["n"] if other else 0, other["example"] if other else None


def _distribution(report: Report, df: DataFrame, t: Table, f: Field, tolerance: float) -> None:
    if not f.get("when"):
        counts, others, example = label_counts(df, f.name, list(f.get("categories")))
        gap, worst, _ = deviation(counts | ({None: others} if others else {}), f.get("categories"))
        n, odd = sum(counts.values()) + others, [example] if others else []
        ok = n == 0 or not odd and (f.unique or gap <= max(tolerance, 1 / n) + 1e-12)
        report.add("distribution", t.name, f.name, ok, f"labels that aren't declared: {odd[:5]}" if odd else f"largest difference {gap:.4f} ({worst})", bad=others or int(not ok))
        return
    rows = df.where(F.col(f.name).isNotNull()).groupBy(case_column(f, df).alias("case"), F.col(f.name).alias("label")).agg(F.count("*").alias("n")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["case"], {})[r["label"]] = r["n"]
    worst_gap, where = 0.0, None
    ok = True
    for case, counts in by.items():
        n = sum(counts.values())
        if n < math.ceil(1 / tolerance):
            continue
        gap, label, _ = deviation(counts, f.merged(case).get("categories"))
        ok = ok and gap <= max(tolerance, 1 / n) + 1e-12
        if gap >= worst_gap:
            worst_gap, where = gap, f"{case}: {label}"
    report.add("distribution", t.name, f.name, ok, f"largest difference in a case {worst_gap:.4f} ({where})", bad=int(not ok))


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """The child's rows whose key isn't null and has no parent."""
    keys = parent.select(F.col(key).alias("__key")).where("__key is not null").distinct()
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__key"), "left_anti")


def uncovered(parent: DataFrame, key: str, child: DataFrame, fk: str, least: int) -> DataFrame:
    """(key, n) of the parents with fewer than `least` children."""
    counts = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__fk")).agg(F.count("*").alias("__n"))
    joined = parent.join(counts, F.col(key) == F.col("__fk"), "left")
    return joined.select(F.col(key).alias("key"), F.coalesce("__n", F.lit(0)).alias("n")).where(F.col("n") < least)


def looping(df: DataFrame, key: str, parent: str, *, rounds: int = 64) -> DataFrame:
    """Nodes from which following parents never ends, by doubling the steps of all pointers each round.

    It ends when a round leaves as many as before: a path that ended would have a node that falls out in that round.

    A key that repeats is one node, and of several parents the least counts, so that a round never has more rows than nodes.
    Joins are by shuffle: small files may hold very many nodes, which a broadcast would send through the driver each round.
    """
    hops = df.where(F.col(key).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(parent).alias("at"))
    own = df.select(F.col(key).alias("k")).where("k is not null").distinct()
    hops = stage(hops.join(own.hint("merge"), F.col("at") == F.col("k"), "left_semi"), "hops")
    n = hops.count()
    for _ in range(min(rounds, n.bit_length() + 1)):
        ahead = hops.select(F.col("node").alias("mid"), F.col("at").alias("next"))
        further = stage(hops.join(ahead.hint("merge"), F.col("at") == F.col("mid")).select("node", F.col("next").alias("at")), "hops")
        unstage(hops)
        hops, before = further, n
        n = hops.count()
        if n in (0, before):
            break
    return hops.select("node")


def _relation(report: Report, data: Dataset, t: Table, f: Field) -> None:
    parent, key = f.references
    n = orphans(data[t.name], f.name, data[parent], key).count()
    report.add("foreign_key", t.name, f.name, n == 0, f"{n} values aren't in {parent}.{key}", bad=n)
    if parent == t.name:
        loops = looping(data[t.name], key, f.name).count()
        report.add("hierarchy_acyclic", t.name, f.name, loops == 0, f"{loops} rows lead into a cycle", bad=loops)
    least = int(f.get("min_per_parent", 0))
    if least:
        few = uncovered(data[parent], key, data[t.name], f.name, least).count()
        report.add("parent_coverage", t.name, f.name, few == 0, f"{few} parents have fewer than {least}", bad=few)


def with_parent(df: DataFrame, fk: str, parent: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """df with a column of the first parent row of each key."""
    right = parent.select(F.col(key).alias("__pk"), F.col(column).alias(name)).where("__pk is not null").dropDuplicates(["__pk"])
    return df.join(right, F.col(fk) == F.col("__pk"), "left").drop("__pk")


def _lookup(report: Report, data: Dataset, t: Table, f: Field) -> None:
    fk = t.field(f.get("via"))
    df = with_parent(data[t.name], fk.name, data[fk.references[0]], fk.references[1], f.get("column"), "__want").where(F.col(fk.name).isNotNull())
    numeric = dict(df.dtypes)[f.name] in ("double", "float", "bigint", "int")
    n = df.where(~(close(F.col(f.name).cast("double"), F.col("__want").cast("double")) if numeric else same(F.col(f.name).cast("string"), F.col("__want").cast("string")))).count()
    report.add("lookup_consistency", t.name, f.name, n == 0, f"{n} values differ from their parent's", bad=n)


def out_of_order(v: Column, a: Column, option: str, by_day: bool, least: float = 0, most: float | None = None) -> Column:
    """Whether a value breaks after or before; by day where either side is a date."""
    v, a = (v.cast("date").cast("timestamp_ntz"), a.cast("date").cast("timestamp_ntz")) if by_day else (v.cast("timestamp_ntz"), a.cast("timestamp_ntz"))
    gap = F.timestamp_diff("SECOND", a, v)
    if option == "before":
        return gap > 0
    bad = gap < F.lit(int(least * 86400))
    return bad if most is None else bad | (gap > F.lit(int(most * 86400)))


def _order(report: Report, data: Dataset, t: Table, f: Field, option: str) -> None:
    fk, other = data.schema.anchor(t, f.anchors[option])
    df = data[t.name]
    if fk is not None:
        df = with_parent(df, fk.name, data[fk.references[0]], fk.references[1], other.name, "__anchor")
    anchor = F.col("__anchor" if fk is not None else other.name)
    bad = out_of_order(F.col(f.name), anchor, option, "date" in (f.type, other.type), f.get("min_days", 0), f.get("max_days"))
    n = df.where(F.col(f.name).isNotNull() & anchor.isNotNull() & bad).count()
    report.add("temporal_order", t.name, f.name, n == 0, f"{n} values break {option} {f.anchors[option]}", bad=n)


def distribution_report(data: Dataset) -> dict:
    """What each field holds, by table: counts, moments, shares; by case where the field has cases."""
    return {t.name: {f.name: summary(data[t.name], f) for f in t.fields} for t in data.schema.tables}


def summary(df: DataFrame, f: Field) -> dict:
    out = _summary(df, f)
    if f.get("when"):
        held = df.withColumn("__case", case_column(f, df))
        out["cases"] = {c: _summary(held.where(F.col("__case") == c), f.merged(c)) for c in f.get("when")["cases"]}
    return out


def _summary(df: DataFrame, f: Field) -> dict:
    c = F.col(f.name)
    if f.type in ("int", "float"):
        r = df.agg(F.count("*").alias("count"), F.count(F.when(c.isNull(), 1)).alias("nulls"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).first()
        return r.asDict()
    n, nulls = df.agg(F.count("*"), F.count(F.when(c.isNull(), 1))).first()
    if f.type in ("category", "bool"):
        shares = f.get("categories") or {True: f.get("true_rate", 0.5), False: 1 - f.get("true_rate", 0.5)}
        total = sum(shares.values())
        counts, _, _ = label_counts(df, f.name, list(shares))
        return {"count": n, "nulls": nulls, "values": {k: {"observed": counts.get(k, 0) / max(1, n - nulls), "expected": w / total} for k, w in shares.items()}}
    distinct, sample = df.agg(F.count_distinct(c), F.min(c)).first()
    return {"count": n, "nulls": nulls, "distinct": distinct, "sample": sample}


def render_distribution(report: dict) -> str:
    lines = []
    for table, fields in report.items():
        lines.append(table)
        for name, s in fields.items():
            lines += [f"  {name}: " + _line(s), *(f"    {c}: {_line(x)}" for c, x in s.get("cases", {}).items())]
    return "\n".join(lines)


def _line(s: dict) -> str:
    if "values" in s:
        return ", ".join(f"{k} {v['observed']:.3f} ({v['expected']:.3f})" for k, v in s["values"].items())
    return ", ".join(f"{k} {v:.4g}" if isinstance(v, float) else f"{k} {v}" for k, v in s.items() if k != "cases")


__all__ = ["Check", "Report", "close", "distribution_report", "is_key", "looping", "orphans", "render_distribution", "summary", "uncovered", "validate"]
