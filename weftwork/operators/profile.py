"""Profiling raw tables into a schema, and holding synthetic tables against real ones."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import pools
from weftwork.functions.ranking import with_position
from weftwork.operators.validate import orphans
from weftwork.plans.schema import Schema
from weftwork.sources.io import RawData

EVIDENCE, MOST_LABELS, CHUNK, FIRST = 20, 50, 200, 1000
KINDS = ("bool", "int", "float", "date", "datetime", "uuid", "email", "string")
_INT, _FLOAT = r"^[+-]?(0|[1-9]\d*)$", r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: Shapes of dates and moments, each digit as 9; parts of seconds and zones are taken off before.
_DAY, _MOMENTS = "9999-99-99", [f"9999-99-99{gap}{clock}" for gap in "T " for clock in ("99:99", "99:99:99")]
#: Plural endings and what the singular has in their place; fixed values, the first that fits counts.
_PLURALS = (("ies", "y"), ("ses", "s"), ("xes", "x"), ("ss", "ss"), ("s", ""))
_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
_FLAG = re.compile(r"^(is|has|can|should|was)_|_flag$")


def numeric_summary(df: DataFrame, c: str) -> DataFrame:
    x = F.col(c)
    return df.agg(F.count(x).alias("n"), (F.count("*") - F.count(x)).alias("nulls"), F.round(F.min(x) + 0.0, 6).alias("min"), F.round(F.max(x), 6).alias("max"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std")).select(F.lit(c).alias("field"), "n", "nulls", "min", "max", "mean", "std")


def shares(df: DataFrame, c: str) -> DataFrame:
    counts = df.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 9).alias("observed"))


def _shape(text: Column) -> Column:
    return F.translate(text, "012345678", "9" * 9)


def _is_moment(text: Column) -> Column:
    """A date and a time of day, with seconds or without, parts of seconds only after seconds, and perhaps a zone."""
    local = F.regexp_replace(_shape(text), r"(?:Z|[+-]99:?99)$", "")
    whole = F.regexp_replace(local, r"(:99:99)\.9+$", "$1")
    return whole.isin(*_MOMENTS)


def _moment(text: Column) -> Column:
    """The wall time of a moment, without parts of seconds and zone."""
    return F.replace(F.regexp_extract(text, r"^[\d-]{10}[T ][\d:]{5,8}", 0), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


def _fits(kind: str, name: str, c: Column) -> Column:
    text = F.trim(c)
    words = ["true", "false"] + (["0", "1"] if _FLAG.search(name) else [])
    return {
        "bool": F.lower(text).isin(*words), "int": text.rlike(_INT), "float": text.rlike(_FLOAT) & text.rlike(r"^[+-]?(0(?!\d)|[1-9]|\.|0\.)") & text.try_cast("double").isNotNull(),
        "date": (_shape(text) == _DAY) & text.try_cast("date").isNotNull(), "datetime": _is_moment(text) & _moment(text).isNotNull(),
        "uuid": text.rlike(pools.UUID), "email": text.rlike(_EMAIL), "string": F.lit(True),
    }[kind]


def present(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def sniff(df: DataFrame) -> dict[str, str]:
    """The kind of each text column: the first that all its values fit; empty if it has none.

    Some first rows rule kinds out; one aggregate then holds all values against the first kind left of each column, and
    another one follows only where a kind fails.
    """

    def fit(held: DataFrame, asked: dict[str, list[str]]) -> dict:
        return held.agg(F.lit(0), *(F.coalesce(F.bool_and(F.when((x := present(F.col(c))).isNotNull(), _fits(k, c, x))), F.lit(True)).alias(f"{c}/{k}") for c, ks in asked.items() for k in ks)).first().asDict()

    first = fit(df.limit(FIRST), {c: list(KINDS) for c in df.columns})
    left = {c: [k for k in KINDS if first[f"{c}/{k}"]] for c in df.columns}
    many = df.agg(F.lit(0), *(F.count(present(F.col(c))).alias(c) for c in df.columns)).first().asDict()
    out = {c: "empty" for c in df.columns if not many[c]}
    while open_ := {c: ks[:1] for c, ks in left.items() if c not in out}:
        told = {c: ks for c, ks in open_.items() if ks != ["string"]}
        got = fit(df, told) if told else {}
        for c, (k,) in open_.items():
            if k == "string" or got[f"{c}/{k}"]:
                out[c] = k
            else:
                left[c] = left[c][1:]
    return {c: out[c] for c in df.columns}


def merged_labels(df: DataFrame, c: str, *, least: int = 5, other: str = "other") -> DataFrame:
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    return counts.groupBy(F.when(F.col("n") < least, other).otherwise(F.col(c)).alias("label")).agg(F.sum("n").alias("n"))


def zipf_exponent(df: DataFrame, fk: str) -> DataFrame:
    """(exponent, points): minus the slope of ln(count) on ln(rank)."""
    counts = df.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n")).withColumn("id", F.xxhash64("k"))
    ranked = with_position(counts, "rank", -F.col("n"), "id")
    return ranked.agg(F.round(-F.regr_slope(F.log("n"), F.log(F.col("rank") + 1)), 6).alias("exponent"), F.count("*").alias("points"))


def _average_ranks(df: DataFrame, c: str, name: str) -> DataFrame:
    """Each distinct value's average rank, from running sums over counts of values rather than of rows."""
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("many")).withColumn("id", F.xxhash64("value"))
    bounds = sorted(set(counts.select(F.col("value").cast("double").alias("v")).approxQuantile("v", [i / 64 for i in range(1, 64)], 0.005)))
    piece = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("value").cast("double"))) if bounds else F.lit(0)
    counts = counts.withColumn("piece", piece)
    sums = counts.groupBy("piece").agg(F.sum("many").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("many").over(Window.partitionBy("piece").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.join(F.broadcast(sums.select(F.col("piece").alias("p"), "before")), F.col("piece") == F.col("p")).select("value", (F.col("before") + within + (F.col("many") + 1) / 2).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n) of rows that have both; 0 where it isn't defined."""
    own = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    own = own.join(_average_ranks(own, "a", "ra"), F.col("a") == F.col("value")).drop("value")
    own = own.join(_average_ranks(own, "b", "rb"), F.col("b") == F.col("value")).drop("value")
    return own.agg(F.round(F.coalesce(F.corr("ra", "rb"), F.lit(0.0)), 6).alias("rho"), F.count("*").alias("n"))


def strength_from_rho(rho: float) -> float:
    """The strength whose mix of rank and uniform noise has this correlation: rho = s / sqrt(s² + (1 - s)²)."""
    r = min(0.999, abs(rho))
    k = math.sqrt(1 / (r * r) - 1) if r else 0
    return round(1 / (1 + k), 3) if r else 0.0


FORMULAS = {"*": lambda a, b: a * b, "+": lambda a, b: a + b, "-": lambda a, b: a - b}


def _agrees(target: Column, value: Column, digits: int) -> Column:
    return F.abs(target - value) <= 0.5000001 * 10.0**-digits + 1e-9 * F.abs(target)


def formula_fits(df: DataFrame, target: str, a: str, b: str, digits: int) -> DataFrame:
    """(formula, fits) of the candidates for a target of two operands, in one aggregate."""
    x, y, out = F.col(a), F.col(b), F.col(target)
    named = {f"{a} - {b}": x - y, f"{a} + {b}": x + y, f"{a} * {b}": x * y, f"{b} - {a}": y - x}
    row = df.agg(*(F.bool_and(_agrees(out, v, digits)).alias(f"f{i}") for i, v in enumerate(named.values())))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("formula"), F.col(f"f{i}").alias("fits")) for i, k in enumerate(named)))).alias("e")).select("e.*")


def total_variation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tvd) of the shares of `label`; 0 if either is empty."""
    one = shares(a, "label").select("label", F.col("observed").alias("p"))
    two = shares(b, "label").select(F.col("label").alias("l"), F.col("observed").alias("q"))
    return one.join(two, F.col("label") == F.col("l"), "full").agg(F.round(F.coalesce(0.5 * F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))), F.lit(0.0)), 4).alias("tvd"))


def fit_distribution(low: float, high: float, mean: float, std: float, skew: float | None) -> dict:
    even = (high - low) / math.sqrt(12)
    skew = skew or 0.0
    if high <= low or abs(std - even) <= 0.15 * even and abs(skew) < 0.5:
        return {}
    if skew > 1:
        return {"distribution": "exponential", "scale": six(mean - low)}
    return {"distribution": "normal", "mean": six(mean), "std": six(max(std, 1e-9))}


def six(x: float) -> float | int:
    y = float(f"{x:.6g}")
    return int(y) if y == int(y) and abs(y) < 1e15 else y


@dataclass
class Profile:
    """A column as found: its kind, its place in the schema and what it is read as."""

    table: str
    name: str
    kind: str
    n: int
    nulls: int
    distinct: int
    low: Any = None
    high: Any = None
    spec: dict = field(default_factory=dict)
    key: bool = False
    digits: int = 0


@dataclass
class Inference:
    schema: Schema
    spec: dict
    relations: list[str]
    suppressed: dict[str, int]

    def to_yaml(self, header: str = "# Inferred from data; labels below the least count aren't listed.\n") -> str:
        import yaml

        return header + yaml.safe_dump(self.spec, sort_keys=False, allow_unicode=True)

    def summary(self) -> str:
        lines = [f"{t['name']}: {t['rows']} rows, {len(t['fields'])} fields" for t in self.spec["tables"]]
        return "\n".join([*lines, *self.relations, *(f"{k}: {v} rare labels aren't listed" for k, v in self.suppressed.items() if v)])


def typed(kind: str, c: Column) -> Column:
    text = F.trim(c)
    return {"int": text.try_cast("bigint"), "float": text.try_cast("double"), "date": text.try_cast("date"), "datetime": _moment(text), "bool": F.lower(text).isin("true", "1")}.get(kind, text)


def infer_schema(raw: RawData, *, rows_scale: float = 1.0, min_category_count: int = 5, seed: int = 1234, max_categories: int = MOST_LABELS) -> Inference:
    """A schema of the tables: types, keys, relations, copies, orders, formulas and correlations."""
    tables = {k: df.select(*(present(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns)).cache() for k, df in raw.tables.items()}
    columns: dict[str, list[Profile]] = {}
    suppressed: dict[str, int] = {}
    relations: list[str] = []
    for name, df in tables.items():
        columns[name] = _profiles(name, df)
        for p in columns[name]:
            p.spec = _base_spec(p, df, min_category_count, max_categories, suppressed)
        _primary(columns[name])
    values = {k: df.select(*(typed(p.kind, F.col(p.name)).alias(p.name) for p in columns[k])) for k, df in tables.items()}
    links = _foreign_keys(columns, values, relations)
    for child, f, parent, key in links:
        _lookups(columns, values, child, f, parent, key, relations)
    for name in columns:
        _times(columns, values, name, [x for x in links if x[0] == name], relations)
        _formulas(columns[name], values[name], relations)
        _correlations(columns[name], values[name], relations)
        _names(columns[name], tables[name])
    scaled = lambda n: 0 if n == 0 else max(1, round(n * rows_scale))
    rows = {k: scaled(ps[0].n if ps else 0) for k, ps in columns.items()}
    order = _parents_first(list(columns), links)
    for name in order:
        for p in columns[name]:
            if p.spec.get("unique") and p.spec["type"] == "int" and p.spec["max"] - p.spec["min"] + 1 < rows[name]:
                p.spec["max"] = p.spec["min"] + rows[name] - 1
            if p.spec.get("min_per_parent"):
                parent = p.spec["references"].split(".")[0]
                p.spec["min_per_parent"] = min(p.spec["min_per_parent"], rows[name] // max(1, rows[parent]))
    spec = {"seed": seed, "tables": [{"name": n, "rows": rows[n], "fields": [{"name": p.name, **p.spec} for p in columns[n]]} for n in order]}
    return Inference(Schema.from_dict(_copied(spec)), spec, relations, suppressed)


def _copied(x):
    return {k: _copied(v) for k, v in x.items()} if isinstance(x, dict) else [_copied(v) for v in x] if isinstance(x, list) else x


def _profiles(table: str, df: DataFrame) -> list[Profile]:
    """Values are counted column by column: distinct counts of all at once would repeat each row for each column and sort them all."""
    kinds, out = sniff(df), []
    decimals = lambda c: F.when(F.col(c).rlike("[eE]"), 6).otherwise(F.least(F.lit(6), F.length(F.regexp_replace(F.regexp_extract(c, r"\.(\d*)$", 1), "0+$", ""))))
    got = df.agg(F.count("*").alias("n"), *(F.max(decimals(c)).alias(f"{c}/digits") for c, k in kinds.items() if k == "float")).first().asDict()
    for c, k in kinds.items():
        values = df.select(typed(k, F.col(c)).alias("v"), F.col(c).isNotNull().cast("int").alias("m")).groupBy("v").agg(F.sum("m").alias("m"))
        r = values.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.count("v").alias("d"), F.min("v").alias("low"), F.max("v").alias("high")).first()
        p = Profile(table, c, k, got["n"], got["n"] - r["n"], r["d"], r["low"], r["high"], digits=got.get(f"{c}/digits") or 0)
        p.key = p.nulls == 0 and p.n > 0 and p.distinct == p.n
        out.append(p)
    return out


def _base_spec(p: Profile, df: DataFrame, least: int, most: int, suppressed: dict) -> dict:
    spec: dict[str, Any] = {}
    c = typed(p.kind, F.col(p.name))
    if p.kind == "bool":
        spec = {"type": "bool", "true_rate": round(df.agg(F.avg(c.cast("int"))).first()[0], 4)}
    elif p.kind in ("int", "float"):
        if p.kind == "int" and p.key and p.high - p.low + 1 == p.n:
            return {"type": "id", "start": p.low}
        mean, std, skew = df.agg(F.avg(c), F.stddev_pop(c), F.skewness(c)).first()
        spec = {"type": p.kind, "min": p.low if p.kind == "int" else six(p.low), "max": p.high if p.kind == "int" else six(p.high)}
        if p.kind == "float":
            spec["round"] = p.digits
        spec |= fit_distribution(float(p.low), float(p.high), mean, std, None if skew is None or math.isnan(skew) else skew)
        if p.key and p.kind == "int":
            spec["unique"] = True
    elif p.kind in ("date", "datetime"):
        spec = {"type": p.kind, "start": str(p.low), "end": str(p.high)}
    elif p.kind == "uuid":
        spec = {"type": "uuid"}
    elif p.kind == "email":
        spec = {"type": "email"} | ({"unique": True} if p.key else {})
    elif p.kind == "empty":
        spec = {"type": "text", "null_rate": 1.0}
    else:
        spec = _text_spec(p, df, least, most, suppressed)
    if p.nulls and not spec.get("unique") and p.kind != "empty":
        spec["null_rate"] = round(p.nulls / p.n, 4)
    return spec


def _text_spec(p: Profile, df: DataFrame, least: int, most: int, suppressed: dict) -> dict:
    if p.key:
        number = F.regexp_extract(p.name, r"(\d+)$", 1)
        prefix = F.regexp_extract(p.name, r"^(.*?\D)\d+$", 1)
        r = df.agg(F.min(prefix).alias("p"), F.max(prefix).alias("q"), F.min(number.try_cast("bigint")).alias("a"), F.max(number.try_cast("bigint")).alias("b"), F.bool_and(number.rlike(r"^(0|[1-9]\d*)$")).alias("ok")).first()
        if r["ok"] and r["p"] == r["q"] and r["p"] and r["b"] - r["a"] + 1 == p.n:
            return {"type": "id", "prefix": r["p"], "start": r["a"]}
    if not p.key and p.distinct <= min(most, max(1, (p.n - p.nulls) // 2)):
        counts = [(r["label"], r["n"]) for r in merged_labels(df.where(F.col(p.name).isNotNull()), p.name, least=least).orderBy(F.desc("n"), "label").collect()]
        listed = df.where(F.col(p.name).isNotNull()).groupBy(p.name).count().where(F.col("count") >= least).count()
        suppressed[f"{p.table}.{p.name}"] = p.distinct - listed
        if listed:
            total = sum(n for _, n in counts)
            return {"type": "category", "categories": {k: round(n / total, 4) for k, n in counts}}
    sample = df.where(F.col(p.name).isNotNull()).select(F.col(p.name).alias("x")).limit(500)
    person = r"^[A-ZÀ-Þ][\w'’-]+( [A-ZÀ-Þ][\w'’.-]+){1,3}$"
    r = sample.agg(*(F.avg(F.col("x").rlike(pattern).cast("int")).alias(k) for k, pattern in {"ipv4": r"^\d{1,3}(\.\d{1,3}){3}$", "url": r"^https?://\S+$", "phone": r"^\+?[\d() -]{7,}$", "name": person}.items()), F.avg(F.greatest(F.lit(1), F.size(F.split("x", r"[.!?](\s|$)")) - 1)).alias("sentences")).first()
    low = p.name.lower()
    for kind in ("ipv4", "url", "phone"):
        if (r[kind] or 0) >= 0.95:
            return {"type": kind}
    for hint, kind in (("first_name", "first_name"), ("last_name", "last_name"), ("surname", "last_name"), ("city", "city"), ("country", "country"), ("address", "address"), ("company", "company"), ("job", "job")):
        if hint in low:
            return {"type": kind}
    if (r["name"] or 0) >= (0.9 if "name" in low else 0.95):
        return {"type": "name"}
    return {"type": "text", "sentences": max(1, round(r["sentences"] or 1))}


def _primary(columns: list[Profile]) -> None:
    ids = [p for p in columns if p.spec["type"] == "id"]
    for p in ids[1:]:
        p.spec = {"type": "int", "min": p.low, "max": p.high, "unique": True} if p.kind == "int" else {"type": "text", "unique": True}


def _singular(name: str) -> str:
    end, one = next((x for x in _PLURALS if name.endswith(x[0])), ("", ""))
    return name.removesuffix(end) + one


def _named(f: str, parent: str, key: str) -> bool:
    """Whether a column's name says that it holds the parent's key: the key's own name, the parent's with a usual ending, or a name that ends with a key's that says something."""
    f, parent, key = f.lower(), parent.lower(), key.lower()
    one = _singular(parent)
    usual = {key, one, f"{parent}_id", *(f"{one}_{end}" for end in ("id", "uuid", "key", "code"))}
    return f in usual or key not in ("id", "uuid", "key") and (f.endswith(f"_{key}") or len(key) > 3 and f.endswith(key))


def _foreign_keys(columns: dict, values: dict, relations: list[str]) -> list[tuple[str, str, str, str]]:
    found = []
    for child, own in columns.items():
        for p in own:
            if p.spec["type"] == "id" or p.kind in ("bool", "date", "datetime", "float", "empty") or p.n == p.nulls:
                continue
            for parent, others in columns.items():
                for k in others:
                    if not k.key or k.kind != p.kind or (parent == child and k is p):
                        continue
                    if parent == child and (k.spec["type"] not in ("id", "uuid") or not p.nulls or not re.search(r"_(id|uuid)$", p.name.lower())):
                        continue
                    name = _named(p.name, parent, k.name) or parent == child
                    if not name and p.kind in ("int", "email"):
                        continue
                    if p.distinct > k.distinct or p.low < k.low or p.high > k.high:
                        continue
                    found.append(((not name, k.spec["type"] not in ("id", "uuid"), k.n), child, p, parent, k))
    links, taken, edges = [], set(), set()
    for _, child, p, parent, k in sorted(found, key=lambda x: (x[0], x[1], x[2].name)):
        if (child, p.name) in taken or (child != parent and _reaches(edges, parent, child)) or p.key and k.spec["type"] != "id" and p.spec.get("type") == "id":
            continue
        if orphans(values[child], p.name, values[parent], k.name).limit(1).count():
            continue
        taken.add((child, p.name))
        if child != parent:
            edges.add((child, parent))
        links.append((child, p.name, parent, k.name))
        spec: dict[str, Any] = {"type": "foreign_key", "references": f"{parent}.{k.name}"}
        if p.nulls:
            spec["null_rate"] = round(p.nulls / p.n, 4)
        if child != parent:
            if p.key:
                spec["unique"] = True
            else:
                counts = values[child].where(F.col(p.name).isNotNull()).groupBy(p.name).agg(F.count("*").alias("n"))
                used, least = counts.agg(F.count("*"), F.min("n")).first()
                if used == k.n and least and least * k.n <= p.n:
                    spec["min_per_parent"] = int(least)
                z = zipf_exponent(values[child], p.name).first()
                if z["points"] >= 8 and (z["exponent"] or 0) >= 0.5:
                    spec |= {"skew": "zipf", "zipf_s": round(z["exponent"], 2)}
        p.spec = spec
        relations.append(f"{child}.{p.name} -> {parent}.{k.name}")
    return links


def _reaches(edges: set, start: str, goal: str) -> bool:
    left, seen = [start], set()
    while left:
        at = left.pop()
        if at == goal:
            return True
        if at not in seen:
            seen.add(at)
            left += [b for a, b in edges if a == at]
    return False


def _joined(values: dict, child: str, f: str, parent: str, key: str, names: list[str]) -> DataFrame:
    right = values[parent].select(F.col(key).alias("__key"), *(F.col(n).alias(f"__p_{n}") for n in names))
    return values[child].join(right, F.col(f) == F.col("__key"))


def _lookups(columns: dict, values: dict, child: str, f: str, parent: str, key: str, relations: list[str]) -> None:
    free = [p for p in columns[child] if p.name != f and p.spec["type"] not in ("id", "foreign_key", "lookup") and p.distinct > 1]
    pairs = [(p, k) for p in free for k in columns[parent] if k.kind == p.kind and k.name != key and not (parent == child and k.name == p.name)]
    if not pairs:
        return
    df = _joined(values, child, f, parent, key, sorted({k.name for _, k in pairs}))
    exprs = [F.count("*").alias("n")]
    for i, (p, k) in enumerate(pairs):
        a, b = F.col(p.name), F.col(f"__p_{k.name}")
        equal = F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a)) if p.kind in ("int", "float") else a == b
        both = a.isNotNull() & b.isNotNull()
        exprs += [F.bool_and(F.when(both, equal)).alias(f"ok{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    got = df.agg(*exprs).first()
    need = min(EVIDENCE, max(2, columns[child][0].n))
    for i, (p, k) in sorted(enumerate(pairs), key=lambda x: x[1][0].name != x[1][1].name):
        if got[f"ok{i}"] and got[f"n{i}"] >= need and p.spec["type"] != "lookup":
            p.spec = {"type": "lookup", "via": f, "column": k.name}
            relations.append(f"{child}.{p.name} = {parent}.{k.name} via {f}")


def _times(columns: dict, values: dict, child: str, links: list, relations: list[str]) -> None:
    dates = [p for p in columns[child] if p.spec["type"] in ("date", "datetime")]
    for at, p in enumerate(dates):
        best = None
        options = [(q.name, values[child], F.col(q.name), q) for q in dates[:at]]
        for _, f, parent, key in links:
            if parent != child:
                for q in columns[parent]:
                    if q.spec["type"] in ("date", "datetime"):
                        options.append((f"{f}.{q.name}", _joined(values, child, f, parent, key, [q.name]), F.col(f"__p_{q.name}"), q))
        for name, df, anchor, q in options:
            coarse = "date" in (p.kind, q.kind)
            v, a = (F.col(p.name).cast("date"), anchor.cast("date")) if coarse else (F.col(p.name), anchor)
            gap = F.datediff(v, a).cast("double") if coarse else F.timestamp_diff("SECOND", a, v) / 86400.0
            low, high, n = df.agg(F.min(gap), F.max(gap), F.count(gap)).first()
            if n < EVIDENCE:
                continue
            if low >= 0 and high > 0 and (best is None or high < best[0]):
                best = (high, {"after": name}, low, high)
            elif high <= 0 and low < 0 and (best is None or -low < best[0]):
                best = (-low, {"before": name}, low, high)
        if best is None:
            continue
        _, spec, low, high = best
        if "after" in spec:
            days = (p.high - p.low).days or 1
            if low >= 1:
                spec["min_days"] = math.floor(low)
            if high < days / 2:
                spec["max_days"] = math.ceil(high)
                p.spec.pop("start", None)
                p.spec.pop("end", None)
        p.spec |= spec
        relations.append(f"{child}.{p.name} {' '.join(f'{k} {v}' for k, v in spec.items())}")


def _formulas(columns: list[Profile], df: DataFrame, relations: list[str]) -> None:
    usable: list[Profile] = []
    for p in columns:
        if p.kind not in ("int", "float") or p.spec["type"] in ("id", "foreign_key") or p.key and p.kind == "int":
            continue
        found = _formula_of(p, usable, df) if p.spec["type"] not in ("lookup",) and p.distinct > 1 else None
        if found:
            p.spec = {"type": "formula", "expr": found if p.kind == "int" else f"round({found}, {p.digits})"}
            relations.append(f"{p.table}.{p.name} = {p.spec['expr']}")
        else:
            usable.append(p)


def _constant(ratio: DataFrame, digits: int) -> float | None:
    """The median of r = out / x, or None if no constant agrees with all rows: each row bounds it from both sides, and these bounds rule most operands out."""
    slack = 0.5000001 * 10.0**-digits + 1e-9 * F.abs("out")
    one, other = (F.col("out") - slack) / F.col("x"), (F.col("out") + slack) / F.col("x")
    n, most, least, low, high = ratio.agg(F.count("*"), F.max(F.least(one, other)), F.min(F.greatest(one, other)), F.min("r"), F.max("r")).first()
    if n < EVIDENCE or low is None or most > least + 1e-9 * abs(least):
        return None
    if low == high:
        return low
    places = with_position(ratio.where("r is not null").select("r", "id"), "place", F.col("r"), "id")
    middle = places.where(F.col("place").isin((n - 1) // 2, n // 2)).agg(F.min("r"), F.max("r")).first()
    return (middle[0] + middle[1]) / 2


def _formula_of(p: Profile, operands: list[Profile], df: DataFrame) -> str | None:
    out, named = F.col(p.name), {}
    for i, a in enumerate(operands):
        for b in operands[i + 1 :]:
            x, y = F.col(a.name), F.col(b.name)
            named |= {f"{a.name} * {b.name}": x * y, f"{a.name} + {b.name}": x + y, f"{a.name} - {b.name}": x - y, f"{b.name} - {a.name}": y - x}
    digits = p.digits if p.kind == "float" else 0
    items = list(named.items())
    for at in range(0, len(items), CHUNK):
        part = items[at : at + CHUNK]
        got = df.agg(*(F.bool_and(_agrees(out, v, digits)).alias(f"f{i}") for i, (_, v) in enumerate(part)), *(F.count(F.when(v.isNotNull() & out.isNotNull(), 1)).alias(f"n{i}") for i, (_, v) in enumerate(part))).first()
        for i, (k, _) in enumerate(part):
            if got[f"f{i}"] and got[f"n{i}"] >= EVIDENCE:
                return k
    for a in operands:
        x = F.col(a.name)
        ratio = df.where((x != 0) & out.isNotNull()).select((out / x).alias("r"), out.alias("out"), x.alias("x"), F.xxhash64("*").alias("id"))
        middle = _constant(ratio, digits)
        if middle is None or abs(middle) < 1e-9:
            continue
        tries = {c: None for c in (round(middle, d) for d in (2, 3, 4, 6)) if c not in (0, 1)}
        got = df.agg(*(F.bool_and(_agrees(out, x * c, digits)).alias(f"f{i}") for i, c in enumerate(tries))).first() if tries else ()
        for c, ok in zip(tries, got, strict=False):
            if ok:
                return f"{a.name} * {c}"
    return None


def _correlations(columns: list[Profile], df: DataFrame, relations: list[str]) -> None:
    numbers = [p for p in columns if p.kind in ("int", "float") and p.spec["type"] in ("int", "float", "formula")]
    for at, p in enumerate(numbers):
        if p.spec["type"] == "formula" or p.key:
            continue
        best = None
        for q in numbers[:at]:
            r = spearman(df, q.name, p.name).first()
            if r["n"] >= EVIDENCE and abs(r["rho"]) >= 0.3 and (best is None or abs(r["rho"]) > abs(best[0])):
                best = (r["rho"], q.name)
        if best:
            p.spec["correlate"] = {"field": best[1], "strength": strength_from_rho(best[0]), "direction": "positive" if best[0] > 0 else "negative"}
            relations.append(f"{p.table}.{p.name} follows {best[1]} (rho {best[0]:.2f})")


def _names(columns: list[Profile], df: DataFrame) -> None:
    for p in columns:
        if p.spec["type"] == "email":
            for q in columns:
                if q.spec["type"] == "name":
                    local = F.regexp_replace(F.lower(F.substring_index(p.name, "@", 1)), r"\d+$", "")
                    if (df.agg(F.avg((local == pools.local_part(F.col(q.name))).cast("int"))).first()[0] or 0) >= 0.8:
                        p.spec["depends_on"] = q.name


def _parents_first(names: list[str], links: list) -> list[str]:
    out: list[str] = []
    left = list(names)
    while left:
        ready = [n for n in left if all(p == n or p in out for c, _, p, _ in links if c == n)]
        out.append(ready[0])
        left.remove(ready[0])
    return out


def fidelity(raw: RawData, schema: Schema, synthetic: dict[str, DataFrame]) -> list[dict]:
    """How the synthetic tables hold against the real ones: shares of categories, moments of numbers, spans of dates."""
    out = []
    for t in schema.tables:
        if t.name not in raw.tables:
            continue
        for f in t.fields:
            if f.name not in raw.tables[t.name].columns:
                continue
            real, made = raw.tables[t.name].select(present(F.col(f.name)).alias("x")).where("x is not null"), synthetic[t.name].select(F.col(f.name).alias("x")).where("x is not null")
            entry: dict[str, Any] = {"table": t.name, "field": f.name, "type": f.type}
            if f.type == "category":
                known = [str(k) for k in f.get("categories")]
                label = F.when(F.col("x").isin(*known), F.col("x")).otherwise("other" if "other" in known else F.col("x"))
                entry["tvd"] = total_variation(real.select(label.alias("label")), made.select(F.col("x").cast("string").alias("label"))).first()[0]
            elif f.type in ("int", "float"):
                for name, df in (("real", real.select(F.col("x").try_cast("double").alias("x"))), ("synthetic", made)):
                    r = df.agg(F.avg("x"), F.stddev_pop("x"), F.min("x"), F.max("x")).first()
                    entry |= {f"{name}_{k}": v for k, v in zip(("mean", "std", "min", "max"), r, strict=True)}
            elif f.type in ("date", "datetime"):
                for name, df in (("real", real), ("synthetic", made.select(F.col("x").cast("string").alias("x")))):
                    r = df.agg(F.min("x"), F.max("x")).first()
                    entry |= {f"{name}_min": r[0], f"{name}_max": r[1]}
            else:
                continue
            out.append(entry)
    return out


def render_fidelity(entries: list[dict]) -> str:
    shown = lambda v: f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(f"{e['table']}.{e['field']} ({e['type']}): " + ", ".join(f"{k} {shown(v)}" for k, v in e.items() if k not in ("table", "field", "type")) for e in entries)
