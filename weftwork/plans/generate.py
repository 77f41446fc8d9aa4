"""Tables from a schema. Each column is a function of (seed, table, column, row), so that partitions don't matter."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.errors import SchemaError
from weftwork.functions import pools, rng
from weftwork.functions.formula import Formula
from weftwork.functions.ranking import with_position
from weftwork.plans.schema import DISTRIBUTIONS, OPEN_DAYS, SEMANTIC, Field, Schema, Table, bounds, capacity, field_order, formula_text, load_schema, window
from weftwork.staging import stage

RID = "_rid"
#: Ranks whose weights are summed one by one; those beyond, if a table has more parents, follow the integral.
EXACT_RANKS = 1_000_000


@dataclass
class Dataset:
    """A schema and its tables, evaluated when they are used."""

    schema: Schema
    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def names(self) -> list[str]:
        return list(self.tables)

    def row_counts(self) -> dict[str, int]:
        return {k: v.count() for k, v in self.tables.items()}

    def staged(self) -> Dataset:
        """The same tables, written once to the shared folder: for what reads them more than once."""
        return Dataset(self.schema, {k: stage(v, k) for k, v in self.tables.items()})

    def to_pandas(self) -> dict[str, Any]:
        return {k: v.toPandas() for k, v in self.tables.items()}


def generate(schema: Schema | dict | str, spark: SparkSession | None = None, *, seed: int | None = None) -> Dataset:
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return Generator(load_schema(schema), spark, seed).run()


def quotas(weights: dict, n: int) -> dict:
    """Whole counts by weight that sum to n: largest remainders first, ties in order."""
    total = sum(weights.values())
    exact = {k: n * w / total for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: out[k] - exact[k])[: n - sum(out.values())]:
        out[k] += 1
    return out


def by_quota(weights: dict, n: int, place: Column) -> Column:
    """The label at a place in [0, n) when labels stand in blocks of their quotas."""
    out, at = None, n
    for label, count in reversed([x for x in quotas(weights, n).items() if x[1]]):
        out = F.lit(label) if out is None else F.when(place < at, F.lit(label)).otherwise(out)
        at -= count
    return F.lit(None).cast("string") if out is None else out


def zipf_rank(u: Column, n: int, s: float) -> Column:
    """A rank in [0, n) with weight 1 / (rank + 1) ** s, from a uniform draw."""

    @F.pandas_udf("long")
    def run(draws):
        import numpy as np
        import pandas as pd

        m = min(n, EXACT_RANKS)
        head = np.cumsum(np.arange(1, m + 1, dtype=float) ** -s)
        power = 1 - s
        area = lambda a, b: np.log(b / a) if abs(power) < 1e-9 else (b**power - a**power) / power
        total = head[-1] + (area(m + 0.5, n + 0.5) if n > m else 0.0)
        x = draws.to_numpy() * total
        rank = np.searchsorted(head, x, side="right")
        far = rank >= m
        if n > m and far.any():
            rest = x[far] - head[-1]
            beyond = (m + 0.5) * np.exp(rest) if abs(power) < 1e-9 else ((m + 0.5) ** power + power * rest) ** (1 / power)
            rank[far] = np.minimum(n - 1, np.floor(beyond - 0.5).astype(np.int64))
        return pd.Series(np.minimum(rank, n - 1).astype(np.int64))

    return run(u)


class Generator:
    def __init__(self, schema: Schema, spark: SparkSession, seed: int | None = None):
        self.schema, self.spark, self.seed = schema, spark, schema.seed if seed is None else seed
        self.made: dict[str, DataFrame] = {}  # with their row numbers

    def run(self) -> Dataset:
        for table in self.schema.order():
            self.made[table.name] = self.table(table)
        return Dataset(self.schema, {t.name: self.made[t.name].select(*t.names) for t in self.schema.tables})

    def table(self, t: Table) -> DataFrame:
        df = self.spark.range(t.rows).withColumnRenamed("id", RID)
        for f in field_order(t):
            df = self.column(t, f, df)
            if f.unique and f.type not in ("foreign_key", "id", "uuid"):
                df = self.make_unique(t, f, df)
            own_tree = f.references and f.references[0] == t.name
            if f.null_rate and not f.unique and f.type != "foreign_key" and not own_tree:
                df = df.withColumn(f.name, F.when(rng.uniform(self.key(t, f, "null"), F.col(RID)) >= f.null_rate, F.col(f.name)))
        return df

    def key(self, t: Table, f: Field, part: str = "") -> str:
        return f"{self.seed}:{t.name}:{f.name}:{part}"

    def column(self, t: Table, f: Field, df: DataFrame) -> DataFrame:
        row, key = F.col(RID), self.key(t, f)
        if f.type == "foreign_key":
            return self.foreign_key(t, f, df)
        if f.type == "lookup":
            return self.parent_value(t, f.get("via"), f.get("column"), df, f.name)
        if f.type in ("date", "datetime") and f.anchors:
            return self.anchored(t, f, df)
        if f.get("when"):
            return self.by_case(t, f, df)
        if f.type in ("int", "float"):
            return self.numeric(t, f, df)
        if f.type == "formula":
            typed = Formula(formula_text(f)).compile({n: k for n, k in df.dtypes}, f"{t.name}.{f.name}")
            out = typed.col
            if f.params.get("round") is not None and typed.kind in ("double", "bigint"):
                out = F.bround(out, int(f.get("round")))
            return df.withColumn(f.name, out)
        if f.type == "id" and f.get("strategy", "sequential") == "sequential":
            number = F.lit(f.get("start", 1)).cast("long") + row
            return df.withColumn(f.name, F.concat(F.lit(f.get("prefix")), number.cast("string")) if f.get("prefix") else number)
        if f.type in ("id", "uuid"):
            h = F.md5(F.concat_ws(":", F.lit(key), row.cast("string")))
            return df.withColumn(f.name, F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
        if f.type == "category":
            labels = f.get("categories")
            if f.unique:
                return df.withColumn(f.name, F.element_at(F.array(*map(F.lit, labels)), (rng.permuted(key, row, len(labels)) + 1).cast("int")))
            return df.withColumn(f.name, by_quota(labels, t.rows, rng.permuted(key, row, t.rows)))
        return df.withColumn(f.name, self.scalar(f, key, row, 0))

    def scalar(self, f: Field, key: str, row: Column, draw: int) -> Column:
        """A draw that needs no other rows."""
        key = f"{key}:{draw}" if draw else key
        if f.type == "bool":
            return rng.uniform(key, row) < float(f.get("true_rate", 0.5))
        if f.type in ("int", "float"):
            return self.drawn(f, key, row)
        if f.type in ("date", "datetime"):
            start, end = window(f)
            if f.type == "date":
                return F.date_add(F.lit(start.date()), rng.index(key, row, (end.date() - start.date()).days + 1).cast("int"))
            return _later(F.lit(start).cast("timestamp_ntz"), rng.index(key, row, int((end - start).total_seconds()) + 1))
        if f.type in SEMANTIC:
            return pools.draw(f.type, key, row, sentences=f.get("sentences", 2), name=F.col(f.depends_on) if f.depends_on else None)
        raise SchemaError(f"{f.name}: {f.type} can't be drawn")

    def drawn(self, f: Field, key: str, row: Column) -> Column:
        low, high = map(float, bounds(f))
        kind = DISTRIBUTIONS[str(f.get("distribution", "uniform"))]
        if kind == "normal":
            out = F.greatest(F.lit(low), F.least(F.lit(high), rng.normal(key, row, float(f.get("mean", (low + high) / 2)), float(f.get("std", (high - low) / 6 or 1e-9)))))
        elif kind == "exponential":
            out = F.least(F.lit(high), rng.exponential(key, row, low, float(f.get("scale", (high - low) / 3 or 1e-9))))
        else:
            out = F.lit(low) + rng.uniform(key, row) * (high - low)
        return finished(f, out)

    def numeric(self, t: Table, f: Field, df: DataFrame, case: list[str] | None = None, name: str | None = None) -> DataFrame:
        name = name or f.name
        tie = f.get("correlate")
        if not tie:
            return df.withColumn(name, self.scalar(f, self.key(t, f), F.col(RID), 0))
        kinds = dict(df.dtypes)
        driver = F.col(tie["field"])
        plain = kinds[tie["field"]] in ("bigint", "int", "double", "float") or kinds[tie["field"]].startswith("decimal")
        value = F.coalesce(driver.cast("double"), F.col(RID).cast("double")) if plain else F.col(RID).cast("double")
        df = with_position(df, "__place", value, RID, by=case)
        many = F.lit(t.rows)
        if case:
            sizes = df.groupBy(*case).agg(F.count("*").alias("__many")).select(F.col(case[0]).alias("__case"), "__many")
            df = df.join(F.broadcast(sizes), F.col(case[0]).eqNullSafe(F.col("__case"))).drop("__case")
            many = F.col("__many")
        rank = F.when(many > 1, F.col("__place") / (many - 1)).otherwise(0.5)
        rank = 1 - rank if tie.get("direction") == "negative" else rank
        low, high = map(float, bounds(f))
        s = float(tie.get("strength", 0.8))
        u = rng.uniform(self.key(t, f, "tie"), F.col(RID))
        return df.withColumn(name, finished(f, F.lit(low) + (rank * s + u * (1 - s)) * (high - low))).drop("__place", "__many")

    def by_case(self, t: Table, f: Field, df: DataFrame) -> DataFrame:
        """Rows by their case, each with its own options; other and null keys have the base's."""
        key, cases = f.get("when")["field"], sorted(f.get("when")["cases"])
        label = F.col(key).cast("string")
        case = F.lit(None).cast("string")
        for c in cases:
            case = F.when(label == (c.lower() if dict(df.dtypes)[key] == "boolean" else c), c).otherwise(case)
        df = df.withColumn("__of", case)
        own = {None: f.merged(None), **{c: f.merged(c) for c in cases}}
        own = {c: Field(f.name, x.type, {**x.params, "when": None}) for c, x in own.items()}
        pick = lambda made: F.coalesce(*[F.when(F.col("__of").eqNullSafe(F.lit(c).cast("string")), made[c]) for c in own])
        if f.type == "category":
            df = with_position(df, "__place", rng.uniform(self.key(t, f), F.col(RID)), RID, by=["__of"])
            counts = {r["__of"]: r["n"] for r in df.groupBy("__of").agg(F.count("*").alias("n")).collect()}
            own = {c: x for c, x in own.items() if counts.get(c)}
            return df.withColumn(f.name, pick({c: by_quota(x.get("categories"), counts[c], F.col("__place")) for c, x in own.items()}) if own else F.lit(None).cast("string")).drop("__of", "__place")
        made: dict[str | None, Column] = {}
        for i, (c, x) in enumerate(own.items()):
            if f.type in ("int", "float") and x.get("correlate"):
                df = self.numeric(t, x, df, ["__of"], f"__c{i}")
                made[c] = F.col(f"__c{i}")
            else:
                made[c] = self.scalar(x, self.key(t, f), F.col(RID), 0)
        return df.withColumn(f.name, pick(made)).drop("__of", *(f"__c{i}" for i in range(len(own))))

    def foreign_key(self, t: Table, f: Field, df: DataFrame) -> DataFrame:
        """The key and, in a hidden column, the parent's row."""
        parent, column = f.references
        row, key, at = F.col(RID), self.key(t, f), _index(f)
        missing = rng.uniform(self.key(t, f, "null"), row) < f.null_rate
        if parent == t.name:
            index = F.when((row == 0) | missing, None).otherwise(F.least(F.floor(rng.uniform(key, row) * row).cast("long"), row - 1))
            df = df.withColumn(at, index)
            return self._keys(df, df, t.field(column), at, f.name)
        n = self.schema.table(parent).rows
        if not t.rows:
            return df.withColumn(at, F.lit(None).cast("long")).withColumn(f.name, F.lit(None).cast(self.schema.spark_type(t, f)))
        least = int(f.get("min_per_parent", 0))
        if f.unique:
            index = rng.permuted(key, row, n)
        else:
            if f.get("skew", "uniform") == "zipf":
                df = df.withColumn("__rank", zipf_rank(rng.uniform(key, row), n, float(f.get("zipf_s", 1.1))))
                index = rng.permuted(self.key(t, f, "order"), F.col("__rank"), n)
            else:
                index = rng.index(key, row, n)
            index = F.when(~missing, index) if f.null_rate else index
            if least:
                place = rng.permuted(self.key(t, f, "place"), row, t.rows)
                df = df.withColumn("__slot", place)
                index = F.when(F.col("__slot") < least * n, F.col("__slot") % n).otherwise(index)
        df = df.withColumn(at, index).drop("__slot", "__rank")
        return self._keys(df, self.made[parent], self.schema.table(parent).field(column), at, f.name)

    def _keys(self, df: DataFrame, parent: DataFrame, key: Field, at: str, name: str) -> DataFrame:
        """df with the parents' keys: by arithmetic where they count, else by a join on row numbers."""
        if key.type == "id" and key.get("strategy", "sequential") == "sequential" and not key.null_rate:
            number = F.lit(key.get("start", 1)).cast("long") + F.col(at)
            return df.withColumn(name, F.concat(F.lit(key.get("prefix")), number.cast("string")) if key.get("prefix") else number)
        return _joined(df, parent, at, key.name, name)

    def parent_value(self, t: Table, fk_name: str, column: str, df: DataFrame, name: str) -> DataFrame:
        fk = t.field(fk_name)
        parent = df if fk.references[0] == t.name else self.made[fk.references[0]]
        return _joined(df, parent, _index(fk), column, name)

    def anchored(self, t: Table, f: Field, df: DataFrame) -> DataFrame:
        """A window for each row: after and before its anchors, within start and end where they are declared."""
        day = f.type == "date"
        cast = "date" if day else "timestamp_ntz"
        add = (lambda c, n: F.date_add(c, n)) if day else (lambda c, n: _later(c, F.lit(int(n) * 86400)))
        none = F.lit(None).cast(cast)
        low, high = (F.lit(window(f)[0]).cast(cast) if f.params.get("start") is not None else none), (F.lit(window(f)[1]).cast(cast) if f.params.get("end") is not None else none)
        held: dict[str, Column] = {}
        for option, name in f.anchors.items():
            fk, other = self.schema.anchor(t, name)
            if fk is None:
                held[option] = F.col(other.name).cast(cast)
            else:
                df = self.parent_value(t, fk.name, other.name, df, f"__{option}")
                held[option] = F.col(f"__{option}").cast(cast)
            coarse = other.type == "date" and not day
            if coarse and option == "before":
                held[option] = _later(held[option], F.lit(86399))
            if other.type == "datetime" and day and option == "after":
                held[option] = F.col(other.name if fk is None else f"__{option}").cast("date")
        after, before = held.get("after", none), held.get("before", none)
        start = F.greatest(low, add(after, int(f.get("min_days", 0))))
        end = F.least(high, before, add(after, int(f.get("max_days"))) if f.params.get("max_days") is not None else none)
        only = F.lit(window(f)[0]).cast(cast), F.lit(window(f)[1]).cast(cast)
        bound = after.isNotNull() | before.isNotNull()
        first = F.coalesce(start, F.when(bound & end.isNotNull(), add(end, -OPEN_DAYS)), only[0])
        last = F.coalesce(end, F.when(bound & start.isNotNull(), add(start, OPEN_DAYS)), only[1])
        df = df.withColumns({"__first": first, "__last": last})
        span = F.datediff("__last", "__first").cast("long") if day else F.timestamp_diff("SECOND", F.col("__first"), F.col("__last"))
        u = rng.uniform(self.key(t, f), F.col(RID))
        step = F.least(F.floor(u * (span + 1)).cast("long"), span)
        value = F.date_add("__first", step.cast("int")) if day else _later(F.col("__first"), step)
        value = F.when(span < 0, F.raise_error(F.lit(f"{t.name}.{f.name}: no date is between its anchors"))).otherwise(value)
        return df.withColumn(f.name, value).drop("__first", "__last", "__after", "__before")

    def make_unique(self, t: Table, f: Field, df: DataFrame) -> DataFrame:
        """Every value once: by counters in addresses, by a permutation of a finite domain, else by drawing again."""
        if f.type == "category":
            return df
        if f.type == "formula":
            twice = df.groupBy(f.name).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col(f.name).isNotNull()).limit(1).collect()
            if twice:
                raise SchemaError(f"{t.name}.{f.name}: its formula gives {twice[0][0]!r} more than once")
            return df
        size = capacity(f)
        plain = DISTRIBUTIONS.get(str(f.get("distribution", "uniform"))) == "uniform" and not f.get("correlate")
        if size is not None and f.type in ("int", "float", "date", *SEMANTIC) and (plain or f.type not in ("int", "float")) and not f.anchors:
            at = rng.permuted(self.key(t, f, "unique"), F.col(RID), size)
            return df.withColumn(f.name, self.domain_value(f, at))
        w = Window.partitionBy(f.name).orderBy(RID)
        for attempt in range(1, 26):
            df = df.withColumn("__n", F.row_number().over(w))
            again = (F.col("__n") > 1) & F.col(f.name).isNotNull()
            if not df.where(again).limit(1).count():
                return df.drop("__n")
            if f.type == "email":
                other = F.concat(F.substring_index(f.name, "@", 1), F.col("__n").cast("string"), F.lit("@"), F.substring_index(f.name, "@", -1))
            elif f.type == "url":
                other = F.regexp_replace(f.name, r"^(https://[^./]+)", F.concat(F.lit("$1"), F.lit("-"), F.col("__n").cast("string")))
            elif size is not None and attempt > 2:
                return self.fill(t, f, df, again, size)
            elif f.anchors or f.get("correlate"):
                raise SchemaError(f"{t.name}.{f.name}: unique values can't be found")
            else:
                other = self.scalar(f, self.key(t, f), F.col(RID), attempt)
            df = df.withColumn(f.name, F.when(again, other).otherwise(F.col(f.name))).drop("__n")
        raise SchemaError(f"{t.name}.{f.name}: unique values can't be found")

    def fill(self, t: Table, f: Field, df: DataFrame, again: Column, size: int) -> DataFrame:
        """Rows whose value is taken get those of the domain that no row has."""
        domain = self.spark.range(size).select(F.col("id").alias("__d"), self.domain_value(f, F.col("id")).alias("__value"))
        free = domain.join(df.where(~again).select(F.col(f.name).alias("__value")), "__value", "left_anti")
        free = with_position(free, "__p", rng.uniform(self.key(t, f, "fill"), F.col("__d")), "__d").select(F.col("__p").alias("__q"), "__value")
        lost = with_position(df.where(again).select(F.col(RID).alias("__r")), "__p", F.col("__r"), "__r").join(free, F.col("__p") == F.col("__q")).select("__r", "__value")
        out = df.join(lost, F.col(RID) == F.col("__r"), "left")
        return out.withColumn(f.name, F.coalesce(F.col("__value"), F.col(f.name))).drop("__n", "__r", "__value")

    def domain_value(self, f: Field, at: Column) -> Column:
        low = bounds(f)[0] if f.type in ("int", "float") else None
        if f.type == "int":
            return F.lit(int(-(-low // 1))).cast("long") + at
        if f.type == "float":
            return F.round(F.lit(float(low)) + at / F.lit(float(10 ** int(f.get("round")))), int(f.get("round")))
        if f.type == "date":
            return F.date_add(F.lit(window(f)[0].date()), at.cast("int"))
        return F.element_at(F.array(*map(F.lit, pools.domain(f.type))), (at + 1).cast("int"))


def finished(f: Field, out: Column) -> Column:
    """Whole numbers and rounded ones stay within their bounds."""
    low, high = bounds(f)
    if f.type == "int":
        return F.greatest(F.lit(int(-(-low // 1))).cast("long"), F.least(F.lit(int(high // 1)).cast("long"), F.bround(out, 0).cast("long")))
    if f.params.get("round") is not None:
        return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.bround(out, int(f.get("round")))))
    return out


def _index(f: Field) -> str:
    return f"__parent_{f.name}"


def _later(moment: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, moment)


def _joined(df: DataFrame, parent: DataFrame, at: str, column: str, name: str) -> DataFrame:
    right = parent.select(F.col(RID).alias("__row"), F.col(column).alias("__copy"))
    return df.join(right, F.col(at) == F.col("__row"), "left").withColumn(name, F.col("__copy")).drop("__row", "__copy")
