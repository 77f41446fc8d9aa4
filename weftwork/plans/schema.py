"""Schemas of related tables: what is declared, and the checks that a schema can be generated before anything runs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from weftwork.errors import SchemaError
from weftwork.functions import pools
from weftwork.functions.formula import Formula

ALIASES = {
    "integer": "int", "number": "float", "boolean": "bool", "categorical": "category", "enum": "category", "full_name": "name", "fk": "foreign_key", "sentence": "text", "computed": "formula", "timestamp": "datetime", "ip": "ipv4",
}
SEMANTIC = ("name", "first_name", "last_name", "email", "phone", "city", "country", "address", "company", "job", "url", "ipv4", "text")
TYPES = {"id", "uuid", "int", "float", "bool", "category", "date", "datetime", "foreign_key", "lookup", "formula", *SEMANTIC}
DISTRIBUTIONS = {"uniform": "uniform", "normal": "normal", "exponential": "exponential", "exp": "exponential"}
OVERRIDES = {"int": {"min", "max", "distribution", "mean", "std", "scale", "correlate"}, "float": {"min", "max", "distribution", "mean", "std", "scale", "round", "correlate"}, "category": {"categories"}, "bool": {"true_rate"}}
FIRST_DAY, LAST_DAY, OPEN_DAYS = dt.date(2020, 1, 1), dt.date(2025, 12, 31), 365
SPARK = {"int": "bigint", "float": "double", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz"}


def moment(value: Any, where: str = "date") -> dt.datetime:
    """A date or datetime, from itself or ISO text; dates are midnight."""
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime.combine(value, dt.time())
    try:
        return dt.datetime.fromisoformat(str(value).strip()).replace(tzinfo=None)
    except ValueError as e:
        raise SchemaError(f"{where}: {value!r} isn't an ISO date") from e


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


@dataclass
class Field:
    """A column as declared; params holds all that isn't its name and type."""

    name: str
    type: str
    params: dict[str, Any] = field(default_factory=dict)

    def get(self, key: str, default: Any = None) -> Any:
        value = self.params.get(key)
        return default if value is None else value

    @property
    def unique(self) -> bool:
        return bool(self.get("unique", False))

    @property
    def null_rate(self) -> float:
        return float(self.get("null_rate", 0.0))

    @property
    def depends_on(self) -> str | None:
        return self.get("depends_on")

    @property
    def references(self) -> tuple[str, str] | None:
        """(table, column) of a foreign key."""
        target = self.get("references")
        if self.type != "foreign_key" or target is None:
            return None
        if isinstance(target, dict):
            return str(target.get("table")), str(target.get("column") or target.get("field"))
        table, _, column = str(target).partition(".")
        return table, column

    @property
    def anchors(self) -> dict[str, str]:
        """after and before, as declared."""
        return {k: str(self.params[k]) for k in ("after", "before") if self.params.get(k) is not None} if self.type in ("date", "datetime") else {}

    @property
    def counts(self) -> bool:
        """Whether it is an id of plain whole numbers."""
        return self.type == "id" and self.get("strategy", "sequential") == "sequential" and not self.get("prefix")

    def merged(self, case: str | None) -> Field:
        """The field as it is where its `when` key has a value."""
        extra = (self.get("when") or {}).get("cases", {}).get(case) if case is not None else None
        return Field(self.name, self.type, {**self.params, **extra, "when": None}) if extra else self

    def case_of(self, key: Any) -> str | None:
        """The label of the case for a key's value: booleans and numbers by their text."""
        label = None if key is None else str(key)
        cases = (self.get("when") or {}).get("cases", {})
        return label if label in cases else next((c for c in cases if label is not None and c.lower() == label.lower()), None) if isinstance(key, bool) else None


@dataclass
class Table:
    name: str
    rows: int
    fields: list[Field]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"{self.name} has no field {name!r}")

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)


@dataclass
class Schema:
    tables: list[Table]
    seed: int = 1234
    meta: dict[str, Any] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        for t in self.tables:
            if t.name == name:
                return t
        raise SchemaError(f"the schema has no table {name!r}")

    def has(self, name: str) -> bool:
        return any(t.name == name for t in self.tables)

    @classmethod
    def from_dict(cls, data: Any) -> Schema:
        if not isinstance(data, dict):
            raise SchemaError("a schema is a mapping with tables")
        tables = data.get("tables")
        if isinstance(tables, dict):
            tables = [{"name": k, **(v or {})} for k, v in tables.items()]
        if not isinstance(tables, list) or not tables:
            raise SchemaError("a schema needs a list of tables")
        seed = data.get("seed", 1234)
        if isinstance(seed, bool) or not isinstance(seed, int):
            raise SchemaError(f"seed is a whole number, not {seed!r}")
        out = cls([_table(t, i) for i, t in enumerate(tables)], seed, {k: v for k, v in data.items() if k not in ("tables", "seed")})
        out.check()
        return out

    @classmethod
    def from_yaml(cls, path: str | Path) -> Schema:
        import yaml

        try:
            return cls.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
        except (OSError, yaml.YAMLError) as e:
            raise SchemaError(f"{path} can't be read: {e}") from e

    def check(self) -> None:
        """Everything that can be known before rows are made; SchemaError at the first fault."""
        names = [t.name for t in self.tables]
        if len(set(names)) < len(names):
            raise SchemaError(f"tables are declared twice: {sorted({n for n in names if names.count(n) > 1})}")
        for t in self.tables:
            if len(set(t.names)) < len(t.names):
                raise SchemaError(f"{t.name}: a field is declared twice")
            for f in t.fields:
                _check_alone(t, f)
        for t in self.tables:
            for f in t.fields:
                _check_related(self, t, f)
        self.order()
        for t in self.tables:
            field_order(t)
            for f in t.fields:
                _check_capacity(self, t, f)
        _check_times(self)

    def order(self) -> list[Table]:
        """Parents before children; a cycle of tables is an error."""
        needs = {t.name: {f.references[0] for f in t.fields if f.references and f.references[0] != t.name} for t in self.tables}
        return [self.table(n) for n in _sorted(needs, "tables")]

    def anchor(self, table: Table, name: str) -> tuple[Field | None, Field]:
        """(foreign key or None, date field) of an anchor: a sibling, or fk.column."""
        if "." not in name:
            return None, table.field(name)
        fk_name, column = name.split(".", 1)
        fk = table.field(fk_name)
        if not fk.references:
            raise SchemaError(f"{table.name}.{fk_name} isn't a foreign key, so {name!r} is no anchor")
        return fk, self.table(fk.references[0]).field(column)

    def spark_type(self, table: Table, f: Field, depth: int = 0) -> str:
        """The Spark type of a field; keys and copies have that of what they point at."""
        if depth > 20:
            raise SchemaError(f"{table.name}.{f.name}: its type never ends")
        if f.type == "id":
            return "bigint" if f.counts else "string"
        if f.type == "foreign_key":
            parent = self.table(f.references[0])
            return self.spark_type(parent, parent.field(f.references[1]), depth + 1)
        if f.type == "lookup":
            parent = self.table(table.field(f.get("via")).references[0])
            return self.spark_type(parent, parent.field(f.get("column")), depth + 1)
        if f.type == "formula":
            formula = Formula(formula_text(f))
            names = {n: self.spark_type(table, table.field(n), depth + 1) for n in formula.fields}
            kind = compile_type(formula, names, f"{table.name}.{f.name}")
            return {"date": "date", "timestamp": "timestamp_ntz", "null": "string"}.get(kind, kind)
        if f.type == "category":
            kinds = {type(k) for k in f.get("categories")}
            return {int: "bigint", float: "double", bool: "boolean"}.get(kinds.pop(), "string") if len(kinds) == 1 else "string"
        return SPARK.get(f.type, "string")



def compile_type(formula: Formula, fields: dict[str, str], where: str) -> str:
    """The type a formula would have; needs a running session, since Columns live there."""
    return formula.compile(fields, where).kind


def formula_text(f: Field) -> str:
    return f.get("expr") or f.get("formula") or ""


def load_schema(source: Schema | dict | str | Path) -> Schema:
    return source if isinstance(source, Schema) else Schema.from_dict(source) if isinstance(source, dict) else Schema.from_yaml(source)


def _sorted(needs: dict[str, set[str]], what: str) -> list[str]:
    out: list[str] = []
    left = dict(needs)
    while left:
        ready = [n for n, others in left.items() if not (others & left.keys())]
        if not ready:
            raise SchemaError(f"{what} depend on each other in a cycle: {' -> '.join(sorted(left))}")
        out.append(ready[0])
        del left[ready[0]]
    return out


def dependencies(table: Table, f: Field) -> set[str]:
    """Fields of the same table that must be made first."""
    out: set[str] = set()
    if f.depends_on:
        out.add(f.depends_on)
    if f.type == "formula":
        out |= set(Formula(formula_text(f)).fields)
    if f.type == "lookup":
        out.add(f.get("via"))
    out |= {a.split(".", 1)[0] for a in f.anchors.values()}
    options = [f.params, *((f.get("when") or {}).get("cases") or {}).values()]
    out |= {o["correlate"]["field"] for o in options if isinstance(o, dict) and isinstance(o.get("correlate"), dict) and "field" in o["correlate"]}
    if f.get("when"):
        out.add(f.get("when")["field"])
    if f.references and f.references[0] == table.name:
        out.add(f.references[1])
    return out


def field_order(table: Table) -> list[Field]:
    return [table.field(n) for n in _sorted({f.name: dependencies(table, f) & set(table.names) for f in table.fields}, f"fields of {table.name}")]


def _table(raw: Any, i: int) -> Table:
    if not isinstance(raw, dict) or not isinstance(raw.get("name"), str) or not raw["name"]:
        raise SchemaError(f"table {i} needs a name")
    rows = raw.get("rows", raw.get("count"))
    if isinstance(rows, bool) or not isinstance(rows, int) or rows < 0:
        raise SchemaError(f"{raw['name']}: rows is a whole number from 0, not {rows!r}")
    fields = raw.get("fields")
    if isinstance(fields, dict):
        fields = [{"name": k, **(v if isinstance(v, dict) else {"type": v})} for k, v in fields.items()]
    if not isinstance(fields, list) or not fields:
        raise SchemaError(f"{raw['name']} needs a list of fields")
    return Table(raw["name"], rows, [_field(raw["name"], f, j) for j, f in enumerate(fields)])


def _field(table: str, raw: Any, i: int) -> Field:
    if not isinstance(raw, dict) or not isinstance(raw.get("name"), str) or not raw["name"]:
        raise SchemaError(f"{table}: field {i} needs a name")
    kind = str(raw.get("type", "")).lower()
    kind = ALIASES.get(kind, kind)
    if kind not in TYPES:
        raise SchemaError(f"{table}.{raw['name']}: unknown type {raw.get('type')!r}")
    return Field(raw["name"], kind, {k: v for k, v in raw.items() if k not in ("name", "type")})


def _bad(t: Table, f: Field, what: str) -> SchemaError:
    return SchemaError(f"{t.name}.{f.name}: {what}")


def weights(t: Table, f: Field, given: Any) -> dict:
    if isinstance(given, list):
        given = {str(k): 1.0 for k in given}
    if not isinstance(given, dict) or not given:
        raise _bad(t, f, "categories is a list or a mapping to weights")
    if not all(is_number(w) and w >= 0 for w in given.values()) or sum(given.values()) <= 0:
        raise _bad(t, f, "category weights are numbers from 0 with a positive sum")
    return given


def _check_numbers(t: Table, f: Field, params: dict) -> None:
    low, high = bounds(Field(f.name, f.type, params))
    if not is_number(low) or not is_number(high) or low > high:
        raise _bad(t, f, f"min {low!r} and max {high!r} aren't a range")
    if str(params.get("distribution") or "uniform") not in DISTRIBUTIONS:
        raise _bad(t, f, f"unknown distribution {params['distribution']!r}")
    for k in ("mean", "std", "scale"):
        if params.get(k) is not None and (not is_number(params[k]) or k != "mean" and params[k] <= 0):
            raise _bad(t, f, f"{k} is a number{'' if k == 'mean' else ' above 0'}")
    tie = params.get("correlate")
    if tie is not None:
        if not isinstance(tie, dict) or tie.get("field") in (None, f.name) or not t.has(str(tie.get("field"))):
            raise _bad(t, f, "correlate names another field of the table")
        if not is_number(tie.get("strength", 0.8)) or not 0 <= tie.get("strength", 0.8) <= 1 or tie.get("direction", "positive") not in ("positive", "negative"):
            raise _bad(t, f, "correlate has a strength from 0 to 1 and a direction positive or negative")


def bounds(f: Field) -> tuple[Any, Any]:
    return f.get("min", 0), f.get("max", 100 if f.type == "int" else 1)


def _check_alone(t: Table, f: Field) -> None:
    for k in ("null_rate", "true_rate"):
        if f.params.get(k) is not None and (not is_number(f.params[k]) or not 0 <= f.params[k] <= 1):
            raise _bad(t, f, f"{k} is a number from 0 to 1")
    if f.depends_on and (f.depends_on == f.name or not t.has(f.depends_on)):
        raise _bad(t, f, f"depends_on names no other field: {f.depends_on!r}")
    if f.type == "category":
        f.params["categories"] = weights(t, f, f.params.get("categories"))
    if f.type in ("int", "float"):
        _check_numbers(t, f, f.params)
    if f.type == "id" and (f.get("strategy", "sequential") not in ("sequential", "uuid") or isinstance(f.get("start", 1), bool) or not isinstance(f.get("start", 1), int)):
        raise _bad(t, f, "an id is sequential from a whole number, or uuid")
    if f.type in ("date", "datetime") and window(f)[1] < window(f)[0]:
        raise _bad(t, f, "end is before start")
    if f.type == "formula":
        for name in Formula(formula_text(f)).fields:
            if name == f.name or not t.has(name):
                raise _bad(t, f, f"its formula names no other field: {name!r}")


def _check_related(s: Schema, t: Table, f: Field) -> None:
    if f.type == "foreign_key":
        if not f.references or not s.has(f.references[0]) or not s.table(f.references[0]).has(f.references[1]):
            raise _bad(t, f, f"it references no column: {f.get('references')!r}")
        parent, own = s.table(f.references[0]), f.references[0] == t.name
        if own and f.references[1] == f.name:
            raise _bad(t, f, "it references itself")
        if parent.rows == 0 and t.rows:
            raise _bad(t, f, f"{parent.name} has no rows")
        if f.unique and (own or t.rows > parent.rows):
            raise _bad(t, f, "a unique key needs as many parents as rows, in another table")
        if f.get("skew", "uniform") not in ("uniform", "zipf") or not is_number(f.get("zipf_s", 1.1)) or f.get("zipf_s", 1.1) <= 0:
            raise _bad(t, f, "skew is uniform or zipf, with zipf_s above 0")
        least = f.get("min_per_parent", 0)
        if isinstance(least, bool) or not isinstance(least, int) or least < 0:
            raise _bad(t, f, "min_per_parent is a whole number from 0")
        if least and (own or f.unique):
            raise _bad(t, f, "min_per_parent goes with neither a self reference nor unique")
        if own and f.get("skew", "uniform") != "uniform":
            raise _bad(t, f, "a self reference has no skew")
        if least * parent.rows > t.rows:
            raise _bad(t, f, f"{least} for each of {parent.rows} parents is more than {t.rows} rows")
    if f.type == "lookup":
        via = f.get("via")
        if not via or not t.has(via) or not t.field(via).references:
            raise _bad(t, f, f"via names no foreign key: {via!r}")
        parent_name, key = t.field(via).references
        parent = s.table(parent_name) if s.has(parent_name) else None
        if parent is None or not parent.has(str(f.get("column"))):
            raise _bad(t, f, f"column names no column of {parent_name}: {f.get('column')!r}")
        if not is_key(parent.field(key)):
            raise _bad(t, f, f"{parent_name}.{key} isn't unique")
        if parent_name == t.name and f.get("column") == f.name:
            raise _bad(t, f, "it copies itself")
    if f.get("when") is not None:
        _check_when(t, f)
    for option, name in f.anchors.items():
        fk, other = s.anchor(t, name)
        if other.type not in ("date", "datetime") or fk is None and other.name == f.name:
            raise _bad(t, f, f"{option} names no other date: {name!r}")
        if f.unique or fk is not None and fk.references[0] == t.name:
            raise _bad(t, f, f"{option} goes with neither unique nor a self reference")
    for k in ("min_days", "max_days"):
        if f.params.get(k) is not None and (not is_number(f.params[k]) or f.params[k] < 0 or "after" not in f.anchors):
            raise _bad(t, f, f"{k} is a number from 0 that goes with after")
    if f.get("min_days", 0) > f.get("max_days", f.get("min_days", 0)):
        raise _bad(t, f, "min_days is above max_days")


def is_key(f: Field) -> bool:
    return f.unique or f.type in ("id", "uuid")


def _check_when(t: Table, f: Field) -> None:
    when = f.get("when")
    if f.type not in OVERRIDES or f.unique:
        raise _bad(t, f, "when goes with int, float, category and bool that aren't unique")
    if not isinstance(when, dict) or not t.has(str(when.get("field"))) or not isinstance(when.get("cases"), dict) or not when["cases"]:
        raise _bad(t, f, "when has a field of the table and cases")
    key = t.field(when["field"])
    if key.type not in ("category", "bool"):
        raise _bad(t, f, "the field of when is a category or bool")
    when["cases"] = {str(k): v for k, v in when["cases"].items()}
    labels = {str(k) for k in key.get("categories")} | {str(c) for v in ((key.get("when") or {}).get("cases") or {}).values() for c in (v.get("categories") or ())} if key.type == "category" else {"true", "false"}
    for label, extra in when["cases"].items():
        if (label.lower() if key.type == "bool" else label) not in labels:
            raise _bad(t, f, f"{key.name} has no value {label!r}")
        if not isinstance(extra, dict) or not extra or set(extra) - OVERRIDES[f.type]:
            raise _bad(t, f, f"the case {label!r} sets what it can't")
        if f.type == "category":
            extra["categories"] = weights(t, f, extra.get("categories"))
        elif f.type == "bool":
            if not is_number(extra.get("true_rate")) or not 0 <= extra["true_rate"] <= 1:
                raise _bad(t, f, "true_rate is a number from 0 to 1")
        else:
            _check_numbers(t, f, {**f.params, **extra})


def capacity(f: Field) -> int | None:
    """How many different values it can have; None: no bound that matters."""
    if f.type == "int":
        low, high = bounds(f)
        return max(0, int(high // 1) - int(-(-low // 1)) + 1)
    if f.type == "float" and f.params.get("round") is not None:
        low, high = bounds(f)
        return int(round((high - low) * 10 ** int(f.get("round")))) + 1
    if f.type == "category":
        return len(f.get("categories"))
    if f.type == "date":
        return (window(f)[1].date() - window(f)[0].date()).days + 1
    return pools.SIZES.get(f.type)


def _check_capacity(s: Schema, t: Table, f: Field) -> None:
    if f.unique and f.type != "foreign_key" and (n := capacity(f)) is not None and n < t.rows:
        raise _bad(t, f, f"{t.rows} unique values are asked for; there are {n}")


def window(f: Field) -> tuple[dt.datetime, dt.datetime]:
    """The declared or default window of a date; a datetime's last day counts whole."""
    where = f.name
    start = moment(f.get("start", FIRST_DAY), where)
    given = f.get("end", LAST_DAY)
    end = moment(given, where)
    if f.type == "datetime" and end.time() == dt.time() and ":" not in str(given if not isinstance(given, dt.datetime) else ""):
        end = end.replace(hour=23, minute=59, second=59)
    return start, end


def _check_times(s: Schema) -> None:
    """Anchored dates must have room: the possible range of each follows from those it depends on."""
    memo: dict[tuple[str, str], tuple[dt.datetime, dt.datetime]] = {}

    def span(t: Table, f: Field, stack: tuple = ()) -> tuple[dt.datetime, dt.datetime]:
        key = (t.name, f.name)
        if key in stack:
            raise _bad(t, f, "its anchors depend on each other in a cycle")
        if key not in memo:
            low, high = (moment(f.params["start"]) if f.params.get("start") is not None else None), (window(f)[1] if f.params.get("end") is not None else None)
            day = dt.timedelta(days=1)
            if not f.anchors:
                low, high = window(f)
            if "after" in f.anchors:
                fk, other = s.anchor(t, f.anchors["after"])
                a, b = span(s.table(fk.references[0]) if fk else t, other, (*stack, key))
                least = a + day * f.get("min_days", 0)
                if least > (high or least):
                    raise _bad(t, f, "no date is after its anchor and before its end")
                low = max(low or least, least)
                most = b + day * f.get("max_days", OPEN_DAYS)
                high = min(high, most) if high is not None and f.params.get("max_days") is not None else high or most
            if "before" in f.anchors:
                fk, other = s.anchor(t, f.anchors["before"])
                a, b = span(s.table(fk.references[0]) if fk else t, other, (*stack, key))
                high = min(high or b, b)
                low = low or a - day * OPEN_DAYS
                if low > high:
                    raise _bad(t, f, "no date is after its start and before its anchor")
            memo[key] = low, high
        return memo[key]

    for t in s.tables:
        for f in t.fields:
            if f.type in ("date", "datetime"):
                span(t, f)
