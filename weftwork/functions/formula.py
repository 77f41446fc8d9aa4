"""Row formulas: a small safe expression language, compiled to one typed Column without a UDF."""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.errors import FormulaError

MOST_CHARS, MOST_NODES = 2000, 400
NUMBERS = ("bigint", "double")
FUNCTIONS = {"round", "min", "max", "abs", "int", "float", "str", "len", "sqrt", "log", "exp", "floor", "ceil", "pow", "coalesce", "is_null", "year", "month", "day", "weekday", "days_between", "hours_between"}
_NODES = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.IfExp, ast.Call, ast.Name, ast.Constant, ast.Load, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)
_OPERATORS = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow, ast.UAdd, ast.USub, ast.Not, ast.And, ast.Or, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE)


@dataclass
class Typed:
    """A column and its type: bigint, double, string, boolean, date, timestamp or null."""

    col: Column
    kind: str


def family(spark_type: str) -> str:
    """The formula type of a Spark type."""
    name = spark_type.lower()
    if name in ("tinyint", "smallint", "int", "bigint", "byte", "short", "integer", "long"):
        return "bigint"
    if name.startswith("decimal") or name in ("float", "double"):
        return "double"
    return {"timestamp_ntz": "timestamp", "void": "null"}.get(name, name)


class Formula:
    """A parsed formula; names that aren't functions are the fields it needs."""

    def __init__(self, source: str):
        self.source = source
        if not isinstance(source, str) or not source.strip() or len(source) > MOST_CHARS:
            raise FormulaError(f"a formula is a text of 1 to {MOST_CHARS} characters")
        try:
            self.tree = ast.parse(source.strip(), mode="eval")
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            raise FormulaError(f"{source!r} isn't an expression: {e}") from e
        nodes = list(ast.walk(self.tree))
        if len(nodes) > MOST_NODES:
            raise FormulaError(f"{source[:40]!r} has more than {MOST_NODES} parts")
        for node in nodes:
            if not isinstance(node, _NODES) or isinstance(node, (ast.operator, ast.unaryop, ast.boolop, ast.cmpop)) and not isinstance(node, _OPERATORS):
                raise FormulaError(f"{type(node).__name__} isn't allowed in {source!r}")
            if isinstance(node, ast.Constant) and (isinstance(node.value, (bytes, complex)) or node.value is None or node.value is ...):
                raise FormulaError(f"{node.value!r} isn't allowed in {source!r}")
            if isinstance(node, ast.Call) and (not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS or node.keywords):
                raise FormulaError(f"a call in {source!r} isn't allowed")
        called = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
        self.fields = sorted({n.id for n in nodes if isinstance(n, ast.Name) and id(n) not in called})

    def compile(self, fields: dict[str, str], where: str = "formula", column=F.col) -> Typed:
        """The Column over fields (name -> Spark type); errors at run time name `where`."""
        return _Compiler({k: Typed(column(k), family(v)) for k, v in fields.items()}, where)(self.tree.body)


class _Compiler:
    def __init__(self, fields: dict[str, Typed], where: str):
        self.fields, self.where = fields, where

    def fail(self, what: str) -> Column:
        return F.raise_error(F.lit(f"{self.where}: {what}"))

    def guard(self, bad: Column, good: Column, what: str) -> Column:
        return F.when(bad, self.fail(what)).otherwise(good)

    def __call__(self, node: ast.AST) -> Typed:
        return getattr(self, f"on_{type(node).__name__.lower()}")(node)

    def on_constant(self, node) -> Typed:
        value = node.value
        kind = "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
        if kind == "bigint" and abs(value) >= 1 << 63:
            raise FormulaError(f"{self.where}: {value} is too large")
        return Typed(F.lit(value).cast(kind), kind)

    def on_name(self, node) -> Typed:
        if node.id not in self.fields:
            raise FormulaError(f"{self.where}: unknown field {node.id!r}")
        return self.fields[node.id]

    def number(self, x: Typed) -> Typed:
        if x.kind == "boolean":
            return Typed(x.col.cast("bigint"), "bigint")
        if x.kind not in NUMBERS:
            raise FormulaError(f"{self.where}: a number is needed, not {x.kind}")
        return x

    def truth(self, x: Typed) -> Column:
        """Whether it counts as true; null stays null."""
        return x.col if x.kind == "boolean" else x.col != (F.lit("") if x.kind == "string" else F.lit(0)) if x.kind in (*NUMBERS, "string") else F.when(x.col.isNotNull(), F.lit(True))

    def on_unaryop(self, node) -> Typed:
        x = self(node.operand)
        if isinstance(node.op, ast.Not):
            return Typed(~self.truth(x), "boolean")
        x = self.number(x)
        return Typed(-x.col if isinstance(node.op, ast.USub) else x.col, x.kind)

    def on_binop(self, node) -> Typed:
        a, b, op = self(node.left), self(node.right), type(node.op)
        if op is ast.Add and a.kind == b.kind == "string":
            return Typed(F.concat(a.col, b.col), "string")
        if op is ast.Mult and "string" in (a.kind, b.kind):
            text, times = (a, self.number(b)) if a.kind == "string" else (b, self.number(a))
            return Typed(self.guard(F.length(text.col) * times.col > 10_000, F.repeat(text.col, F.greatest(times.col, F.lit(0)).cast("int")), "a text is too long"), "string")
        a, b = self.number(a), self.number(b)
        kind = "bigint" if a.kind == b.kind == "bigint" else "double"
        if op in (ast.Add, ast.Sub, ast.Mult):
            return Typed({ast.Add: a.col + b.col, ast.Sub: a.col - b.col, ast.Mult: a.col * b.col}[op], kind)
        if op is ast.Pow:
            return self.whole(self.power(a, b), a, node.right)
        zero = b.col == 0
        if op is ast.Div:
            return Typed(self.guard(zero, a.col.cast("double") / F.when(~zero, b.col.cast("double")), "division by zero"), "double")
        below = F.when(~zero, b.col)
        if kind == "bigint":
            rest = a.col % below
            rest = F.when((rest != 0) & ((rest < 0) != (b.col < 0)), rest + b.col).otherwise(rest)
            whole = F.call_function("div", a.col - rest, below)
        else:
            whole = F.floor(a.col / below).cast("double")
            rest = a.col - below * whole
        return Typed(self.guard(zero, whole if op is ast.FloorDiv else rest, "division by zero"), kind)

    def whole(self, out: Typed, base: Typed, exponent: ast.AST) -> Typed:
        """A whole number to a constant exponent that isn't negative stays one."""
        known = isinstance(exponent, ast.Constant) and isinstance(exponent.value, int) and not isinstance(exponent.value, bool)
        return Typed(out.col.cast("bigint"), "bigint") if base.kind == "bigint" and known else out

    def power(self, a: Typed, b: Typed) -> Typed:
        bad = (a.col < 0) & (b.col != F.floor(b.col.cast("double"))) | (a.col == 0) & (b.col < 0)
        out = F.pow(a.col.cast("double"), b.col.cast("double"))
        return Typed(self.guard(bad | (F.abs(out) > 1e308), out, "a power has no finite real value"), "double")

    def on_boolop(self, node) -> Typed:
        parts = [self(v) for v in node.values]
        kinds = {p.kind for p in parts}
        both = isinstance(node.op, ast.And)
        if kinds == {"boolean"}:
            out = parts[0].col
            for p in parts[1:]:
                out = out & p.col if both else out | p.col
            return Typed(out, "boolean")
        kind = self.common(parts)
        out = parts[-1].col.cast(kind)
        stops = [~self.truth(p) if both else self.truth(p) for p in parts]
        # Kleene: an operand that decides is the value; else null if any is null; else the last.
        for p in reversed(parts[:-1]):
            out = F.when(p.col.isNull(), F.lit(None).cast(kind)).otherwise(out)
        for p, stop in reversed(list(zip(parts, stops, strict=True))):
            out = F.when(stop, p.col.cast(kind)).otherwise(out)
        return Typed(out, kind)

    def common(self, parts: list[Typed]) -> str:
        kinds = {p.kind for p in parts} - {"null"}
        if len(kinds) == 1:
            return kinds.pop()
        if kinds <= {*NUMBERS, "boolean"}:
            return "double" if "double" in kinds else "bigint"
        raise FormulaError(f"{self.where}: {' and '.join(sorted(kinds))} have no common type")

    def on_compare(self, node) -> Typed:
        out, parts = None, [self(node.left), *(self(c) for c in node.comparators)]
        for a, op, b in reversed(list(zip(parts, node.ops, parts[1:], strict=False))):
            a, b = self.comparable(a, b)
            one = {ast.Eq: a == b, ast.NotEq: a != b, ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}[type(op)]
            out = one if out is None else F.when(one.isNull(), F.lit(None).cast("boolean")).when(~one, F.lit(False)).otherwise(out)
        return Typed(out, "boolean")

    def comparable(self, a: Typed, b: Typed) -> tuple[Column, Column]:
        dates = {"date", "timestamp"}
        if a.kind in dates and b.kind == "string" or b.kind in dates and a.kind == "string":
            return self.moment(a), self.moment(b)
        if a.kind != b.kind and not {a.kind, b.kind} <= {*NUMBERS, "boolean"} and "null" not in (a.kind, b.kind) and not {a.kind, b.kind} <= dates:
            raise FormulaError(f"{self.where}: {a.kind} and {b.kind} can't be compared")
        return (a.col.cast("bigint") if a.kind == "boolean" and b.kind != "boolean" else a.col), (b.col.cast("bigint") if b.kind == "boolean" and a.kind != "boolean" else b.col)

    def on_ifexp(self, node) -> Typed:
        test, x, y = self(node.test), self(node.body), self(node.orelse)
        kind = self.common([x, y])
        return Typed(F.when(test.col.isNull(), F.lit(None).cast(kind)).when(self.truth(test), x.col.cast(kind)).otherwise(y.col.cast(kind)), kind)

    def moment(self, x: Typed) -> Column:
        return x.col.cast("timestamp_ntz")

    def on_call(self, node) -> Typed:
        name, args = node.func.id, [self(a) for a in node.args]
        low, high = {"min": (2, 99), "max": (2, 99), "coalesce": (1, 99), "round": (1, 2), "log": (1, 2), "pow": (2, 3), "days_between": (2, 2), "hours_between": (2, 2)}.get(name, (1, 1))
        if not low <= len(args) <= high:
            raise FormulaError(f"{self.where}: {name} takes {low} to {high} arguments")
        if name == "coalesce":
            kind = self.common(args)
            return Typed(F.coalesce(*(a.col.cast(kind) for a in args)), kind)
        if name == "is_null":
            return Typed(args[0].col.isNull(), "boolean")
        missing = args[0].col.isNull()
        for a in args[1:]:
            missing = missing | a.col.isNull()
        out = self.plain(name, args)
        if name == "pow" and len(args) == 2:
            out = self.whole(out, args[0], node.args[1])
        return Typed(F.when(~missing, out.col), out.kind)

    def plain(self, name: str, args: list[Typed]) -> Typed:
        x = args[0]
        if name in ("min", "max"):
            kind = self.common(args)
            return Typed((F.least if name == "min" else F.greatest)(*(a.col.cast(kind) for a in args)), kind)
        if name == "str":
            return Typed(F.when(x.col, "True").otherwise("False") if x.kind == "boolean" else x.col.cast("string"), "string")
        if name == "len":
            if x.kind != "string":
                raise FormulaError(f"{self.where}: len takes a text")
            return Typed(F.length(x.col).cast("bigint"), "bigint")
        if name in ("int", "float"):
            return Typed(F.trim(x.col).cast("bigint" if name == "int" else "double") if x.kind == "string" else x.col.cast("bigint" if name == "int" else "double"), "bigint" if name == "int" else "double")
        if name in ("year", "month", "day", "weekday"):
            day = x.col.cast("date")
            return Typed({"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": F.weekday}[name](day).cast("bigint"), "bigint")
        if name == "days_between":
            return Typed(F.datediff(args[1].col.cast("date"), x.col.cast("date")).cast("bigint"), "bigint")
        if name == "hours_between":
            return Typed(F.timestamp_diff("SECOND", self.moment(x), self.moment(args[1])) / F.lit(3600.0), "double")
        x = self.number(x)
        if name == "round":
            if len(args) == 1:
                return Typed(F.bround(x.col, 0).cast("bigint"), "bigint")
            return Typed(F.call_function("bround", x.col, args[1].col.cast("int")).cast(x.kind), x.kind)
        if name == "abs":
            return Typed(F.abs(x.col), x.kind)
        if name in ("floor", "ceil"):
            return Typed((F.floor if name == "floor" else F.ceil)(x.col).cast("bigint"), "bigint")
        if name == "sqrt":
            return Typed(self.guard(x.col < 0, F.sqrt(x.col), "the root of a negative number"), "double")
        if name == "exp":
            return Typed(self.guard(x.col > 709, F.exp(x.col), "exp is too large"), "double")
        if name == "log":
            out, bad = F.log(F.when(x.col > 0, x.col.cast("double"))), x.col <= 0
            if len(args) == 2:
                base = self.number(args[1])
                out, bad = out / F.log(F.when((base.col > 0) & (base.col != 1), base.col.cast("double"))), bad | (base.col <= 0) | (base.col == 1)
            return Typed(self.guard(bad, out, "the logarithm isn't defined"), "double")
        out = self.power(x, self.number(args[1]))  # pow
        if len(args) == 3:
            by = self.number(args[2]).col
            out = Typed(out.col - by * F.floor(out.col / by), "double")
        return out
