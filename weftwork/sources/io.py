"""Reading tables from folders, CSV, JSON lines and SQLite, and writing them."""

from __future__ import annotations

import json
import sqlite3
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.errors import ExportError, LoadError
from weftwork.operators.validate import Check, Report, orphans, validate
from weftwork.plans.generate import Dataset
from weftwork.plans.schema import Field, Schema, Table, is_key, load_schema

FORMATS = ("csv", "jsonl", "parquet", "sqlite")
BATCH = 5000


@dataclass
class RawData:
    """Untyped tables as read; kind says from what."""

    tables: dict[str, DataFrame]
    kind: str
    path: str
    rows: dict[str, int] = field(default_factory=dict)

    def names(self) -> list[str]:
        return list(self.tables)


def _hadoop(spark: SparkSession, uri: str):
    """(file system, path) of a URI on any store that Spark can read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _listed(where: str, spark: SparkSession) -> list[tuple[str, str]]:
    """(name, path or URI) of what a folder holds, by name."""
    if "://" not in where:
        return sorted((p.name, str(p)) for p in Path(where).iterdir())
    system, path = _hadoop(spark, where)
    return sorted((x.getPath().getName(), x.getPath().toString()) for x in system.listStatus(path))


def _is_folder(where: str, spark: SparkSession) -> bool:
    if "://" not in where:
        return Path(where).is_dir()
    system, path = _hadoop(spark, where)
    return system.exists(path) and system.getFileStatus(path).isDirectory() and not where.rstrip("/").endswith(".csv")


def load_raw(path: str | Path, spark: SparkSession) -> RawData:
    """Tables of a folder (a path, or a URI on a shared store), a CSV file or, on this machine, a SQLite file."""
    where = str(path).rstrip("/")
    name = where.rsplit("/", 1)[-1]
    stem, _, kind = name.rpartition(".")
    if _is_folder(where, spark):
        return _folder(where, spark)
    if kind.lower() in ("db", "sqlite", "sqlite3") and Path(where).is_file():
        return RawData(read_sqlite(where, spark), "sqlite", str(path))
    if kind.lower() == "csv" and ("://" in where or Path(where).is_file()):
        return RawData({stem: read_csv(where, spark)}, "csv", str(path))
    raise LoadError(f"{path} is neither a folder, a SQLite file nor a CSV file")


def _folder(where: str, spark: SparkSession) -> RawData:
    found = _listed(where, spark)
    csv = {n.removesuffix(".csv"): p for n, p in found if n.endswith(".csv")}
    lines = {n.removesuffix(".jsonl"): p for n, p in found if n.endswith(".jsonl") and not n.endswith(".chat.jsonl") and n.removesuffix(".jsonl") not in csv}
    if not csv and not lines:
        raise LoadError(f"{where} has neither CSV nor JSON line files")
    tables = {k: read_csv(p, spark) for k, p in csv.items()} | {k: read_jsonl(p, spark) for k, p in lines.items()}
    return RawData(tables, "+".join((["csv"] if csv else []) + (["jsonl"] if lines else [])), where)


def read_csv(path: str | Path, spark: SparkSession) -> DataFrame:
    """All columns as text; empty cells are null."""
    return spark.read.csv(str(path), header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")


def read_jsonl(path: str | Path, spark: SparkSession) -> DataFrame:
    """An object on each line; columns in the order in which they first appear."""
    text = spark.read.text(str(path)).where(F.trim("value") != "").select(F.col("value").alias("line"))
    first_bad = text.where(~F.trim("line").rlike(r"(?s)^\{.*\}$")).limit(1).collect()
    if first_bad:
        raise LoadError(f"{path}: a line is no object: {first_bad[0][0][:60]!r}")
    try:
        df = spark.read.option("mode", "FAILFAST").json(str(path))
        names = df.columns
    except Exception as e:
        raise LoadError(f"{path} can't be read: {str(e)[:200]}") from e
    keys = text.select(F.posexplode(F.json_object_keys("line")), F.monotonically_increasing_id().alias("row")).groupBy("col").agg(F.min(F.struct("row", "pos")).alias("at")).orderBy("at").collect()
    order = [r["col"] for r in keys if r["col"] in names]
    return df.select(*(F.col(f"`{c}`") for c in order))


def read_sqlite(path: str | Path, spark: SparkSession) -> dict[str, DataFrame]:
    """Each table as text columns, in the order of row ids; rows go to Spark in batches."""
    out = {}
    try:
        with sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro", uri=True) as con:
            names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY rowid")]
            for name in names:
                quoted = '"' + name.replace('"', '""') + '"'
                cursor = con.execute(f"SELECT * FROM {quoted} ORDER BY rowid")
                schema = ", ".join(f"`{c[0].replace('`', '``')}` string" for c in cursor.description)
                df = spark.createDataFrame([], schema)
                while rows := cursor.fetchmany(BATCH * 20):
                    df = df.unionByName(spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], schema))
                out[name] = df
    except sqlite3.DatabaseError as e:
        raise LoadError(f"{path} can't be read: {e}") from e
    if not out:
        raise LoadError(f"{path} has no tables")
    return out


def converted(schema: Schema, t: Table, f: Field, raw: Column) -> Column:
    """A text as the field's type; null where it can't be."""
    kind, text = schema.spark_type(t, f), F.trim(raw)
    if kind == "bigint":
        return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), F.when(text.rlike(r"^[+-]?\d+\.0*$"), text.try_cast("double").cast("bigint")))
    if kind == "double":
        return text.try_cast("double")
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "1", "yes", "t", "y"), True).when(low.isin("false", "0", "no", "f", "n"), False)
    if kind in ("date", "timestamp_ntz"):
        return text.try_cast(kind)
    return raw


def coerce(raw: RawData, schema: Schema) -> Dataset:
    """Typed tables: missing ones are empty, missing columns null; texts that don't convert stay in hidden columns for the type check."""
    spark = SparkSession.getActiveSession()
    out = {}
    for t in schema.tables:
        df = raw.tables.get(t.name)
        if df is None:
            df = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in t.names))
        df = df.select(*(F.col(f"`{n}`").cast("string").alias(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in t.names))
        typed = [converted(schema, t, f, F.col(f.name)).alias(f.name) for f in t.fields]
        kept = [F.col(f.name).alias(f"__raw_{f.name}") for f in t.fields if schema.spark_type(t, f) != "string"]
        out[t.name] = df.select(*typed, *kept)
    return Dataset(schema, out)


def load_dataset(path: str | Path, schema: Schema | dict | str, spark: SparkSession) -> Dataset:
    return coerce(load_raw(path, spark), load_schema(schema))


def validate_data(schema: Schema | dict | str, path: str | Path, spark: SparkSession, *, tolerance: float = 0.05) -> Report:
    """The files' columns against the schema, then all checks of their rows."""
    schema, raw, report = load_schema(schema), load_raw(path, spark), Report()
    for t in schema.tables:
        have = raw.tables[t.name].columns if t.name in raw.tables else None
        missing = t.names if have is None else [n for n in t.names if n not in have]
        extra = [c for c in have or [] if c not in t.names]
        detail = "no such table" if have is None else f"missing: {missing}, besides: {extra}"
        report.checks.append(Check("columns", t.name, None, not missing, detail, len(missing)))
    report.checks += validate(coerce(raw, schema), tolerance=tolerance).checks
    return report


def export_dataset(data: Dataset, out: str | Path, formats: list[str] | str = "csv", *, basename: str = "data", single: bool = True) -> dict[str, list[str]]:
    """Writes all tables in each format; the paths by format. single: one file a table for CSV and JSON lines, written by the driver; else, and always on a URI, Spark's folders of part files."""
    formats = [formats] if isinstance(formats, str) else list(formats)
    for f in formats:
        if f not in FORMATS:
            raise ExportError(f"unknown format {f!r}; there are {', '.join(FORMATS)}")
    where = str(out).rstrip("/")
    remote = "://" in where
    if remote and "sqlite" in formats:
        raise ExportError("a SQLite file can't be written to a URI")
    if not remote:
        Path(where).mkdir(parents=True, exist_ok=True)
    paths: dict[str, list[str]] = {f: [] for f in formats}
    for f in formats:
        if f == "sqlite":
            paths[f].append(write_sqlite(data, Path(where) / f"{basename}.db"))
            continue
        for t in data.schema.tables:
            df, target = data[t.name].select(*t.names), f"{where}/{t.name}.{f}"
            if f == "parquet":
                df.write.mode("overwrite").parquet(target)
            elif remote or not single:
                (_shown(df).write.mode("overwrite").csv(target, header=True, escape='"') if f == "csv" else jsonl_text(df).write.mode("overwrite").text(target))
            elif f == "csv":
                _one_csv(df, Path(target))
            else:
                write_jsonl(df, target)
            paths[f].append(target)
    return paths


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if k == "timestamp_ntz" else F.col(c) for c, k in df.dtypes))


def _one_csv(df: DataFrame, path: Path) -> None:
    import csv

    shown = _shown(df)
    with path.open("w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(df.columns)
        for row in shown.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])


def jsonl_text(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}).alias("value"))


def write_jsonl(df: DataFrame, path: str | Path) -> int:
    """One JSON object a line; nulls and letters beyond ASCII stay as they are."""
    where = Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with where.open("w", encoding="utf-8") as file:
        for row in jsonl_text(df).toLocalIterator():
            file.write(row[0] + "\n")
            n += 1
    return n


def sqlite_type(schema: Schema, t: Table, f: Field) -> str:
    return {"bigint": "INTEGER", "double": "REAL", "boolean": "INTEGER"}.get(schema.spark_type(t, f), "TEXT")


def write_sqlite(data: Dataset, path: str | Path) -> str:
    """Tables with their keys and foreign keys, parents first; ExportError if a key has no parent."""
    where, schema, quote = Path(path), data.schema, lambda n: '"' + n.replace('"', '""') + '"'
    where.unlink(missing_ok=True)
    linked: dict[tuple[str, str], bool] = {}
    for t in schema.order():
        for f in t.fields:
            if f.references:
                parent, key = f.references
                column = data[parent].select(F.col(key).alias("k"))
                repeats, _ = column.agg(F.count("k") - F.count_distinct("k"), F.count("*")).first()
                linked[t.name, f.name] = not repeats
                if repeats:
                    warnings.warn(f"{parent}.{key} repeats, so {t.name}.{f.name} has no foreign key in SQLite", stacklevel=2)
                elif bad := orphans(data[t.name], f.name, data[parent], key).limit(1).collect():
                    raise ExportError(f"{t.name}.{f.name}: {bad[0][f.name]!r} isn't in {parent}.{key}")
    targets = {schema.table(t).field(f).references for (t, f), ok in linked.items() if ok}
    with sqlite3.connect(where) as con:
        con.execute("PRAGMA foreign_keys = OFF")
        for t in schema.order():
            primary = next((f.name for f in t.fields if f.type == "id"), None)
            lines = []
            for f in t.fields:
                line = f"{quote(f.name)} {sqlite_type(schema, t, f)}"
                line += " PRIMARY KEY" if f.name == primary else " UNIQUE" if is_key(f) or (t.name, f.name) in targets else ""
                lines.append(line)
            lines += [f"FOREIGN KEY ({quote(f.name)}) REFERENCES {quote(f.references[0])} ({quote(f.references[1])})" for f in t.fields if linked.get((t.name, f.name))]
            con.execute(f"CREATE TABLE {quote(t.name)} ({', '.join(lines)})")
            insert = f"INSERT INTO {quote(t.name)} VALUES ({', '.join('?' * len(t.fields))})"
            batch = []
            for row in data[t.name].select(*t.names).toLocalIterator():
                batch.append([_cell(v) for v in row])
                if len(batch) >= BATCH:
                    con.executemany(insert, batch)
                    batch = []
            con.executemany(insert, batch)
            for f in t.fields:
                if f.references:
                    con.execute(f"CREATE INDEX {quote(f'ix_{t.name}_{f.name}')} ON {quote(t.name)} ({quote(f.name)})")
        con.commit()
        if wrong := con.execute("PRAGMA foreign_key_check").fetchall():
            raise ExportError(f"{len(wrong)} keys have no parent, such as in {wrong[0][0]}")
    return str(where)


def _cell(v):
    if isinstance(v, bool):
        return int(v)
    if v is None or isinstance(v, (int, float, str)):
        return v
    return str(v) if not isinstance(v, (list, dict, tuple)) else json.dumps(v, ensure_ascii=False, default=str)


INSTRUCTIONS = {
    "paraphrase": "Say the same in other words.", "persona": "Describe a person who could exist.", "review": "Write a review of the product.", "ticket": "Write a support ticket.",
}


def chat_messages(df: DataFrame, *, system: str | None = None, include_context: bool = False, keep: tuple | list = ()) -> DataFrame:
    """(keep, messages): each record as a conversation, by its shape: question and answer, text and label, known kinds, else its JSON."""
    has = lambda *names: all(n in df.columns for n in names)
    text = lambda n: F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user, answer, teach = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    rest = F.to_json(F.struct(*df.columns)) if df.columns else F.lit("{}")
    user, answer = F.lit("Write a record."), F.coalesce(text("text"), rest)
    if has("text", "kind"):
        for kind, says in INSTRUCTIONS.items():
            about = F.concat_ws(" ", F.lit(says), *(F.concat(F.lit(f"{c}: "), text(c), F.lit(".")) for c in ("intent", "context", "product", "sentiment", "category", "tone") if c in df.columns))
            user = F.when(F.col("kind") == kind, about).otherwise(user)
    if has("text", "label"):
        user, answer = F.when(F.col("label").isNotNull(), text("text")).otherwise(user), F.when(F.col("label").isNotNull(), text("label")).otherwise(answer)
        teach = F.when(F.col("label").isNotNull(), F.lit("Give the label of the text.")).otherwise(teach)
    if has("question", "answer"):
        asked = F.concat_ws("\n\n", text("context"), text("question")) if include_context else text("question")
        both = F.col("question").isNotNull() & F.col("answer").isNotNull()
        user, answer, teach = F.when(both, asked).otherwise(user), F.when(both, text("answer")).otherwise(answer), F.when(both, F.lit(None)).otherwise(teach)
    lead = F.lit(system) if system else teach
    pair = F.array(message("user", user), message("assistant", answer))
    return df.select(*keep, F.when(lead.isNotNull(), F.concat(F.array(message("system", lead)), pair)).otherwise(pair).alias("messages"))


def to_chat_jsonl(df: DataFrame, path: str | Path, **options) -> int:
    return write_jsonl(chat_messages(df, **options), path)
