"""The command line: generate, validate, infer and report. Exit codes: 0 good, 1 a fault or a failed check, 2 no key, 3 a request that the cassette lacks."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftwork.errors import MissingKey, ReplayMiss, WeftError
from weftwork.operators import profile, records
from weftwork.operators.validate import Report, distribution_report, render_distribution, validate
from weftwork.plans import questions, texts
from weftwork.plans.calls import Calls, RecordedCalls, ReplayedCalls
from weftwork.plans.generate import generate
from weftwork.plans.schema import Schema
from weftwork.sources import io
from weftwork.sources.client import HttpClient

Make = Callable[[], SparkSession]


def session() -> SparkSession:
    """The running session, or one on this machine."""
    os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])
    made = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def _verdict(report: Report) -> int:
    print(report.render())
    return 0 if report.ok else 1


def _tabular(a: argparse.Namespace, spark: Make) -> int:
    schema = Schema.from_yaml(a.schema)
    data = generate(schema, spark(), seed=a.seed).staged()
    written = io.export_dataset(data, a.out, [f.strip() for f in a.format.split(",") if f.strip()], basename=a.basename)
    for name, n in data.row_counts().items():
        print(f"{name}: {n} rows")
    print("\n".join(p for paths in written.values() for p in paths))
    return _verdict(validate(data)) if a.validate else 0


def _calls(a: argparse.Namespace, spark: SparkSession) -> Calls:
    if a.record and a.replay:
        raise WeftError("--record and --replay exclude each other")
    if a.replay:
        return ReplayedCalls(a.replay, spark)
    client = HttpClient()
    return RecordedCalls(client, a.record) if a.record else Calls(client)


def _written(a: argparse.Namespace, out: DataFrame, calls: Calls) -> None:
    print(f"{io.write_jsonl(out, a.out)} records in {a.out}")
    if a.chat:
        io.to_chat_jsonl(out, a.chat, system=a.chat_system, include_context=getattr(a, "with_context", False))
        print(f"conversations in {a.chat}")
    if isinstance(calls, RecordedCalls):
        print(f"{calls.made} requests recorded in {a.record}")
    elif isinstance(calls, ReplayedCalls):
        print(f"{calls.made} requests replayed from {a.replay}, {calls.remaining} answers left")


def _text(a: argparse.Namespace, spark: Make) -> int:
    config = texts.load_task(a.task)
    if a.dry_run:
        print(texts.plan_text(config, spark()).render())
        return 0
    calls = _calls(a, spark())
    result = texts.run_text(config, calls, spark())
    _written(a, result.records, calls)
    print(f"{result.requests} chat requests; repeats by: {result.dedup}")
    if result.group in ("label", "sentiment", "category"):
        print(f"{result.group}: " + ", ".join(f"{r[0]}={r['n']}" for r in records.label_histogram(result.records, result.group).collect()))
    if result.shortfall:
        print("below quota: " + ", ".join(f"{g} {result.quotas[g] - n}/{result.quotas[g]}" for g, n in result.shortfall.items()))
    return _verdict(records.validate_records(result.records, config["task"].lower(), quotas=result.quotas)) if a.validate else 0


def _qa(a: argparse.Namespace, spark: Make) -> int:
    config, base = texts.load_task(a.task), os.path.dirname(os.path.abspath(a.task))
    if a.dry_run:
        print(questions.plan_qa(config, spark(), base).render())
        return 0
    calls = _calls(a, spark())
    r = questions.run_qa(config, calls, spark(), base)
    _written(a, r.records, calls)
    print(f"{r.chunks} chunks, {r.candidates} questions: {r.duplicates} repeated, {r.unanswerable} unanswerable, {r.low_quality} below the least quality; {r.requests} requests")
    average = records.average_quality(r.records)
    if average is not None:
        print(f"mean quality: {average:.2f}")
    return _verdict(records.validate_records(r.records, "qa", min_quality=int(config.get("min_quality", 4)))) if a.validate else 0


def _validate(a: argparse.Namespace, spark: Make) -> int:
    schema = Schema.from_yaml(a.schema)
    if a.data:
        return _verdict(io.validate_data(schema, a.data, spark(), tolerance=a.tolerance))
    return _verdict(validate(generate(schema, spark(), seed=a.seed).staged(), tolerance=a.tolerance))


def _infer(a: argparse.Namespace, spark: Make) -> int:
    raw = io.load_raw(a.data, spark())
    found = profile.infer_schema(raw, rows_scale=a.rows_scale, min_category_count=a.min_category_count, seed=a.seed)
    Path(a.out).resolve().parent.mkdir(parents=True, exist_ok=True)
    Path(a.out).write_text(found.to_yaml(f"# From {a.data} ({raw.kind}); labels below {a.min_category_count} rows aren't listed; rows x {a.rows_scale}.\n"), encoding="utf-8")
    print(f"{len(found.schema.tables)} tables in {a.out}\n{found.summary()}")
    if not a.no_fidelity:
        print(profile.render_fidelity(profile.fidelity(raw, found.schema, generate(found.schema, spark()).staged().tables)))
    return 0


def _report(a: argparse.Namespace, spark: Make) -> int:
    print(render_distribution(distribution_report(generate(Schema.from_yaml(a.schema), spark(), seed=a.seed).staged())))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftwork", description="Synthetic tables from schemas, checks of data, schemas from data, texts from models.")
    commands = top.add_subparsers(required=True, dest="command")
    kinds = commands.add_parser("generate", help="make a dataset").add_subparsers(required=True, dest="kind")

    def add(to, name: str, run, about: str, *flags: tuple[str, dict]):
        p = to.add_parser(name, help=about)
        for flag, options in flags:
            p.add_argument(flag, **options)
        p.set_defaults(run=run)

    need, number, yes = {"required": True}, {"type": int}, {"action": "store_true"}
    model = (("--task", need), ("--out", need), ("--chat", {}), ("--chat-system", {}), ("--record", {}), ("--replay", {}), ("--dry-run", yes), ("--validate", yes))
    add(kinds, "tabular", _tabular, "tables from a schema", ("--schema", need), ("--out", {"default": "results"}), ("--format", {"default": "csv"}), ("--seed", number), ("--basename", {"default": "dataset"}), ("--validate", yes))
    add(kinds, "text", _text, "texts from a model, by quotas", *model)
    add(kinds, "qa", _qa, "questions and answers on documents", *model, ("--with-context", yes))
    add(commands, "validate", _validate, "check generated tables, or files", ("--schema", need), ("--data", {}), ("--seed", number), ("--tolerance", {"type": float, "default": 0.05}))
    add(commands, "infer", _infer, "a schema from data", ("--data", need), ("--out", need), ("--rows-scale", {"type": float, "default": 1.0}), ("--min-category-count", {"type": int, "default": 5}), ("--seed", {"type": int, "default": 42}), ("--no-fidelity", yes))
    add(commands, "report", _report, "what the fields of generated tables hold", ("--schema", need), ("--seed", number))
    return top


def main(argv: list[str] | None = None, spark: Make = session) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a, spark)
    except MissingKey as e:
        code, says = 2, e
    except ReplayMiss as e:
        code, says = 3, e
    except (WeftError, OSError) as e:
        code, says = 1, e
    print(f"error: {says}", file=sys.stderr)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
