"""Questions and answers from documents: chunks, questions, answers, wrong answers and marks, each step a table.

Steps follow one another over all chunks at once; every row carries its place (document, chunk, question), so that the
first of repeated questions is the one that stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.errors import WeftError
from weftwork.functions import replies
from weftwork.functions import text as T
from weftwork.operators.records import AXES
from weftwork.plans.calls import Calls, chat_request, failed
from weftwork.plans.texts import RequestPlan
from weftwork.sources.cassette import json_system
from weftwork.staging import stage

ASK = "You write questions for a reading test. They can be answered from the passage alone."
ANSWER = "You answer from the passage and nothing else."
MARK = "You mark question and answer pairs strictly; a mark is never higher than what you can justify."
NOT_THERE = "NOT_IN_PASSAGE"


@dataclass
class Options:
    questions_per_chunk: int = 2
    chunk_size: int = 700
    overlap: int = 100
    hard_negatives: bool = True
    min_quality: int = 4
    temperature: float = 0.7


@dataclass
class QAResult:
    records: DataFrame
    chunks: int
    candidates: int
    unanswerable: int
    low_quality: int
    duplicates: int
    requests: int


def options_of(config: dict) -> Options:
    return Options(**{k: type(v)(config[k]) for k, v in vars(Options()).items() if k in config})


def documents(config: dict, spark: SparkSession, base: str = ".") -> DataFrame:
    """(doc, text, source) of the task's docs: texts, {text, source} or {path}, relative to the task's file; files are read where they lie."""
    rows, paths = [], []
    for i, d in enumerate(config.get("docs") or []):
        if isinstance(d, str):
            rows.append((i, d, f"inline-{i}"))
        elif isinstance(d, dict) and "text" in d:
            rows.append((i, str(d["text"]), str(d.get("source", f"inline-{i}"))))
        elif isinstance(d, dict) and "path" in d:
            name = str(d["path"])
            where = name if "://" in name else (Path(base) / name).resolve().as_uri()
            paths.append((i, where, name.rstrip("/").rsplit("/", 1)[-1]))
        else:
            raise WeftError(f"docs[{i}] is neither a text nor has a text or a path")
    if not rows and not paths:
        raise WeftError("a qa task needs at least one document under 'docs'")
    out = spark.createDataFrame(rows, "doc long, text string, source string")
    for i, where, name in paths:
        read = spark.read.text(where, wholetext=True).select(F.lit(i).cast("long").alias("doc"), F.col("value").alias("text"), F.lit(name).alias("source"))
        out = out.unionByName(read)
    return out


def chunked(docs: DataFrame, o: Options) -> DataFrame:
    """(doc, source, chunk_index, chunk, place)"""
    cut = docs.select("doc", "source", F.posexplode(T.chunks(F.col("text"), o.chunk_size, o.overlap)).alias("chunk_index", "chunk"))
    return cut.withColumn("place", (F.shiftleft("doc", 40) + F.shiftleft(F.col("chunk_index").cast("long"), 8)))


def question_prompt(chunk: Column, n: int) -> Column:
    return F.concat(F.lit(f"Write {n} different questions that this passage answers, and no trivial ones. Reply with a JSON array of {n} strings.\n\nPassage:\n"), chunk)


def _asked(rows: DataFrame, calls: Calls, prompt: Column, **options) -> DataFrame:
    """rows with the response and error to the prompt of each; the place is the request's."""
    got = calls.answer(rows.select(*chat_request(F.col("place"), prompt, **options))).select(F.col("seq").alias("__seq"), "response", "error")
    return stage(rows.join(got, F.col("place") == F.col("__seq")).drop("__seq"), "asked")


def _parsed(rows: DataFrame, kind: str, n: int = 0) -> DataFrame:
    """rows with `found`, what is read from the response: questions, a wrong answer, or marks; null if the reply holds no JSON."""
    names = rows.columns

    def read(reply: str | None) -> list[str] | None:
        if reply is None:
            return None
        try:
            value = replies.extract_json(reply)
        except WeftError:
            return None
        if kind == "questions":
            return list(dict.fromkeys(replies.as_texts(value, ("questions", "question"))))[:n]
        if kind == "wrong":
            return [replies.as_text(value, ("hard_negative", "wrong_answer", "answer")).strip()]
        value = value[0] if isinstance(value, list) and value else value
        value = value["scores"] if isinstance(value, dict) and isinstance(value.get("scores"), dict) else value
        return [str(value.get(a, "")) if isinstance(value, dict) else "" for a in AXES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("response")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([read(x) for x in batch.column(at).to_pylist()], pa.list_(pa.string()))], [*names, "found"])

    return rows.mapInArrow(run, rows.withColumn("found", F.lit(None).cast("array<string>")).schema)


def _unreadable(rows: DataFrame) -> None:
    bad = rows.where("found is null").limit(1).collect()
    if bad:
        raise WeftError(f"no JSON in the reply {bad[0]['response'][:80]!r}")


def run_qa(config: dict, calls: Calls, spark: SparkSession, base: str = ".") -> QAResult:
    """Runs a qa task over its documents."""
    o = options_of(config)
    chunks = stage(chunked(documents(config, spark, base), o), "chunks")
    before = calls.made
    # Questions of each chunk.
    asked = _asked(chunks, calls, question_prompt(F.col("chunk"), o.questions_per_chunk), system=json_system(ASK), temperature=o.temperature)
    failed(asked.withColumnRenamed("place", "seq"))
    found = stage(_parsed(asked, "questions", o.questions_per_chunk), "questions")
    _unreadable(found)
    rows = found.select("doc", "source", "chunk_index", "chunk", "place", F.posexplode("found").alias("q", "question")).where(F.trim("question") != "").withColumn("place", F.col("place") + F.col("q"))
    first = Window.partitionBy(T.normalized(F.col("question"))).orderBy("place")
    rows = stage(rows.withColumn("n", F.row_number().over(first)), "candidates")
    candidates, fresh = rows.agg(F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    rows = rows.where("n = 1").drop("n", "q")
    # Answers; those that say that the passage has none go.
    prompt = F.concat(F.lit("Passage:\n"), F.col("chunk"), F.lit("\n\nQuestion: "), F.col("question"), F.lit(f"\n\nAnswer in one to three sentences from the passage only. If it doesn't hold the answer, reply {NOT_THERE}."))
    rows = _asked(rows, calls, prompt, system=ANSWER, temperature=min(o.temperature, 0.4))
    failed(rows.withColumnRenamed("place", "seq"))
    rows = rows.withColumn("answer", F.trim("response")).drop("response", "error")
    kept = stage(rows.where((F.col("answer") != "") & ~T.unanswerable(F.col("answer"))), "answers")
    answered = kept.count()
    # Wrong answers that look right.
    if o.hard_negatives:
        prompt = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nRight answer: "), F.col("answer"), F.lit("\n\nWrite an answer of like length and style that sounds right and is wrong by this passage. Reply with it as a JSON string.\n\nPassage:\n"), F.col("chunk"))
        wrong = _asked(kept, calls, prompt, system=json_system(None), temperature=o.temperature)
        failed(wrong.withColumnRenamed("place", "seq"))
        wrong = stage(_parsed(wrong, "wrong"), "wrong")
        _unreadable(wrong)
        kept = wrong.withColumn("hard_negative", F.col("found")[0]).drop("found", "response", "error")
    # Marks; a reply that can't be read, or a failed call, marks a pair with zeros.
    prompt = F.concat(
        F.lit("Mark this pair from 1 to 5 for each of: groundedness (the passage supports the answer), answerability (the passage alone answers the question), clarity (both are well put).\n\nPassage:\n"), F.col("chunk"),
        F.lit("\n\nQuestion: "), F.col("question"), F.lit("\nAnswer: "), F.col("answer"), F.lit('\n\nReply with JSON: {"groundedness": n, "answerability": n, "clarity": n}.'),
    )
    marked = stage(_parsed(_asked(kept, calls, prompt, system=json_system(MARK), temperature=0.0), "marks"), "marked")
    quality = F.struct(*(F.coalesce(T.score(F.col("found")[i]), F.lit(0)).alias(a) for i, a in enumerate(AXES)))
    marked = marked.withColumn("quality", quality)
    good = marked.where(F.least(*(F.col(f"quality.{a}") for a in AXES)) >= o.min_quality)
    names = ["question", "answer", F.col("chunk").alias("context"), "source", "chunk_index", *(["hard_negative"] if o.hard_negatives else []), "quality"]
    records = stage(good, "records")
    return QAResult(records.orderBy("place").select(*names), chunks.count(), candidates, fresh - answered, answered - records.count(), candidates - fresh, calls.made - before)


def plan_qa(config: dict, spark: SparkSession, base: str = ".") -> RequestPlan:
    """What run_qa sends at most."""
    o = options_of(config)
    docs = documents(config, spark, base)
    chunks = stage(chunked(docs, o), "chunks")
    n = chunks.count()
    first = chunks.orderBy("place").limit(1).select(question_prompt(F.col("chunk"), o.questions_per_chunk)).collect()
    notes = [f"{docs.count()} documents in {n} chunks of up to {o.chunk_size} words", f"questions without an answer save {1 + o.hard_negatives} requests each"]
    return RequestPlan("qa", n * (1 + o.questions_per_chunk * (2 + o.hard_negatives)), 0, {}, first[0][0] if first else "(the documents hold no text)", json_system(ASK), 0, notes)
