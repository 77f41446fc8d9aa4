"""Model calls as a step of a query: a table of requests in, a table of answers out.

Calls are made where the requests lie, by a client that tasks get a copy of, or answered by a join with a cassette; either
way the answers are staged, so that no call is repeated when a later step is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.errors import ReplayMiss, WeftError
from weftwork.sources.cassette import VERSION, Client, cassette_frame, replayed, request_key
from weftwork.staging import stage

ANSWERS = "seq long, op string, key string, payload string, response string, error string"


def keyed(requests: DataFrame) -> DataFrame:
    """requests (seq, op, payload: the call's arguments as JSON) with the key of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [request_key(op, json.loads(p)) for op, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string()), batch.column(2)], ["seq", "op", "key", "payload"])

    return requests.select(F.col("seq").cast("long").alias("seq"), "op", "payload").mapInArrow(run, "seq long, op string, key string, payload string")


class Calls:
    """Answers requests with a client. A failed call is an answer with an error."""

    def __init__(self, client: Client):
        self.client, self.made = client, 0

    def answer(self, requests: DataFrame) -> DataFrame:
        """(seq, op, key, payload, response, error) of requests (seq, op, payload); chat replies are texts, vectors JSON."""
        out = stage(self._answers(keyed(requests)), "answers")
        self.made += out.count()
        return out

    def _answers(self, asked: DataFrame) -> DataFrame:
        client = self.client

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got: list[tuple[str | None, str | None]] = []
                for op, payload in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    try:
                        reply = getattr(client, op)(**json.loads(payload))
                        got.append((reply if op == "chat" else json.dumps([[round(float(x), 6) for x in v] for v in reply]), None))
                    except Exception as e:
                        got.append((None, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], [x.split()[0] for x in ANSWERS.split(", ")])

        return asked.mapInArrow(run, ANSWERS)


class RecordedCalls(Calls):
    """Calls that are also written to a cassette, in the order of requests."""

    def __init__(self, client: Client, path: str | Path):
        super().__init__(client)
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps({"cassette": VERSION, "model": getattr(client, "model", None)}) + "\n", encoding="utf-8")

    def answer(self, requests: DataFrame) -> DataFrame:
        out = super().answer(requests)
        with self.path.open("a", encoding="utf-8") as log:
            for r in out.orderBy("seq").toLocalIterator():
                entry = {"key": r["key"], "op": r["op"], "request": json.loads(r["payload"])}
                entry |= {"error": r["error"]} if r["error"] is not None else {"response": r["response"] if r["op"] == "chat" else json.loads(r["response"])}
                log.write(json.dumps(entry, ensure_ascii=False) + "\n")
        return out


class ReplayedCalls(Calls):
    """Answers from a cassette: the n-th of equal requests has the n-th answer, over all calls of a run."""

    def __init__(self, path: str | Path, spark: SparkSession):
        super().__init__(None)  # type: ignore[arg-type]
        try:
            with Path(path).open(encoding="utf-8") as log:
                head = json.loads(log.readline() or "null")
        except (OSError, ValueError) as e:
            raise WeftError(f"{path} isn't a cassette: {e}") from e
        if not isinstance(head, dict) or "cassette" not in head:
            raise WeftError(f"{path} isn't a cassette: its first line isn't a header")
        self.held = cassette_frame(f"file://{Path(path).resolve()}", spark)
        self.used: DataFrame | None = None

    def _answers(self, asked: DataFrame) -> DataFrame:
        held = self.held
        if self.used is not None:
            used = self.used.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("before"))
            held = held.join(used, F.col("key") == F.col("k"), "left").withColumn("occurrence", F.col("occurrence") - F.coalesce("before", F.lit(0))).where("occurrence > 0")
        return replayed(asked, held).select("seq", "op", "key", "payload", "response", "error")

    def answer(self, requests: DataFrame) -> DataFrame:
        out = super().answer(requests)
        self.used = out.select("key") if self.used is None else self.used.unionByName(out.select("key"))
        miss = out.where("response is null and error is null").orderBy("seq").limit(1).collect()
        if miss:
            raise ReplayMiss(f"no recorded answer to this {miss[0]['op']} request: {miss[0]['payload'][:120]}")
        return out

    @property
    def remaining(self) -> int:
        return self.held.count() - self.made


def chat_request(seq, prompt, *, system=None, temperature=0.7, max_tokens: int = 1024):
    """Columns (seq, op, payload) of chat requests."""
    none = F.lit(None).cast("string")
    args = F.struct(prompt.alias("prompt"), (none if system is None else F.lit(system)).alias("system"), F.lit(float(temperature)).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))
    return [seq.alias("seq"), F.lit("chat").alias("op"), F.to_json(args, {"ignoreNullFields": "false"}).alias("payload")]


def failed(answers: DataFrame) -> None:
    """Raises the first error among answers."""
    bad = answers.where("error is not null").orderBy("seq").limit(1).collect()
    if bad:
        raise WeftError(bad[0]["error"])
