"""Text and question tasks with a scripted model, recorded and replayed, and the command line."""

import json

import pytest

from tests.schemas import LIBRARY
from weftwork import cli
from weftwork.errors import MissingKey, ReplayMiss, WeftError
from weftwork.functions.replies import as_text, as_texts, extract_json
from weftwork.plans import questions, texts
from weftwork.plans.calls import Calls, RecordedCalls, ReplayedCalls
from weftwork.sources import client as http


class Scripted:
    """Answers by the prompt alone, so that it doesn't matter in which task it runs."""

    model = "scripted"

    def __init__(self, no_vectors: bool = False):
        self.no_vectors = no_vectors

    def chat(self, prompt, system=None, temperature=0.7, max_tokens=1024):
        import hashlib
        import re

        tag = hashlib.md5(prompt.encode()).hexdigest()[:6]
        if "review" in prompt or "a JSON string" in prompt and "Right answer" not in prompt:
            return json.dumps(f"text {tag} of its own with words {tag[::-1]}")
        if "ticket" in prompt:
            return f'Here it is: ```json\n{{"title": "S {tag}", "message": "\\"B {tag}\\""}}\n```'
        if "questions" in prompt:
            return json.dumps(["What is it?", f"Which {tag}?", "", "Left over?"])
        if "reply NOT_IN_PASSAGE" in prompt:
            return "not in passage." if "What is it?" in prompt and "beta" in prompt else f"It is {tag}."
        if "Right answer" in prompt:
            return json.dumps({"wrong_answer": f"not {tag}"})
        if "Mark this pair" in prompt:
            return "no marks" if "gamma" in prompt else '{"scores": {"groundedness": 5, "answerability": "4.4", "clarity": 9}}'
        n = int(re.search(r"array of (\d+)", prompt)[1])
        again = "These are there already" in prompt
        own = [f"{'more' if again else 'first'} {tag} number {i} {tag}{i}" for i in range(n)]
        return json.dumps({"items": own if again else ["same text here", " Same  TEXT here", *own][:n]})

    def embed(self, texts, input_type="passage"):
        if self.no_vectors:
            raise RuntimeError("no vectors today")
        import hashlib

        return [[b / 255 - 0.5 for b in hashlib.sha256(t.encode()).digest()] for t in texts]


CONFIG = {"task": "classification", "labels": ["pay", "ship", "other"], "per_class": 6, "max_rounds": 3}


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_quotas_are_topped_up(spark, tmp_path):
    log = tmp_path / "calls.jsonl"
    made = texts.run_text(CONFIG, RecordedCalls(Scripted(), log), spark)
    got = rows(made.records)
    assert [r["label"] for r in got] == ["pay"] * 6 + ["ship"] * 6 + ["other"] * 6 and set(got[0]) == {"text", "label", "kind"}
    assert not made.shortfall and made.dedup == "embedding" and made.requests == 6
    assert all(sum(r["text"].lower() == "same text here" for r in got[i : i + 6]) == 1 for i in (0, 6, 12))
    lines = [json.loads(x) for x in log.read_text().splitlines()]
    assert lines[0]["cassette"] == 1 and sum(x["op"] == "chat" for x in lines[1:]) == 6
    calls = ReplayedCalls(log, spark)
    assert rows(texts.run_text(CONFIG, calls, spark).records) == got and calls.remaining == 0
    with pytest.raises(ReplayMiss):
        texts.run_text({**CONFIG, "per_class": 7}, ReplayedCalls(log, spark), spark)


def test_without_vectors_shingles_decide(spark):
    made = texts.run_text({**CONFIG, "max_rounds": 1}, Calls(Scripted(no_vectors=True)), spark)
    assert made.dedup == "lexical" and made.shortfall == {"pay": 1, "ship": 1, "other": 1}
    assert texts.run_text({**CONFIG, "dedup": "none", "labels": ["pay"], "per_class": 3, "max_rounds": 1}, Calls(Scripted()), spark).dedup == "none"


def test_reviews_and_tickets(spark):
    got = rows(texts.run_text({"task": "reviews", "product": "a lamp", "count": 7, "dedup": "lexical"}, Calls(Scripted()), spark).records)
    assert [r["sentiment"] for r in got] == ["positive"] * 4 + ["neutral"] + ["negative"] * 2
    assert all(r["rating"] in {"positive": (4, 5), "neutral": (3,), "negative": (1, 2)}[r["sentiment"]] and r["product"] == "a lamp" and r["aspect"] in texts.ASPECTS for r in got)
    got = rows(texts.run_text({"task": "tickets", "categories": ["login"], "per_category": 2, "dedup": "lexical"}, Calls(Scripted()), spark).records)
    assert got and all(r["text"] == f"{r['subject']}\n\n{r['body']}" and r["body"].startswith("B ") and r["tone"] in texts.TONES for r in got)


def test_plans_and_faults(spark):
    plan = texts.plan_text({"task": "personas", "count": 23}, spark)
    assert (plan.chat_requests, plan.embed_requests, plan.more_rounds) == (3, 1, 4) and "array of 10" in plan.first_prompt
    plan = texts.plan_text({"task": "reviews", "product": "x", "count": 24, "sentiments": {"positive": 0.5, "neutral": 0.2, "negative": 0.3}}, spark)
    assert plan.groups == {"positive": 12, "neutral": 5, "negative": 7} and (plan.chat_requests, plan.embed_requests) == (24, 3) and "nothing is sent" in plan.render()
    for bad in ({"task": "poems"}, {"task": "paraphrase"}, {"task": "paraphrase", "seeds": ["a"], "dedup": "odd"}):
        with pytest.raises(WeftError):
            texts.task_of(bad)
    assert texts.subject_body([{"message": "m"}]) == ("Support request", "m") and texts.subject_body("x") == ("Support request", "x")
    assert texts.unquoted(' "a b" ') == "a b" and texts.unquoted("\"a'") == "\"a'"


def qa_config(tmp_path):
    (tmp_path / "b.md").write_text("beta " * 9, encoding="utf-8")
    return {"docs": ["alpha " * 30, {"path": "b.md"}, {"text": "gamma words", "source": "g"}], "chunk_size": 20, "overlap": 5, "questions_per_chunk": 2}


def test_questions(spark, tmp_path):
    config = qa_config(tmp_path)
    made = questions.run_qa(config, Calls(Scripted()), spark, str(tmp_path))
    got = rows(made.records)
    # Four chunks with two questions each; one of them is the same everywhere; the marks of the last document can't be read.
    assert (made.chunks, made.candidates, made.duplicates) == (4, 8, 3) and made.unanswerable == 0 and made.low_quality == 1
    assert [r["source"] for r in got] == ["inline-0", "inline-0", "inline-0", "b.md"] and got[0]["question"] == "What is it?"
    assert got[0]["quality"] == {"groundedness": 5, "answerability": 4, "clarity": 5} and got[0]["hard_negative"].startswith("not ")
    beta = questions.run_qa({**config, "docs": [{"path": "b.md"}], "hard_negatives": False}, Calls(Scripted()), spark, str(tmp_path))
    assert beta.unanswerable == 1 and "hard_negative" not in beta.records.columns
    plan = questions.plan_qa(config, spark, str(tmp_path))
    assert plan.chat_requests == 4 * 7 and "4 chunks" in plan.render()
    with pytest.raises(WeftError):
        questions.plan_qa({"docs": [{"title": "x"}]}, spark)


def run(spark, *argv):
    return cli.main([str(x) for x in argv], lambda: spark)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import yaml

    schema, out = tmp_path / "s.yaml", tmp_path / "out"
    schema.write_text(yaml.safe_dump({"seed": 1, "tables": LIBRARY["tables"][:2]}), encoding="utf-8")
    assert run(spark, "generate", "tabular", "--schema", schema, "--out", out, "--format", "csv,sqlite", "--validate") == 0
    assert (out / "readers.csv").exists() and (out / "dataset.db").exists() and "readers: 140 rows" in capsys.readouterr().out
    assert run(spark, "validate", "--schema", schema, "--data", out) == 0 and run(spark, "report", "--schema", schema) == 0
    lines = (out / "readers.csv").read_text(encoding="utf-8").splitlines()
    (out / "readers.csv").write_text("\n".join([*lines[:-1], lines[-1].replace("BR", "XX")]) + "\n", encoding="utf-8")
    assert run(spark, "validate", "--schema", schema, "--data", out) == 1 and "FAIL readers.home foreign_key" in capsys.readouterr().out
    assert run(spark, "infer", "--data", out / "dataset.db", "--out", tmp_path / "found.yaml", "--no-fidelity") == 0
    assert "branches.code" in (tmp_path / "found.yaml").read_text()
    assert run(spark, "validate", "--schema", tmp_path / "none.yaml") == 1
    task, log = tmp_path / "t.yaml", tmp_path / "log.jsonl"
    task.write_text(yaml.safe_dump({"task": "paraphrase", "seeds": ["Send it back."], "variations": 3, "dedup": "lexical"}), encoding="utf-8")
    assert run(spark, "generate", "text", "--task", task, "--out", tmp_path / "t.jsonl", "--dry-run") == 0
    monkeypatch.delenv(http.KEY, raising=False)
    monkeypatch.chdir(tmp_path)
    assert run(spark, "generate", "text", "--task", task, "--out", tmp_path / "t.jsonl") == 2
    texts.run_text(texts.load_task(str(task)), RecordedCalls(Scripted(), log), spark)
    assert run(spark, "generate", "text", "--task", task, "--out", tmp_path / "t.jsonl", "--replay", log, "--chat", tmp_path / "c.chat.jsonl", "--validate") == 0
    assert len((tmp_path / "t.jsonl").read_text().splitlines()) == 3 and "replayed" in capsys.readouterr().out
    assert json.loads((tmp_path / "c.chat.jsonl").read_text().splitlines()[0])["messages"][-1]["role"] == "assistant"
    task.write_text(yaml.safe_dump({"task": "paraphrase", "seeds": ["Another."], "variations": 3}), encoding="utf-8")
    assert run(spark, "generate", "text", "--task", task, "--out", tmp_path / "t.jsonl", "--replay", log) == 3
    assert run(spark, "generate", "text", "--task", task, "--out", tmp_path / "t.jsonl", "--replay", log, "--record", log) == 1


def test_client_retries_what_may_pass(monkeypatch):
    import io
    import urllib.error

    tries, waits = [], []
    replies = [429, 503, {"choices": [{"message": {"content": "hi"}}]}]

    def opened(request, timeout):
        got = replies[len(tries)]
        tries.append(request.full_url)
        if isinstance(got, int):
            raise urllib.error.HTTPError(request.full_url, got, "no", {}, None)
        return io.BytesIO(json.dumps(got).encode())

    monkeypatch.setattr(http.urllib.request, "urlopen", opened)
    monkeypatch.setattr(http.time, "sleep", waits.append)
    one = http.HttpClient(url="http://x/v1", key="k")
    assert one.chat("p", "s") == "hi" and waits == [1.5, 3.0] and tries[0] == "http://x/v1/chat/completions"
    tries.clear()
    replies[:] = [400]
    with pytest.raises(WeftError):
        one.chat("p")
    assert len(tries) == 1
    tries.clear()
    replies[:] = [{"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}, {"data": [{"index": 0, "embedding": [3.0]}]}]
    assert http.HttpClient(url="http://u", key="k", batch=2).embed(["a", "b", "c"]) == [[1.0], [2.0], [3.0]]
    monkeypatch.delenv(http.KEY, raising=False)
    with pytest.raises(MissingKey):
        http.HttpClient(url="u")


@pytest.mark.parametrize(
    ("reply", "value"),
    [('{"a": 1}', {"a": 1}), ("Sure:\n```json\n[1, 2]\n```\nbye", [1, 2]), ("x [not] then {\"a\": [1]} y", {"a": [1]}), ('"just text"', "just text"), ("```\n{\"b\": 2}\n```", {"b": 2})],
)
def test_json_in_replies(reply, value):
    assert extract_json(reply) == value


def test_texts_in_json():
    assert as_texts({"items": ["a", {"text": "b"}, None, 3]}) == ["a", "b", "3"] and as_texts("x") == ["x"] and as_texts({"1": "a", "2": "b"}) == ["a", "b"] and as_texts(None) == []
    assert as_text({"answer": "q"}) == "q" and as_text(["", {"content": "z"}]) == "z" and as_text(True) == "" and as_text({"review": " r "}, ("review",)) == "r"
    with pytest.raises(WeftError):
        extract_json("nothing [here")
