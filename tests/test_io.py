"""Tables out to files and back, by paths and URIs, and what is inferred from them."""

import json

import pytest
from pyspark.sql import functions as F

from tests.schemas import LIBRARY, STAFF
from weftwork.errors import ExportError, LoadError
from weftwork.functions.text import score, unanswerable
from weftwork.operators import dedup, profile, records
from weftwork.plans.generate import generate
from weftwork.sources import io


@pytest.fixture(scope="module")
def library(spark):
    return generate(LIBRARY, spark).staged()


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


@pytest.mark.parametrize("formats", ["csv", "jsonl"])
def test_files_come_back_as_they_were(spark, library, tmp_path, formats):
    local, remote = tmp_path / "local", f"file://{tmp_path}/remote"
    io.export_dataset(library, local, formats)
    io.export_dataset(library, remote, formats)
    for where in (local, remote):
        back = io.load_dataset(where, LIBRARY, spark)
        for t in library.schema.tables:
            assert rows(back[t.name].select(*t.names)) == rows(library[t.name].select(*t.names))
        assert io.validate_data(LIBRARY, where, spark).ok


def test_other_sinks_and_faults(spark, library, tmp_path):
    paths = io.export_dataset(library, tmp_path, ["parquet", "sqlite"], basename="lib")
    assert spark.read.parquet(paths["parquet"][0]).count() == 9
    raw = io.load_raw(tmp_path / "lib.db", spark)
    assert raw.kind == "sqlite" and set(raw.names()) == {"branches", "readers", "titles", "loans"} and raw.tables["loans"].count() == 480
    for bad, kind in ((["odd"], tmp_path), (["sqlite"], f"file://{tmp_path}/x")):
        with pytest.raises(ExportError):
            io.export_dataset(library, kind, bad)
    for path in (tmp_path / "none", tmp_path / "parquet"):
        with pytest.raises(LoadError):
            io.load_raw(path, spark)
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "t.jsonl").write_text('{"b": 1, "a": "é"}\n\n{"a": null, "c": [1]}\n', encoding="utf-8")
    assert io.load_raw(tmp_path / "lines", spark).tables["t"].columns == ["b", "a", "c"]
    (tmp_path / "lines" / "u.jsonl").write_text("[1]\n", encoding="utf-8")
    with pytest.raises(LoadError):
        io.load_raw(tmp_path / "lines", spark)


def test_what_was_generated_is_inferred(spark, library, tmp_path):
    io.export_dataset(library, tmp_path, "csv")
    found = profile.infer_schema(io.load_raw(tmp_path, spark), rows_scale=0.5)
    spec = {t["name"]: {f["name"]: f for f in t["fields"]} for t in found.spec["tables"]}
    assert spec["branches"]["code"] == {"name": "code", "type": "id", "prefix": "BR", "start": 10}
    assert spec["loans"]["card"]["references"] == "readers.card" and spec["loans"]["shelf"]["references"] == "titles.shelf" and spec["loans"]["shelf"]["skew"] == "zipf"
    assert spec["readers"]["home"]["references"] == "branches.code" and spec["readers"]["home"]["min_per_parent"] >= 1 and spec["readers"]["home_town"]["type"] == "lookup"
    assert spec["loans"]["grams"]["type"] == "lookup" and spec["loans"]["back"]["after"] == "lent" and spec["readers"]["mail"]["depends_on"] == "person"
    assert spec["titles"]["fine"]["correlate"]["field"] in ("pages", "grams") and [t["rows"] for t in found.spec["tables"] if t["name"] == "loans"] == [240]
    assert profile.fidelity(io.load_raw(tmp_path, spark), found.schema, generate(found.schema, spark).tables)


def test_kinds(spark):
    df = spark.createDataFrame([("1", "2024-01-02T03:04Z", "2024-01-02 03:04:05.5+01:00", "2024-13-01", "2024-02-29", "1e5", None), ("0", "2024-01-02 03:04", "2024-01-02T03:04:05", "2024-01-01", " ", "-2.5", "")], "is_x string, a string, b string, c string, d string, e string, f string")
    assert profile.sniff(df) == {"is_x": "bool", "a": "datetime", "b": "datetime", "c": "string", "d": "date", "e": "float", "f": "empty"}
    odd = spark.createDataFrame([("2024-01-02T03:04.5",)], "x string")
    assert profile.sniff(odd) == {"x": "string"}
    assert [profile._singular(x) for x in ("cities", "buses", "boxes", "glass", "loans", "staff")] == ["city", "bus", "box", "glass", "loan", "staff"]


def test_marks_and_quality(spark):
    df = spark.createDataFrame([("4.5",), ("9",), ("-1",), ("x",), (None,)], "m string")
    assert [r[0] for r in df.select(score(F.col("m"))).collect()] == [4, 5, 0, 0, 0]
    said = spark.createDataFrame([("Not in passage",), ("it is",)], "a string")
    assert [r[0] for r in said.select(unanswerable(F.col("a"))).collect()] == [True, False]
    marked = spark.createDataFrame([((5, 4, 3), "a"), ((2, 4, 3), "b"), (None, "b")], "quality struct<groundedness: int, answerability: int, clarity: int>, label string")
    assert records.average_quality(marked) == pytest.approx(5 / 3) and [tuple(r) for r in records.label_histogram(marked, "label").collect()] == [("b", 2), ("a", 1)]


def test_near_texts_go_in_order(spark):
    base = [f"w{i}" for i in range(40)]
    near = [*base[:39], "other"]
    df = spark.createDataFrame([(1, " ".join(base), "g"), (2, " ".join(near), "g"), (3, " ".join(base).upper(), "g"), (4, " ".join(near), "h"), (5, "  ", "g"), (6, "short text", "g")], "id long, text string, grp string")
    pairs = dedup.lexical_pairs(df, "text", "id")
    assert sorted((r["a"], r["b"], round(r["similarity"], 3)) for r in pairs.collect()) == [(1, 2, 0.949), (1, 3, 1.0), (1, 4, 0.949), (2, 3, 0.949), (2, 4, 1.0), (3, 4, 0.949)]
    assert sorted(r["id"] for r in dedup.near(df, "text", "id", by="grp").collect()) == [1, 4, 6]
    assert sorted(r["id"] for r in dedup.near(df, "text", "id", method="none").collect()) == [1, 2, 6]


def test_chat_shapes(spark):
    qa = spark.createDataFrame([("q", "a", "c")], "question string, answer string, context string")
    said = lambda df, **o: [[(m["role"], m["content"]) for m in r["messages"]] for r in io.chat_messages(df, **o).collect()]
    assert said(qa, include_context=True, system="s") == [[("system", "s"), ("user", "c\n\nq"), ("assistant", "a")]] and said(qa)[0][0] == ("user", "q")
    label = spark.createDataFrame([("t", "l")], "text string, label string")
    assert said(label)[0][1:] == [("user", "t"), ("assistant", "l")]
    review = spark.createDataFrame([("t", "review", "lamp", "positive")], "text string, kind string, product string, sentiment string")
    assert "product: lamp." in said(review)[0][0][1] and said(review)[0][-1] == ("assistant", "t")
    other = spark.createDataFrame([(1, "x")], "n int, s string")
    assert json.loads(said(other)[0][-1][1]) == {"n": 1, "s": "x"}


def test_a_tree_keeps_its_links(spark, tmp_path):
    data = generate(STAFF, spark).staged()
    io.export_dataset(data, tmp_path, "sqlite")
    found = profile.infer_schema(io.load_raw(tmp_path / "data.db", spark)).spec["tables"][0]["fields"]
    assert {f["name"]: f["type"] for f in found}["badge"] == "id"
