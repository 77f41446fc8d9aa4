import pytest
from pyspark.sql import functions as F

from tests.schemas import LIBRARY, RULES, STAFF
from weftwork.operators import validate as validation
from weftwork.operators.records import validate_records
from weftwork.operators.validate import distribution_report, looping, render_distribution, validate
from weftwork.plans.generate import Dataset, generate


@pytest.fixture(scope="module")
def library(spark):
    data = generate(LIBRARY, spark)
    return Dataset(data.schema, {k: v.cache() for k, v in data.tables.items()})


def changed(data, table, **columns):
    return Dataset(data.schema, {**data.tables, table: data[table].withColumns({k: F.expr(v) for k, v in columns.items()})})


def test_generated_tables_pass(library, spark):
    report = validate(library)
    assert report.ok, report.render()
    assert {"foreign_key", "parent_coverage", "lookup_consistency", "temporal_order", "distribution", "uniqueness"} <= {c.name for c in report.checks}
    assert validate(generate(RULES, spark)).ok and validate(generate(STAFF, spark)).ok


@pytest.mark.parametrize(
    ("table", "columns", "failing"),
    [
        ("loans", {"grams": "if(loan = 11, grams + 1, grams)"}, {"lookup_consistency"}),
        ("loans", {"lent": "if(loan = 40, date'2001-01-01', lent)"}, {"temporal_order", "type"}),
        ("readers", {"mail": "if(card = 7003, 'x@real-company.com', mail)"}, {"type"}),
        ("loans", {"card": "if(loan = 9, 1, card)"}, {"foreign_key"}),
        ("readers", {"age_group": "'adult'"}, {"distribution"}),
        ("branches", {"seats": "if(code = 'BR12', 4000, seats)"}, {"type"}),
        ("branches", {"code": "if(code = 'BR11', 'BR10', code)"}, {"uniqueness", "foreign_key", "lookup_consistency", "parent_coverage"}),
    ],
)
def test_each_fault_trips_its_check(library, table, columns, failing):
    got = {c.name for c in validate(changed(library, table, **columns)).failures()}
    assert got and got <= failing | {"temporal_order", "parent_coverage"} and failing & got


def test_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 5), (5, 3), (6, 3), (7, 99)], "id long, up long")
    assert {r[0] for r in looping(df, "id", "up").collect()} == {3, 4, 5, 6}
    twice = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 1), (5, 6), (6, None), (7, 7)] * 20, "id long, up long")
    assert sorted(r[0] for r in looping(twice, "id", "up").collect()) == [1, 2, 7]


def test_cycles_pass_the_driver_by(spark, monkeypatch):
    rows, plans, paths = list(range(1, 3001)), [], []
    staged = validation.stage
    monkeypatch.setattr(validation, "stage", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), paths.append(name), staged(df, name))[-1])
    df = spark.createDataFrame([(i, i // 2 or None) for i in rows] + [(5000 + i, 5000 + (i + 1) % 37) for i in range(37)] + [(6000 + i, 6000 + i - 1 if i else None) for i in range(100)] + [(7000 + i, 7000 + i - 1 if i else 5003) for i in range(50)], "id long, up long")
    assert {r[0] for r in looping(df, "id", "up").collect()} == {*range(5000, 5037), *range(7000, 7050)}
    assert plans and not any("Broadcast" in p for p in plans)
    assert len(paths) <= 9  # a path of 100 steps is left by 7 doublings


def test_report(library):
    text = render_distribution(distribution_report(library))
    assert "age_group" in text and "adult 0.600 (0.600)" in text


def test_records(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "X "), ("b", ""), ("zzz", "q")], "label string, text string")
    bad = {c.name for c in validate_records(df, "classification", quotas={"a": 2, "b": 1}).failures()}
    assert bad == {"required_fields", "label_set", "duplicates"}
    qa = spark.createDataFrame([("q", "not_in_passage", "c", (5, 5, 5)), ("Q", "a", "c", (1, 5, 5))], "question string, answer string, context string, quality struct<groundedness: int, answerability: int, clarity: int>")
    assert {c.name for c in validate_records(qa, "qa").failures()} == {"answerable", "quality_min", "duplicates"}
