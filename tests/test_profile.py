"""Inference on columns of many different values."""

import pytest
from pyspark.sql import functions as F

from weftwork.operators import profile
from weftwork.sources.io import RawData


def test_inference_holds_no_column_in_one_place(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("repeats rows for each column, or holds all values in one task")

    monkeypatch.setattr(profile.F, "percentile", refused)
    monkeypatch.setattr(profile.F, "count_distinct", refused)
    n = F.col("id")
    df = spark.range(3000).select(
        (n + 5).alias("order_id"), (n % 977 * 3.25 + 1).alias("net"), F.round((n % 977 * 3.25 + 1) * 1.19, 2).alias("gross"), (n * n % 1009 / 4.0).alias("other"),
        F.when(n == 2999, "n/a").otherwise(n.cast("string")).alias("late"), F.when(n > 2500, n + 0.5).otherwise(n.cast("int")).alias("half"), F.lit(None).cast("string").alias("none"),
    )
    df = df.withColumn("late_half", F.when(F.col("order_id") > 2990, "2.5").otherwise("2"))
    found = profile.infer_schema(RawData({"sales": df}, "tables", ".")).spec["tables"][0]
    fields = {f["name"]: f for f in found["fields"]}
    assert found["rows"] == 3000 and fields["order_id"] == {"name": "order_id", "type": "id", "start": 5} and fields["none"]["null_rate"] == 1.0
    assert fields["gross"]["expr"] == "round(net * 1.19, 2)" and fields["other"]["type"] == "float"
    assert fields["late"]["type"] == "text" and fields["half"]["type"] == "float" and (fields["late_half"]["type"], fields["late_half"]["max"]) == ("float", 2.5)


def test_constant_is_the_median(spark):
    rows = [(round(x * 3.3), x, i) for i, x in enumerate(range(1, 40))]
    ratio = spark.createDataFrame([(o / x, float(o), float(x), i) for o, x, i in rows], "r double, out double, x double, id long")
    assert profile._constant(ratio, 0) == pytest.approx(sorted(o / x for o, x, _ in rows)[19])
    assert profile._constant(ratio.withColumn("out", F.when(F.col("id") == 20, F.col("out") + 2).otherwise(F.col("out"))), 0) is None
    assert profile._constant(ratio.limit(5), 0) is None
