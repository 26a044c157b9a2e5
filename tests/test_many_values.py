"""Parameters and slots of rows with many values."""

from pyspark.sql import functions as F

from uttermark.functions import params as P
from uttermark.functions import text as X


def test_values_are_normalised_once_a_row(spark):
    gold, pred = {f"g{i}": f"Gold {i} one" for i in range(600)}, {f"p{i}": "GOLD 7 1" if i == 599 else f"other{i}" for i in range(600)}
    df = spark.createDataFrame([(gold, pred), ({}, pred), (None, None), ({"a": "x", "b": None}, {"c": "X"})], "g map<string,string>, p map<string,string>")
    pf, n, m = P.param_recall(F.col("g"), F.col("p"))
    got = [tuple(r) for r in df.select(pf, n, m, P.tch_category(F.col("g"), F.col("p"))).collect()]
    assert got == [(1.0, 600, 600, "semantic_drift"), (None, 0, 0, "fabricated"), (None, 0, 0, "fabricated"), (1.0, 1, 1, "semantic_drift")]
    plan = df.select(m.alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[plan.index("exists(") :]  # nothing is normalised for each pair of values


def test_slots_against_a_long_transcript(spark):
    slots, said = [f"w{i}" for i in range(3_000)], " ".join(f"w{i}" for i in range(0, 6_000, 2))
    df = spark.createDataFrame([(slots, said), ([], said), (None, said), (["a"], "")], "s array<string>, h string")
    got = [r[0] for r in df.select(X.slot_error_rate(F.col("s"), F.col("h"))).collect()]
    assert got == [0.5, None, None, 1.0]
