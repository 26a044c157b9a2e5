"""Slot names of rows with many slots."""

from pyspark.sql import functions as F

from uttermark.functions import text as X


def names(types):
    seen, out = {}, []
    for t in types:
        seen[t] = seen.get(t, 0) + 1
        out.append(t if t is None or seen[t] == 1 else f"{t}_{seen[t]}")
    return out


def test_many_slots(spark):
    lists = [["a", "b", "a", "a_2", "b", "a"], [], ["a"], ["a", None, "a", None], [f"t{i % 4}" for i in range(3_000)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, types array<string>").repartition(4, "id")
    got = {r["id"]: r["names"] for r in df.select("id", X.slot_suffix(F.col("types")).alias("names")).collect()}
    assert [got[i] for i in range(len(lists))] == [names(x) for x in lists]
    plan = df.select(X.slot_suffix(F.col("types")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan  # no search of all slots before each
    none = spark.createDataFrame([(None,)], "types array<string>").select(X.slot_suffix(F.col("types")).alias("n"))
    assert none.first()["n"] is None
