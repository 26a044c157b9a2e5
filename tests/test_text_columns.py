"""Word lists and texts of the same words."""

import pyarrow as pa

from uttermark.functions import errors
from uttermark.plans import evaluation

SF = "/root/testdata/sf0.001"


def test_alignment_takes_texts(spark):
    pairs = [("a b c", "a x c"), ("a", ""), (None, "b b"), ("", ""), ("a b", "a b"), ("é b", "b é b")]
    texts = spark.createDataFrame(pairs, "ref string, hyp string")
    lists = spark.createDataFrame([tuple(x.split() if x else None for x in p) for p in pairs], "ref array<string>, hyp array<string>")
    assert [r["chunks"] for r in errors.aligned(texts).collect()] == [r["chunks"] for r in errors.aligned(lists).collect()]


def test_texts_are_not_joined_for_each_chunk(spark):
    plan = evaluation.QUERIES["f21_align_words"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and "array_join" not in plan[: plan.index("MapInArrow")]


def test_words_of_a_slice():
    texts = pa.array(["a b", "", "c", "d e f", "", "g h", "a b"])
    assert errors._lists(texts.slice(4, 3)).to_pylist() == [None, ["g", "h"], ["a", "b"]]
