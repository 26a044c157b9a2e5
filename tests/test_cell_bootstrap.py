"""The cell bootstrap draws an utterance's weights once: its rows stay together, and many batches share a draw."""

import numpy as np
from pyspark.sql import functions as F

from test_replicate_parts import Rows, batches
from uttermark.operators import models as M
from uttermark.operators.pairs import together_with_anchor, with_anchor


def test_anchors_of_rows_that_stay_together(spark):
    rng = np.random.default_rng(6)
    data = [(None if i % 97 == 0 else int(rng.integers(0, 40)), f"a{i % 2}", f"l{i % 3}", "clean" if rng.random() < 0.2 else "noise", None if i % 13 == 0 else float(rng.integers(0, 3)), None if i % 17 == 0 else int(i % 2), i, i // 7) for i in range(1500)]
    rows = spark.createDataFrame(data, "slurp_id long, asr string, llm string, degradation string, wer double, ees int, nr int, line int").repartition(6)
    for order in (None, ["nr"]):
        want = {r["nr"]: r["clean_outcome"] for r in with_anchor(rows, order=order, rated=False).collect()}
        got = together_with_anchor(rows, ["nr"], order=order)
        assert {r["nr"]: r["clean_outcome"] for r in got.collect()} == want and len(want) == 1500
    at = {(r["slurp_id"], r["at"]) for r in got.where("clean_outcome is null or clean_outcome < 2").select("slurp_id", F.spark_partition_id().alias("at")).collect()}
    assert len(at) == len({i for i, _ in at})


def test_further_sums_share_one_draw(spark, monkeypatch):
    """Before, each batch drew its utterances' weights again where a prediction was among the sums."""
    calls, draw = [], M.poisson_weights
    monkeypatch.setattr(M, "poisson_weights", lambda *a: calls.append(a) or draw(*a))
    more = {"n": lambda keys, code, rb, of: lambda weight, first: np.stack([weight[of[code == i]].sum(0) for i in range(len(keys))])}
    parts = list(M.replicate_parts(Rows(), ["level"], ["k"], 200, 42, more=more)(batches(12, 500)))
    assert len(calls) == 1
    sums = {(r["level"], r["value"]): r["sums"] for rb in parts for r in rb.to_pylist()}
    rows = [r for rb in batches(12, 500) for r in rb.to_pylist()]
    for level in {r["level"] for r in rows}:
        want = sum(draw(np.array([r["slurp_id"]]), 200, 42)[0] for r in rows if r["level"] == level)
        assert np.array_equal(sums[level, "n"], want)


def test_pairs_of_an_utterance_come_together(spark, monkeypatch):
    """Not by the clip they were joined on, which drew an utterance's weights again for most of its clips."""
    from uttermark.plans import evaluation

    seen, whole = [], M.replicate_parts
    monkeypatch.setattr(M, "replicate_parts", lambda rows, *a, **k: seen.append(rows) or whole(rows, *a, **k))
    evaluation.QUERIES["m3_pathway_bootstrap"](spark, "/root/testdata/sf0.001")
    at = {(r["slurp_id"], r["at"]) for r in seen[0].select("slurp_id", F.spark_partition_id().alias("at")).collect()}
    assert len(at) == len({i for i, _ in at}) > 100
