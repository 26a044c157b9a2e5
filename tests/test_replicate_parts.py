"""Sums of replicates within a task, run here on batches made by hand."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from uttermark.operators import models as M


class Rows:
    """Stands for a DataFrame: keeps the function that a task would run."""

    schema = T.StructType([T.StructField("slurp_id", T.LongType()), T.StructField("level", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("k", T.DoubleType())])

    def mapInArrow(self, run, schema):
        return run


def batches(n, rows):
    rng = np.random.default_rng(3)
    for i in range(n):
        level = [None if v == 3 else f"l{v}" for v in rng.integers(0, 4, rows)]
        x = np.where(rng.random(rows) < 0.2, rng.choice([0.0, -0.0], rows), rng.integers(0, 40, rows) / 40)
        yield pa.RecordBatch.from_arrays([pa.array(i * 5 + np.sort(rng.integers(0, 9, rows))), pa.array(level), pa.array(x), pa.array(rng.integers(0, 2, rows).astype(float))], names=["slurp_id", "level", "x", "k"])


@pytest.mark.parametrize(("dense", "together"), [(0, 0), (0, 900), (1000, 0), (1000, 900)])
def test_products_and_sorted_sums_are_the_same(spark, monkeypatch, dense, together):
    monkeypatch.setattr(M, "DENSE", dense)
    monkeypatch.setattr(M, "TOGETHER", together)
    got, want = {}, {}
    for rb in M.replicate_parts(Rows(), ["level", "x"], ["k"], 300, 42)(batches(7, 400)):
        for r in rb.to_pylist():
            got.setdefault((r["level"], r["x"]), {})[r["block"]] = r["sums"]
    for r in (r for rb in batches(7, 400) for r in rb.to_pylist()):
        want[r["level"], r["x"]] = want.get((r["level"], r["x"]), 0) + r["k"] * M.poisson_weights(np.array([r["slurp_id"]]), 300, 42)[0]
    assert got.keys() == want.keys()
    for key, sums in want.items():
        assert np.array_equal(np.concatenate([got[key][b] for b in (0, 1)]), sums)


def test_weights_are_drawn_for_many_batches_at_once(spark, monkeypatch):
    """Not anew for every batch, with each of its cells on its own: that took longer than all else on many rows."""
    calls, draw = [], M.poisson_weights
    monkeypatch.setattr(M, "poisson_weights", lambda *a: calls.append(a) or draw(*a))
    assert sum(rb.num_rows for rb in M.replicate_parts(Rows(), ["level", "x"], ["k"], 200, 42)(batches(12, 500)))
    assert len(calls) == 1
