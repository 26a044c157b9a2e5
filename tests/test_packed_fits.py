"""Rows of the clustered fit are held packed, and only columns that a design reads are held."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttermark.operators import designs, gee
from uttermark.plans import evaluation

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i // 5), float(rng.random() < 0.5), float(rng.integers(0, 4)), *(int(x) for x in rng.integers(0, 2, 3))) for i in range(2000)]
    return spark.createDataFrame(rows, "slurp_id long, y double, v double, a int, b int, c int")


def test_flags_share_numbers(spark, data, monkeypatch):
    """The same fit with terms as they are and as bits, of one number or of several, and in packs of any size."""
    terms = ["a", "v", "b", "c"]
    want = gee.fit(data, "y", terms)
    for bits, rows in ((62, 1 << 15), (2, 1), (1, 300)):
        monkeypatch.setattr(gee, "BITS", bits)
        monkeypatch.setattr(gee, "PACKED", rows)
        got = gee.fit(data, "y", terms, flags=["a", "b", "c"])
        assert got.terms == want.terms and np.allclose(got.beta, want.beta, atol=1e-9) and np.allclose(got.cov, want.cov, atol=1e-9) and got.n == want.n


def test_packs_hold_distinct_patterns(data):
    """At most 2 outcomes x 4 values x 8 sets of flags, of 2,000 rows; two bytes for each row."""
    one = gee.packed(data.coalesce(1).select(F.col("slurp_id").alias("cluster"), "y", "v", "a", "b", "c"), ["v", "a", "b", "c"], ["a", "b", "c"]).collect()
    assert sum(len(r["codes"]) for r in one) == 4000 and max(len(r["patterns"]) for r in one) <= 64 * 3 * 8


def test_survey_says_what_the_frame_says(spark):
    rows = evaluation._designed(spark, SF)
    for design in designs.designs(evaluation.REFERENCE, evaluation.LARGE).values():
        frame, dropped = designs.frame_of(rows, design)
        flags, terms, levels = designs.flags_of(frame, design)
        _, seen = designs.surveyed(designs.narrowed(rows), design, design.outcome)
        assert (seen.dropped, seen.n, [*seen.terms, *designs._flags(design, seen.levels)], seen.levels) == (dropped, frame.count(), terms, levels)


def test_chains_rows_are_held_without_what_no_design_reads(spark):
    """No character error rate and no rules are made for the models of the chain."""
    rows = designs.narrowed(evaluation.cell_columns(evaluation.chained(spark, SF)).withColumns({"has_critical_error": F.lit(1), "has_function_error": F.lit(1)}))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "bad_enum" not in plan and "error_categories" not in rows.columns
