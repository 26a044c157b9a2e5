"""Means and medians of cells over counts of distinct error rates."""

import pytest

from uttermark.operators import cells as C

SCHEMA = "asr string, degradation string, snr_db int, llm string, wer double, tsa int, pf double, ees int, ees_strict int"


def rows(spark, data):
    return spark.createDataFrame([("a", "noise", snr, "l", w, t, p, t, None) for snr, w, t, p in data], SCHEMA)


def test_upper_median_and_nulls(spark):
    data = [(0, w, 1, None) for w in (0.1, 0.4, 0.4, 3.0)] + [(10, w, 0, 0.5) for w in (2.0, 0.25, None, 0.5)] + [(20, None, None, 1.0)] + [(None, w, 1, 0.0) for w in (0.2, 0.7)]
    got = {r["snr_db"]: r for r in C.report_cells(rows(spark, data)).collect()}
    assert {k: (r["n"], r["n_collapse"], r["median_upper"]) for k, r in got.items()} == {0: (4, 1, 0.4), 10: (4, 1, 0.5), 20: (1, 0, None), None: (2, 0, 0.7)}
    assert [got[0][f"mean_{c}"] for c in ("tsa", "pf", "ees", "ees_strict")] == [1.0, None, 1.0, None]
    assert got[0]["mean_wer"] == pytest.approx(1.9 / 4) and got[10]["mean_wer"] == pytest.approx(1.75 / 3)
    assert (got[20]["mean_wer"], got[20]["mean_tsa"], got[20]["mean_pf"]) == (None, None, 1.0)


def test_rows_are_not_sorted_by_cell(spark):
    """Percentiles over the rows sort all of them once there are more cells than a task's object hash map takes."""
    plan = C.report_cells(rows(spark, [(i, 0.5, 1, 0.5) for i in range(200)]))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "percentile" not in plan
