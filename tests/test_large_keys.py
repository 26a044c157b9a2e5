"""Evaluation rows of parts with keys beyond those of the test tables."""

import pytest

from uttermark.plans import evaluation, fixtures


def errors(key: int, asr: int, cond: int) -> tuple[int, int]:
    """Errors and reference words of a row, in whole numbers of any size."""
    n_ref, sev = 4 + key % 9, 0 if cond == 0 else (cond - 1) % 3 + 1
    x1 = key * 7919 + max(asr, 0) * 104729 + cond * 1299709
    h1 = x1 * x1 % 1000003 % 1000
    return n_ref + h1 % 4 if h1 >= 985 else max(0, h1 * (3 + 4 * sev) // 1000 - 1), n_ref


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("large")
    spark.createDataFrame([(k,) for k in (7, 19_999, 383_500, 1_199_999, 7_199_999, 50_000_000)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    return str(d)


def test_squares_of_large_keys_do_not_overflow(spark, large):
    rows = fixtures.eval_rows(spark, large).collect()
    assert len(rows) == 6 * 209
    for r in rows:
        assert (r["e"], r["n_ref"]) == errors(r["slurp_id"], -1 if r["asr_model"] is None else int(r["asr_model"][-1]), r["cond"])


def test_summary_of_large_keys(spark, large):
    got = {(r["by"], r["value"]): r["n"] for r in evaluation.QUERIES["a17_annotation_summary"](spark, large).collect()}
    every = [errors(k, a, c)[0] for k in (7, 19_999, 383_500, 1_199_999, 7_199_999, 50_000_000) for a in range(3) for c in range(19) for _ in range(3)]
    assert got["rows", "with_errors"] == sum(e > 0 for e in every)
    assert sum(n for (by, _), n in got.items() if by == "position") == sum(every) == sum(n for (by, _), n in got.items() if by == "kind")


@pytest.mark.parametrize("name", ["a6_paired_incremental", "a7_calibrated_stats", "a8_calibrated_paired", "a11_report_cells", "a13_condition_grid"])
def test_filters_do_not_repeat_the_arithmetic_of_rows(spark, large, name):
    """A filter on error rates or outcomes must not be pushed into the cross join as an expression that grows with every mention."""
    plan = evaluation.QUERIES[name](spark, large)._jdf.queryExecution().optimizedPlan()
    arithmetic = [x for x in plan.toString().splitlines() if "% 1000003" in x]
    assert arithmetic and not any("Join" in x or "Filter" in x for x in arithmetic)


def test_schema_report_reads_its_rows_once(spark, large):
    """Fields that are never there are not counted row by row, and no second pass is made for examples that nobody asked for."""
    report = evaluation.QUERIES["v1_schema_report"](spark, large)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [p_partkey") == 1 and plan.count("violations") <= 2
    assert not any("Join" in x and "% 1000003" in x for x in plan.splitlines())
    assert [tuple(r) for r in report.collect()] == [("clean_row_has_snr", "snr_db", 11, 1, 383_500)]
