"""Scored and failed rows come from one join with the answers."""

from uttermark.operators import rows as R
from uttermark.plans import evaluation


def test_one_join_with_texts_of_answers(spark):
    plan = evaluation.QUERIES["p7_apply_predictions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftOuter") == 1


def test_one_table_holds_what_two_hold(spark):
    texts = ['{"intent":"alarm_set","parameters":{"a":"b"}}', "{}", "no json", '{"error":"llm_request_failed"}', '{"error":"other"}', "null", None]
    rows = spark.createDataFrame([(i, f"m{i % 2}" if i % 3 else None, "cascade", "" if i % 5 == 0 else "said", None, "alarm_set") for i in range(40)], "slurp_id long, asr_model string, pathway string, transcription string, notes string, gold_intent string")
    asked = spark.createDataFrame([(i, f"m{i % 2}" if i % 3 else None, texts[i % 7]) for i in range(40) if i % 4], "slurp_id long, asr_model string, response string")
    keys, known = ["slurp_id", "asr_model"], ["alarm_set"]
    scored, failed = R.apply_predictions(rows, asked, keys, known)
    made = ["predicted_intent_raw", "predicted_intent", "predicted_parameters", "tsa"]
    got = {r["slurp_id"]: r.asDict(True) for r in R.with_predictions(rows, asked, keys, known).collect()}
    want = {r["slurp_id"]: r.asDict(True) for r in scored.collect()}
    assert {i for i, r in got.items() if r["failed"]} == {r["slurp_id"] for r in failed.collect()} and len(got) == 40
    assert all(got[i][c] == r[c] for i, r in want.items() for c in [*made, "notes"])
    assert all(got[i][c] is None for i in got if got[i]["failed"] for c in made)
