"""Readers, writers, validation and incremental scoring on small files."""

import gzip
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.operators import rows as R
from uttermark.operators import validate as V
from uttermark.operators.validate import schema_report, unparseable_lines, validate_rows
from uttermark.schema import evaluation_schema
from uttermark.sources import files
from uttermark.streaming.scoring import incremental_scoring, state_size, stateful_scoring

ROW = {
    "slurp_id": 1, "audio_file": "a", "scenario": "alarm", "gold_sentence": "set it", "gold_intent": "alarm_set", "gold_parameters": {"time": "seven am"},
    "pathway": "cascade", "model_family": "qwen", "asr_model": "o/a", "degradation": "noise", "snr_db": 10, "rng_seed": 1, "transcription": "set it", "wer": 0.0,
    "cer": 0.0, "slot_error_rate": 0.0, "error_categories": [], "phonetic_distance": None, "full_hallucination": False, "llm_model": "o/l",
    "llm_prompt_variant": "v", "predicted_intent_raw": "alarm_set", "predicted_intent": "alarm_set", "predicted_parameters": {"time": "7 am"}, "tsa": 1, "ees": 1,
    "ees_strict": 1, "pf": 1.0, "pf_n_gold": 1, "pf_n_matched": 1, "tsh_category": None, "tch_category": None, "notes": None,
}


def put(path, rows, opener=open):
    with opener(path, "wt") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n\n")


def test_read_rows_keeps_bad_lines_and_types(spark, tmp_path):
    put(tmp_path / "a_scored.jsonl", [ROW, "{broken", {**ROW, "slurp_id": 2, "snr_db": None, "degradation": "clean"}])
    put(tmp_path / "b_scored.jsonl.gz", [{**ROW, "slurp_id": 3}], gzip.open)
    rows = files.read_rows(spark, str(tmp_path), partitions=2).cache()
    good = rows.where("_corrupt is null")
    assert sorted(r["slurp_id"] for r in good.collect()) == [1, 2, 3]
    assert [r["n"] for r in unparseable_lines(rows).collect()] == [1]
    assert validate_rows(good.drop("_corrupt", "file", "block", "line")).where(F.size("violations") > 0).isEmpty()
    order = [r["slurp_id"] for r in good.where("file like '%a_scored%'").orderBy("file", "block", "line").collect()]
    assert order == [1, 2]


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"pathway": "both"}, "bad_enum"),
        ({"snr_db": None}, "degraded_row_has_no_snr"),
        ({"degradation": "clean"}, "clean_row_has_snr"),
        ({"wer": -1.0}, "value_out_of_range"),
        ({"asr_model": None}, "cascade_asr_model_null"),
        ({"transcription": None}, "cascade_transcript_field_null"),
        ({"cer": None}, "cascade_metric_null"),
        ({"llm_model": None}, "null_not_allowed"),
        ({"pathway": "omni", "error_categories": [("insert", None, "function", "", "x", None)]}, "omni_error_categories_not_empty"),
        ({"pf": None}, "pf_null_mismatch"),
        ({"ees": 0, "ees_strict": 0, "pf": 0.0, "pf_n_matched": 0}, "tch_category_missing"),
        ({"pathway": "omni"}, "omni_field_not_null"),
        ({"pf_n_matched": 2}, "pf_counters_impossible"),
        ({"pf": 0.5}, "pf_not_recall"),
        ({"ees": 0}, "ees_formula"),
        ({"ees_strict": 0}, "ees_strict_formula"),
        ({"phonetic_distance": 0.1}, "phonetic_distance_unsupported"),
        ({"full_hallucination": True}, "full_hallucination_definition"),
        ({"tsa": 0, "ees": 0, "ees_strict": 0}, "tsh_category_missing"),
        ({"tsh_category": "wrong"}, "tsh_category_on_a_success"),
    ],
)
def test_each_rule(spark, change, rule):
    row = {**ROW, **change}
    schema = evaluation_schema()
    df = spark.createDataFrame([tuple(row[n] for n in schema.names)], schema)
    broken = {v["rule"] for v in validate_rows(df).first()["violations"]}
    assert rule in broken
    assert rule in {r["rule"] for r in schema_report(validate_rows(df)).collect()}


def test_missing_field(spark):
    schema = T.StructType([f for f in evaluation_schema().fields if f.name != "notes"])
    df = spark.createDataFrame([tuple(ROW[n] for n in schema.names)], schema)
    assert [(v["rule"], v["field"]) for v in validate_rows(df).first()["violations"]] == [("missing_field", "notes")]


def test_file_kinds(spark):
    kinds = {
        "cascade_whisper_qwen9b_noise_snr10_scored.jsonl": "sweep", "parakeet_clean_gemma31b_scored.jsonl": "sweep", "omni_qwen_sweep_scored.jsonl": "omni",
        "omni_pilot_qwen_scored.jsonl": "pilot", "h2a_pilot_x_scored.jsonl": "pilot", "baseline_x_scored.jsonl": "baseline",
    }
    df = spark.createDataFrame([(f"d/{n}",) for n in kinds], "file string")
    assert [r["k"] for r in df.select(files.file_kind(F.col("file")).alias("k")).collect()] == list(kinds.values())
    assert files.select_result_set(df, ["omni"]).count() == 1
    for name in ("x.txt", "omni_qwen3_sweep_scored.jsonl", "stray_scored.jsonl", "omni_qwen_sweep_scored.jsonl.bak", "xomni_gemma_sweep_scored.jsonl"):
        with pytest.raises(Exception, match="unclassified"):
            files.select_result_set(spark.createDataFrame([(f"d/{name}",)], "file string"), ["omni"]).collect()


def test_lines_of_json(spark):
    """Presence, types and shapes, which typed rows cannot show."""
    bad = {
        "ok": ROW, "wrong": {**ROW, "wer": "x"}, "bool": {**ROW, "tsa": True}, "gone": {k: v for k, v in ROW.items() if k != "notes"}, "null": {**ROW, "scenario": None},
        "chunk": {**ROW, "error_categories": [{"type": "insert"}]}, "number": {**ROW, "error_categories": [3]}, "list": [1], "int": {**ROW, "wer": 1}, "new": {**ROW, "other": 1},
    }
    data = [(k, json.dumps(v)) for k, v in bad.items()] + [("broken", "{x"), ("blank", "  ")]
    lines = spark.createDataFrame(data, "nr string, value string")
    got = {r["nr"]: {(v["rule"], v["field"]) for v in r["violations"]} for r in V.validate_lines(lines).collect()}
    assert got["ok"] == got["int"] == got["new"] == set() and "blank" not in got
    assert got["wrong"] == {("wrong_type", "wer"), ("cascade_metric_null", "wer")} and got["bool"] == {("wrong_type", "tsa")}
    assert got["gone"] == {("missing_field", "notes")} and got["null"] == {("null_not_allowed", "scenario")}
    assert got["chunk"] == got["number"] == {("error_chunk_keys", "error_categories")}
    assert got["list"] == {("not_an_object", "value")} and got["broken"] == {("unparseable_line", "value")}
    assert [(r["field"], r["n"]) for r in V.extra_fields(lines).collect()] == [("other", 1)]
    report = {(r["rule"], r["field"]): r for r in schema_report(V.validate_lines(lines), "nr", examples=1).collect()}
    one = report["error_chunk_keys", "error_categories"]
    assert (one["n"], one["keys"], one["first"], one["examples"], one["source"]) == (2, 2, "chunk", ["chunk"], "row") and one["message"]


def test_own_rules_observed_and_duplicates(spark, tmp_path):
    schema = evaluation_schema()
    row = {**ROW, "tsa": 0, "ees": 0, "ees_strict": 0, "snr_db": None}
    df = spark.createDataFrame([tuple(row[n] for n in schema.names)], schema)
    every = {v["rule"] for v in validate_rows(df).first()["violations"]}
    assert {v["rule"] for v in validate_rows(df, own_only=True).first()["violations"]} == every - {"tsh_category_missing"}
    assert "bad_enum" in {v["rule"] for v in validate_rows(df, intents=["x"]).first()["violations"]}
    seen = {(r["what"], r["value"]): r["n"] for r in V.observed(df).collect()}
    assert seen["pathway", "cascade"] == 1 and seen["notes_null", "rows"] == 1 and ("pf_null", "rows") not in seen
    again = df.withColumns({"file": F.lit("f"), "line": F.lit(1)}).unionByName(df.withColumns({"file": F.lit("f"), "line": F.lit(2)}))
    found = V.duplicate_violations(again).first()
    assert (found["line"], found["first_line"], found["violations"][0]["rule"]) == (2, 1, "duplicate_resume_key")
    put(tmp_path / "there.jsonl", [ROW])
    missing = V.unreadable_files(spark, [str(tmp_path / "there.jsonl"), str(tmp_path / "gone.jsonl")]).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["violations"][0]["rule"]) for r in missing] == [("gone.jsonl", "unreadable_file")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "noise", True), (2, "clean", None)], "slurp_id long, degradation string, bad boolean")
    with pytest.raises(ValueError, match="overwrite"):
        files.write_rows(df, f"{tmp_path}/x/", source=f"file:{tmp_path}/x")
    files.write_rows(df, f"{tmp_path}/y", source=f"{tmp_path}/x")
    assert spark.read.json(f"{tmp_path}/y").count() == 2
    assert not files.write_table(df.limit(0), f"{tmp_path}/t") and files.write_table(df, f"{tmp_path}/t")
    files.split_failures(df, F.col("bad"), f"{tmp_path}/ok", f"{tmp_path}/failed")
    files.split_failures(df, F.col("bad"), f"{tmp_path}/ok", f"{tmp_path}/failed")  # a repeated run replaces its rows
    assert [r["slurp_id"] for r in spark.read.parquet(f"{tmp_path}/ok").collect()] == [2]
    assert [r["slurp_id"] for r in spark.read.parquet(f"{tmp_path}/failed").collect()] == [1]


def test_incremental_scoring_scores_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: incremental_scoring(spark, evaluation_schema(), str(source), f"{tmp_path}/sink", f"{tmp_path}/failed", f"{tmp_path}/cp").awaitTermination(60)
    put(source / "1.jsonl", [ROW, {**ROW, "slurp_id": 2, "predicted_intent": None}, {**ROW, "slurp_id": 3, "predicted_parameters": {}}])
    run()
    put(source / "2.jsonl", [ROW, {**ROW, "slurp_id": 2}])
    run()
    run()
    got = {r["slurp_id"]: (r["tsa"], r["pf"], r["ees"]) for r in spark.read.parquet(f"{tmp_path}/sink").collect()}
    assert got == {1: (1, 1.0, 1), 2: (1, 1.0, 1), 3: (1, 0.0, 0)}
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 3 and spark.read.parquet(f"{tmp_path}/failed").count() == 1


def _stateful(spark, tmp_path, remember):
    names = [str(tmp_path / n) for n in ("in", "sink", "failed", "cp")]
    queries = stateful_scoring(spark, evaluation_schema(), *names, remember=remember)
    for q in queries:
        assert q.awaitTermination(90) and q.exception() is None
    rows = lambda n: [r.asDict() for r in spark.read.parquet(f"{tmp_path}/{n}").collect()]
    return rows("sink"), rows("failed"), state_size(queries[0])


def test_stateful_scoring_over_restarts(spark, tmp_path):
    """The same key in three batches, each run a restart from the checkpoint: scored once; failures come again until they are answered."""
    (tmp_path / "in").mkdir()
    omni = {**ROW, "slurp_id": 5, "pathway": "omni", "asr_model": None, "snr_db": None, "degradation": "clean"}
    lost = {**ROW, "slurp_id": 2, "predicted_intent": None}
    put(tmp_path / "in/1.jsonl", [ROW, ROW, lost, omni])
    sink, failed, state = _stateful(spark, tmp_path, "1 hour")
    assert sorted(r["slurp_id"] for r in sink) == [1, 5] and [r["slurp_id"] for r in failed] == [2] and state["keys"] == 2
    put(tmp_path / "in/2.jsonl", [{**ROW, "predicted_intent": "other"}, lost, omni, {**ROW, "snr_db": 0}])
    sink, failed, state = _stateful(spark, tmp_path, "1 hour")
    assert sorted((r["slurp_id"], r["snr_db"]) for r in sink if r["snr_db"] is not None) == [(1, 0), (1, 10)] and len(failed) == 2 and state["keys"] == 3
    put(tmp_path / "in/3.jsonl", [ROW, {**ROW, "slurp_id": 2}, omni])
    sink, failed, state = _stateful(spark, tmp_path, "1 hour")
    assert len(sink) == 4 and {(r["slurp_id"], r["tsa"], r["ees"]) for r in sink} == {(1, 1, 1), (2, 1, 1), (5, 1, 1)} and len(failed) == 2
    assert state["keys"] == 4 and state["bytes"] > 0 and state["late"] == 0


def test_state_forgets_keys_after_their_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        put(tmp_path / f"in/{i}.jsonl", [{**ROW, "slurp_id": 100 * i + j} for j in range(20)])
        _, _, state = _stateful(spark, tmp_path, "1 second")
        time.sleep(2.5)
    put(tmp_path / "in/again.jsonl", [{**ROW, "slurp_id": 1}])
    sink, _, state = _stateful(spark, tmp_path, "1 second")
    assert len(sink) == 81 and state["keys"] < 60  # the first keys are gone, and one of them was scored again


def test_read_gold_and_logs(spark, tmp_path):
    gold = {"slurp_id": 1, "sentence": "set it", "tokens": [{"surface": "set", "other": 1}, {"surface": "it"}], "entities": [{"type": "time", "span": [1]}], "scenario": "alarm", "intent": "set", "recordings": [{"file": "audio-1-headset.flac"}]}
    put(tmp_path / "gold.jsonl", [gold, {**gold, "slurp_id": None}, "{broken", {"slurp_id": 2}])
    rows = {r["slurp_id"]: r for r in files.read_gold(spark, str(tmp_path / "gold.jsonl")).collect()}
    assert set(rows) == {1, 2} and [t["surface"] for t in rows[1]["tokens"]] == ["set", "it"] and rows[1]["entities"][0]["span"] == [1]
    assert rows[2]["sentence"] is None and rows[2]["tokens"] is None
    (tmp_path / "log.csv").write_text('slurp_id,status,reason\n7,removed,"noise, and more"\n8,,\n')
    log = {r["slurp_id"]: r for r in files.read_logs(spark, str(tmp_path / "log.csv")).collect()}
    assert log["7"]["reason"] == "noise, and more" and log["8"]["status"] is None


def test_scenarios_and_headsets(spark):
    data = [(1, "alarm", ["a.flac", "b-headset.flac", "c-headset.flac"]), (2, "music", ["a.flac"]), (3, None, []), (4, "alarm", None), (5, "play", [None, "x-headset.flac"])]
    gold = spark.createDataFrame([(i, s, None if f is None else [(x,) for x in f]) for i, s, f in data], "slurp_id long, scenario string, recordings array<struct<file:string>>")
    assert [r["slurp_id"] for r in R.filter_scenarios(gold, ["alarm", "play"]).orderBy("slurp_id").collect()] == [1, 4, 5]
    assert R.filter_scenarios(gold, []).count() == 0
    assert {r["slurp_id"]: r["recording"] for r in R.pick_headset(gold).collect()} == {1: "b-headset.flac", 5: "x-headset.flac"}
