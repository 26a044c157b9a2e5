"""Filters and projections over evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from uttermark.functions.errors import has_critical_substitution
from uttermark.functions.text import normalize_gold_intent, normalize_predicted_intent, parse_response
from uttermark.keys import cap_wer, is_clean

PREDICTION_FIELDS = [
    "llm_model", "llm_prompt_variant", "predicted_intent_raw", "predicted_intent", "tsa", "pf", "pf_n_gold", "pf_n_matched", "ees", "ees_strict",
    "tsh_category", "tch_category",
]


def filter_scenarios(rows: DataFrame, scenarios: list[str]) -> DataFrame:
    return rows.where(F.col("scenario").isin(scenarios))


def pick_headset(gold: DataFrame) -> DataFrame:
    """Add the first recording whose file name holds ``-headset``; rows without one go."""
    found = F.filter("recordings", lambda r: r["file"].contains("-headset"))
    return gold.where(F.size(found) > 0).withColumn("recording", F.element_at(found, 1)["file"])


def clear_prediction_fields(rows: DataFrame) -> DataFrame:
    """Null what an earlier router wrote; facts of the transcript stay."""
    typed = {f.name: f.dataType for f in rows.schema}
    cleared = {c: F.lit(None).cast(typed[c]) for c in PREDICTION_FIELDS if c in typed}
    if "predicted_parameters" in typed:
        cleared["predicted_parameters"] = F.create_map().cast(typed["predicted_parameters"])
    return rows.withColumns(cleared)


def no_transcription(rows: DataFrame) -> Column:
    """A cascade row whose transcript is missing or blank."""
    return (F.coalesce("pathway", F.lit("cascade")) != "omni") & (F.trim(F.coalesce("transcription", F.lit(""))) == "")


NOTE = "no_transcription"


def stamp_no_transcription(rows: DataFrame) -> DataFrame:
    """Give blank transcripts the intent ``NO_TRANSCRIPTION``, no parameters and a failed score, noted once; rows that
    already have the intent and the score stay as they are, so doing it twice changes nothing."""
    done = F.coalesce((F.col("predicted_intent") == "NO_TRANSCRIPTION") & (F.col("tsa") == 0), F.lit(False))
    blank = no_transcription(rows) & ~done
    notes = F.coalesce("notes", F.lit(""))
    types = {f.name: f.dataType for f in rows.schema}
    values = {
        "predicted_intent_raw": F.lit("NO_TRANSCRIPTION"), "predicted_intent": F.lit("NO_TRANSCRIPTION"), "tsa": F.lit(0),
        "notes": F.when(notes.contains(NOTE), F.col("notes")).otherwise(F.concat(notes, F.lit(f" | {NOTE}"))),
    }
    if "predicted_parameters" in types:
        values["predicted_parameters"] = F.create_map().cast(types["predicted_parameters"])
    return rows.withColumns({c: F.when(blank, v).otherwise(F.col(c)) for c, v in values.items() if c in types})


def _beside_answers(rows: DataFrame, responses: DataFrame, keys: list[str], response: str) -> DataFrame:
    other = responses.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(response).alias("__text"), F.lit(True).alias("__asked"))
    kept = rows.drop("predicted_intent_raw", "predicted_intent", "predicted_parameters", "tsa")
    joined = kept.join(other, [kept[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*(f"__{k}" for k in keys))
    # answers are parsed after the join: their texts take less room on the way than what is parsed from them
    return joined.withColumn("__answer", F.when(F.col("__asked"), parse_response(F.col("__text")))).drop("__text")


def apply_predictions(rows: DataFrame, responses: DataFrame, keys: list[str], known: list[str], response: str = "response") -> tuple[DataFrame, DataFrame]:
    """Rows with the models' answers in them, and rows whose request failed, which are not scored.

    ``responses`` holds ``keys`` and the answer's text. An answer that is no object, or is an error other than a failed
    request, becomes ``JSON_PARSE_ERROR`` with a note; an object without an intent, ``MISSING_INTENT``. Rows without an
    answer are stamped if their transcript is blank and else count as failed. ``tsa`` compares with ``gold_intent``.
    """
    joined = _beside_answers(rows, responses, keys, response)
    failed = request_failed(joined)
    return scored_answers(joined.where(~failed), known), joined.where(failed).drop("__answer", "__asked")


PREDICTED = ["predicted_intent_raw", "predicted_intent", "predicted_parameters", "tsa"]


def with_predictions(rows: DataFrame, responses: DataFrame, keys: list[str], known: list[str], response: str = "response") -> DataFrame:
    """As ``apply_predictions``, in one table and so with one join: rows whose request failed have ``failed`` true and null predictions."""
    joined = _beside_answers(rows, responses, keys, response)
    scored = scored_answers(joined.withColumn("failed", request_failed(joined)), known)
    return scored.withColumns({c: F.when(~F.col("failed"), F.col(c)) for c in PREDICTED})


def request_failed(joined: DataFrame) -> Column:
    """Rows with an ``__answer`` (``parse_response``) whose request failed: no answer but to a blank transcript, or the answer says so."""
    asked = F.coalesce("__asked", F.lit(False))
    return (~asked & ~no_transcription(joined)) | (asked & F.coalesce(F.col("__answer.error") == "llm_request_failed", F.lit(False)))


def scored_answers(joined: DataFrame, known: list[str]) -> DataFrame:
    """Prediction columns, ``tsa`` and notes of rows with an ``__answer`` or, where it was not ``__asked`` for, a blank transcript."""
    blank = ~F.coalesce("__asked", F.lit(False))
    usable = F.col("__answer").isNotNull() & F.col("__answer.error").isNull()
    raw = F.when(usable, F.coalesce("__answer.intent", F.lit("MISSING_INTENT"))).otherwise(F.lit("JSON_PARSE_ERROR"))
    none = F.create_map().cast("map<string,string>")
    notes = F.coalesce("notes", F.lit("")) if "notes" in joined.columns else F.lit("")
    scored = joined.withColumns(
        {
            "predicted_intent_raw": F.when(~blank, raw),
            "predicted_parameters": F.when(usable, F.coalesce("__answer.parameters", none)).otherwise(none),
            "notes": F.when(usable | blank, notes).otherwise(F.concat(notes, F.lit(" | output is not JSON"))),
        }
    )
    scored = scored.withColumn("predicted_intent", F.when(usable, normalize_predicted_intent(F.col("predicted_intent_raw"), known)).otherwise(F.col("predicted_intent_raw")))
    right = F.coalesce(F.col("predicted_intent") == F.col("gold_intent"), F.lit(False))
    scored = scored.withColumn("tsa", F.when(F.col("predicted_intent").isNotNull(), right.cast("int"))).drop("__answer", "__asked")
    return stamp_no_transcription(scored)


def no_transcription_violations(rows: DataFrame) -> DataFrame:
    return rows.where(no_transcription(rows) & ~F.col("predicted_intent").eqNullSafe("NO_TRANSCRIPTION"))


def drop_hallucinations(rows: DataFrame) -> DataFrame:
    """Drop rows marked as full hallucinations; an unknown mark stays."""
    return rows.where(~F.coalesce("full_hallucination", F.lit(False)))


def reference_rows(rows: DataFrame, asr: str, routers: list[str]) -> DataFrame:
    """Every omni row, and cascade rows of one recogniser and some routers."""
    return rows.where((F.col("pathway") == "omni") | (F.col("asr") == asr) & F.col("llm").isin(routers))


def critical_substitution_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("pathway") == "cascade") & F.col("phonetic_distance").isNotNull() & has_critical_substitution(F.col("error_categories")))


def failing_rows(rows: DataFrame) -> DataFrame:
    return rows.where("tsa = 0").select("slurp_id", "asr_model", "llm_model", "degradation", "snr_db", "gold_intent", "predicted_intent")


def snr_dummies(snr: Column) -> tuple[Column, Column]:
    """Flags of 20 and 10 dB; 0 dB and clean have neither."""
    return F.coalesce((snr == 20).cast("int"), F.lit(0)), F.coalesce((snr == 10).cast("int"), F.lit(0))


def degradation_group(c: Column, preserving: list[str], destroying: list[str]) -> Column:
    unknown = F.raise_error(F.concat(F.lit("unknown degradation "), c)).cast("string")
    return F.when(c == "clean", "clean").when(c.isin(preserving), "preserving").when(c.isin(destroying), "destroying").otherwise(unknown)


def frame_reason(outcome: str, clamp: bool = True, drop_full: bool = False) -> Column:
    """Why a row leaves the regression frame, the first reason that holds, or null."""
    gone = F.coalesce("full_hallucination", F.lit(False)) if drop_full else F.lit(False)
    return F.when(gone, "full_hallucination").when(F.col(outcome).isNull(), "null_outcome").when(F.col("wer").isNull(), "null_wer")


def build_frame(rows: DataFrame, outcome: str = "ees", drop_full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Regression frame (capped rate, dummies) and the count of dropped rows by reason."""
    marked = rows.withColumn("drop_reason", frame_reason(outcome, drop_full=drop_full))
    counts = marked.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))
    s20, s10 = snr_dummies(F.col("snr_db"))
    frame = marked.where("drop_reason is null").drop("drop_reason")
    return frame.withColumns({"wer": cap_wer(), "snr_20": s20, "snr_10": s10}), counts


def contrast_frame(rows: DataFrame, degradation: str, snr_db: int | None = None) -> DataFrame:
    """The clean arm and one degraded arm, with ``treated``."""
    arm = F.col("degradation") == degradation
    if snr_db is not None:
        arm = arm & (F.col("snr_db") == snr_db)
    return rows.where(is_clean() | arm).withColumn("treated", (~is_clean()).cast("int"))


def join_gold(rows: DataFrame, gold: DataFrame, key: str = "slurp_id") -> DataFrame:
    """Sentence, tokens and entities beside every row; a row without gold keeps nulls, and ``has_gold`` is false."""
    side = gold.select(key, *(c for c in ("sentence", "tokens", "entities") if c in gold.columns)).dropDuplicates([key])
    joined = rows.join(side.withColumn("has_gold", F.lit(True)), key, "left")
    return joined.withColumn("has_gold", F.coalesce("has_gold", F.lit(False)))


def override_labels(gold: DataFrame, corrected: DataFrame, known: list[str], key: str = "slurp_id") -> DataFrame:
    """Gold rows with ``label`` and ``overridden``: a corrected label wins, else the row's own; both are normalised."""
    fixed = corrected.select(key, F.col("label").alias("__fixed")).where("__fixed is not null").dropDuplicates([key])
    joined = gold.join(fixed, key, "left")
    label = normalize_gold_intent(F.coalesce("__fixed", "gold_intent"), F.col("scenario"), known)
    return joined.withColumns({"label": label, "overridden": F.col("__fixed").isNotNull()}).drop("__fixed")


def router_arm(rows: DataFrame) -> DataFrame:
    """The rows, if they are of one router; an error otherwise, since pooling would multiply transcript counts."""
    n = rows.agg(F.count_distinct("llm_model").alias("n"))
    one = F.when(F.col("n") > 1, F.raise_error(F.lit("rows of more than one router")).cast("boolean")).otherwise(True)
    return rows.crossJoin(F.broadcast(n)).where(one).drop("n")


def sample_n(rows: DataFrame, n: int, seed: int, key: str = "slurp_id") -> DataFrame:
    """n rows by a seeded hash of the key; all when n is 0 or less."""
    return rows if n <= 0 else rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def top_examples(rows: DataFrame, category: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each category in an explicit order."""
    w = W.partitionBy(category).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def duplicate_keys(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Second and later rows of a key in a file, with the line of the first."""
    w = W.partitionBy("file", *keys).orderBy("line")
    ranked = lines.withColumns({"rank": F.row_number().over(w), "first_line": F.first("line").over(w)})
    return ranked.where("rank > 1").drop("rank")


def waterfall(parts: DataFrame, order: str, value: str) -> DataFrame:
    """Running start and end of signed components of one short table."""
    w = W.partitionBy("group").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(value).over(w)
    return parts.withColumns({"start": end - F.col(value), "end": end})
