"""Operators on hand-made rows, and every query with SQL against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uttermark.functions import errors as E
from uttermark.functions import params as P
from uttermark.functions import text as X
from uttermark.keys import cell_columns
from uttermark.operators import cells as C
from uttermark.operators import models as M
from uttermark.operators import pairs as J
from uttermark.operators import rows as R
from uttermark.plans import evaluation

SF = "/root/testdata/sf0.001"
ROW = "slurp_id long, asr_model string, llm_model string, pathway string, degradation string, snr_db int, wer double, ees int, tsa int"


def rows(spark, data):
    return cell_columns(spark.createDataFrame(data, ROW))


def item(i, wer, ees, clean_ees=1):
    return [
        (i, "o/asr", "o/llm", "cascade", "clean", None, 0.0, clean_ees, clean_ees),
        (i, "o/asr", "o/llm", "cascade", "noise", 0, wer, ees, ees),
    ]


def test_gain_of_ten_items(spark):
    df = rows(spark, [r for i in range(10) for r in item(i, 0.5, int(i < 8))])
    got = C.paired_stats(df).first()
    assert (got["n_paired"], got["retention"], got["naive_paired"]) == (10, 0.8, 0.5)
    assert got["gain_paired"] == pytest.approx(0.3) and got["underpowered"]


def test_perfect_rows_leave_gain_ceiling(spark):
    for extra, legacy in ((10, -0.25), (90, -0.45)):
        data = [(i, "a", "l", "cascade", "noise", 0, 0.5, int(i < 5), 1) for i in range(10)]
        data += [(100 + i, "a", "l", "cascade", "noise", 0, 0.0, 1, 1) for i in range(extra)]
        got = C.cell_stats(rows(spark, data)).first()
        assert got["gain_ceiling"] == pytest.approx(0) and got["gain_legacy"] == pytest.approx(legacy)


def test_even_median(spark):
    data = [(i, "a", "l", "cascade", "noise", 0, w, 1, 1) for i, w in enumerate((0.0, 0.2, 0.4, 0.6))]
    assert C.cell_stats(rows(spark, data)).first()["median_wer"] == pytest.approx(0.3)


def test_transitions_and_missing_anchor(spark):
    data = item(1, 0.5, 0) + item(2, 0.5, 1) + item(3, 0.0, 0) + item(4, 0.5, 1, 0) + item(5, 0.1, 0, 0)[1:]
    df = rows(spark, data)
    got = {r["category"]: r["n"] for r in J.classify_pairs(df).collect()}
    assert got == {"PROPAGATED": 1, "ABSORBED": 1, "NEW_ERROR": 1, "RECOVERED": 1}
    assert C.paired_stats(df).first()["n_dropped_no_anchor"] == 1


def test_pathway_gain_and_refusal(spark):
    side = lambda p, asr, ys, ws: [(i, asr, f"o/{p}", p, "noise", 0, w, y, y) for i, (y, w) in enumerate(zip(ys, ws, strict=True))]
    data = side("cascade", "o/asr", (0, 1, 0), (0.5, 0.0, 0.3)) + side("omni", None, (1, 0, 1), (None,) * 3)
    df = rows(spark, data).withColumn("model_family", F.lit("f"))
    got = J.pathway_stats(J.pathway_pairs(df, "asr")).first()
    assert (got["n_pairs"], got["gain_pathway"]) == (2, 1.0)
    with pytest.raises(Exception, match="twice"):
        J.pathway_stats(J.pathway_pairs(df.unionByName(df), "asr")).collect()


def test_calibration_recovers_a_planted_curve_and_refuses(spark):
    rng = np.random.default_rng(1)
    w = rng.random(4000).round(2)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.0 - 3.0 * w)))).astype(int)
    data = [(i, "a", "l", "cascade", "clean", None, float(a), int(b), int(b)) for i, (a, b) in enumerate(zip(w, y, strict=True))]
    data += [(i, "b", "l", "cascade", "clean", None, i / 10, int(i < 3), 1) for i in range(8)]
    data += [(i, "c", "l", "cascade", "clean", None, i / 10, 1, 1) for i in range(8)]
    got = {r["asr"]: r for r in M.clean_calibration(rows(spark, data)).collect()}
    assert abs(got["a"]["a"] - 1) < 0.25 and abs(got["a"]["b"] + 3) < 0.5 and got["a"]["refused"] is None
    assert "separates" in got["b"]["refused"] and got["b"]["a"] is None
    assert "does not vary" in got["c"]["refused"]


def test_bootstrap_does_not_depend_on_partitions_and_brackets(spark):
    data = [(i, "a", "l", "cascade", "noise", 0, 0.5, int(i % 10 < 7), 1) for i in range(400)]
    df = rows(spark, data).withColumn("one", F.lit(1.0))
    cell = ["asr", "snr_db"]
    a = M.replicate_sums(df.repartition(1), cell, ["one", "ees"], 200)
    b = M.replicate_sums(df.repartition(7), cell, ["one", "ees"], 200)
    key = lambda r: (r["replicate"], r["one"], r["ees"])
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    got = M.interval(a, cell, F.col("ees") / F.col("one")).first()
    assert got["lo"] < 0.7 < got["hi"] and 0.05 < got["hi"] - got["lo"] < 0.15


def test_mcnemar():
    assert J.mcnemar(0, 0) == 1.0 and J.mcnemar(5, 5) == 1.0
    assert J.mcnemar(0, 5) == pytest.approx(2 / 32)


def test_the_first_clean_row_is_the_anchor(spark):
    """Repeated clean rows: the one that stands first in its file counts, or the first of a given order."""
    data = [(1, "a", "l", "cascade", "clean", None, 0.1, 1, 1), (1, "a", "l", "cascade", "clean", None, 0.2, 0, 0), (1, "a", "l", "cascade", "noise", 0, 0.5, 1, 1)]
    df = rows(spark, data).withColumns({"file": F.lit("f"), "line": F.when(F.col("wer") == 0.1, 4).when(F.col("wer") == 0.2, 9).otherwise(12)})
    assert J.anchors(df).first()["clean_outcome"] == 1 and J.paired_rows(df).count() == 1
    last = df.withColumn("turn", -F.col("line"))
    assert J.anchors(last, order=["turn"]).first()["clean_outcome"] == 0 and J.paired_rows(last, order=["turn"]).isEmpty()
    assert C.paired_stats(df).first()["n_paired"] == 1 and C.paired_stats(last, order=["turn"]).first()["n_paired"] == 0


def test_blank_transcripts_are_stamped_once(spark):
    df = spark.createDataFrame(
        [(1, "cascade", " ", "x", 1, None, "y", {"a": "b"}), (2, "omni", None, "x", 1, None, "y", {"a": "b"}), (3, "cascade", "hi", "x", 1, "n", "y", {})],
        "slurp_id long, pathway string, transcription string, predicted_intent string, tsa int, notes string, predicted_intent_raw string, predicted_parameters map<string,string>",
    )
    once = R.stamp_no_transcription(df)
    got = {r["slurp_id"]: (r["predicted_intent_raw"], r["predicted_parameters"], r["notes"]) for r in once.collect()}
    assert got == {1: ("NO_TRANSCRIPTION", {}, " | no_transcription"), 2: ("y", {"a": "b"}, None), 3: ("y", {}, "n")}
    assert once.collect() == R.stamp_no_transcription(once).collect()
    assert [r["predicted_intent"] for r in once.orderBy("slurp_id").collect()] == ["NO_TRANSCRIPTION", "x", "x"]
    assert R.no_transcription_violations(once).isEmpty() and R.no_transcription_violations(df).count() == 1


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_text_and_values(spark):
    c = F.col("a")
    assert one(spark, X.normalize_text(c), a="It's  OK, Go!") == "it s ok go"
    assert one(spark, X.normalize_hyp(c), a="It’s o'clock") == "its oclock"
    assert one(spark, X.normalize_text(c), a=None) == ""
    assert one(spark, P.normalize_value(c), a=" Seven  AM. ") == "7 am"
    for g, p, want in (("seven am", "7 am", True), ("the office party", "the morning", False), ("ab", "abc", False), ("meeting", "my meeting", True), ("", "x", False)):
        assert one(spark, P.soft_match(c, F.col("b")), a=g, b=p) is want
    assert one(spark, X.parse_response(c), a='```json\n{"intent":"x"}\n```')["intent"] == "x"
    assert one(spark, X.parse_response(c), a="nothing") is None


def _distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=8))
@settings(max_examples=150, deadline=None)
def test_alignment_is_a_least_cost_edit(ref, hyp):
    chunks = E.align(ref, hyp)
    cost = sum(max(c[2] - c[1], c[4] - c[3]) for c in chunks)
    assert cost == _distance(ref, hyp)
    out, at = [], 0
    for _kind, a, b, x, y in chunks:
        out += ref[at:a] + hyp[x:y]
        at = b
    assert out + ref[at:] == hyp


@pytest.mark.parametrize("name", sorted(evaluation.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")

    def norm(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v

    df = evaluation.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(evaluation.SQL[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == cols
    want = Counter(str([norm(r[at[c]]) for c in cols]) for r in rel.fetchall())
    assert Counter(str([norm(r[c]) for c in cols]) for r in df.collect()) == want


def test_alignment_and_hallucination_read_all_words_of_all_turns(spark, tmp_path):
    turns = [(1, 0, "user", " ".join(f"w{i}" for i in range(30))), (1, 1, "assistant", " ".join(f"v{i}" for i in range(20))), (2, 0, "assistant", "")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want, keys = Counter(), set()
    for conv, turn, _, text in turns[:2]:
        ref, tid = text.split(), conv * 1000 + turn
        for cond in range(4):
            hyp = []
            for j, w in enumerate(ref, 1):
                k = (tid * 31 + j * 17 + cond * 7) % 12
                hyp += [w] if cond == 0 else [] if k < cond else [w[::-1]] if k == 5 else [w, "uh"] if k == 8 else [w]
            keys.add((tid, cond))
            want.update((text, " ".join(hyp), *c) for c in E.align(ref, hyp))
    got = evaluation.QUERIES["f21_align_words"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r[c] for c in ("ref", "hyp", "type", "ref_start", "ref_end", "hyp_start", "hyp_end")) for r in got) == want
    assert max(r["ref_end"] for r in got) > 12
    got = evaluation.QUERIES["f28_full_hallucination"](spark, str(tmp_path)).collect()
    assert {(r["tid"], r["cond"]) for r in got} == keys and not any(r["full_hallucination"] for r in got)


def test_answers_become_rows(spark):
    cols = "slurp_id long, pathway string, transcription string, gold_intent string, notes string"
    df = spark.createDataFrame([(i, "cascade", "" if i == 6 else "t", "alarm_set", None) for i in range(8)], cols)
    answers = ['{"intent":"alarm_set","parameters":{"a":"b"}}', '{"intent":"Set Alarm"}', '{"x":1}', "null", "no json", '{"error":"llm_request_failed"}']
    scored, failed = R.apply_predictions(df, spark.createDataFrame(list(enumerate(answers)), "slurp_id long, response string"), ["slurp_id"], ["alarm_set"])
    got = {r["slurp_id"]: (r["predicted_intent_raw"], r["predicted_intent"], r["tsa"], r["predicted_parameters"]) for r in scored.collect()}
    assert got == {
        0: ("alarm_set", "alarm_set", 1, {"a": "b"}), 1: ("Set Alarm", "alarm_set", 1, {}), 2: ("MISSING_INTENT", "missing_intent", 0, {}),
        3: ("JSON_PARSE_ERROR", "JSON_PARSE_ERROR", 0, {}), 4: ("JSON_PARSE_ERROR", "JSON_PARSE_ERROR", 0, {}), 6: ("NO_TRANSCRIPTION", "NO_TRANSCRIPTION", 0, {}),
    }
    assert sorted(r["slurp_id"] for r in failed.collect()) == [5, 7]


def test_thin_cells(spark):
    from uttermark.operators import chunks as K

    chunk = lambda t, p: (t, "semantic_drift" if t == "substitute" else None, p, "a", "b", None)
    data = [(i, "noise", [chunk("insert", "function")] + [chunk("substitute", "critical")] * (i < 4)) for i in range(40)]
    df = spark.createDataFrame(data, f"slurp_id long, degradation string, error_categories array<{E.CHUNK}>")
    got = K.exploratory_cells(K.error_subtype_table(df, ["degradation"])).collect()
    assert [(r["kind"], r["position"], r["n"], r["utterances"]) for r in got] == [("semantic_drift", "critical", 4, 4)]


def test_sounds_of_words(spark):
    from uttermark.functions import phonetic as H

    known = {
        "sarah": ("SR", ""), "sara": ("SR", ""), "smith": ("SM0", "XMT"), "schmidt": ("XMT", "SMT"), "michael": ("MKL", "MXL"), "thomas": ("TMS", ""), "knight": ("NT", ""),
        "xavier": ("SF", "SFR"), "cabrillo": ("KPRL", "KPR"), "caesar": ("SSR", ""), "accident": ("AKSTNT", ""), "edge": ("AJ", ""), "laugh": ("LF", ""), "thumb": ("0M", "TM"),
        "wright": ("RT", ""), "bacchus": ("PKS", ""), "filipowicz": ("FLPTS", "FLPFX"), "school": ("SKL", ""), "jose": ("HS", ""), "jose maria": ("HSMR", ""), "san jose": ("SNHS", ""), "josef": ("JSF", "HSF"), "island": ("ALNT", ""), "": ("", ""), "42": ("", ""), "日本": ("", ""),
    }
    assert {w: H.double_metaphone(w) for w in known} == known
    df = spark.createDataFrame([("sarah", "sara"), ("sarah", "david"), ("seven", "heaven"), ("", ""), ("sarah", "")], "a string, b string")
    codes = H.word_codes(df.select(F.explode(F.array("a", "b")).alias("word"))).select("word", F.struct("primary", "secondary").alias("code"))
    j = df.join(codes.toDF("a", "x"), "a").join(codes.toDF("b", "y"), "b")
    got = {(r["a"], r["b"]): (r["s"], r["d"]) for r in j.select("a", "b", H.phonetic_similar(F.col("x"), F.col("y")).alias("s"), H.code_distance(H.main_code(F.col("x")), H.main_code(F.col("y"))).alias("d")).collect()}
    assert got["sarah", "sara"] == (True, 0.0) and got["sarah", "david"][1] > 0.6 and 0 < got["seven", "heaven"][1] < 1
    assert got["", ""] == (False, 0.0) and got["sarah", ""] == (False, 1.0)


@given(st.text(alphabet="ABCDEGHIJKLMNOPRSTUWXYZ ", max_size=12))
@settings(max_examples=300, deadline=None)
def test_every_string_has_codes(word):
    from uttermark.functions.phonetic import double_metaphone

    first, second = double_metaphone(word)
    assert set(first + second) <= set("AFHJKLMNPRSTX0") and (not second or second != first)


def annotate_slowly(sentence, entities, transcription):
    """Chunks of one pair in plain Python."""
    from uttermark.functions.phonetic import double_metaphone

    ref, hyp = sentence.split(), transcription.split()
    kind = {j: t for t, span in entities for j in span}
    out = []
    for c, a, b, x, y in E.align(ref, hyp) if ref and hyp else []:
        inside = [kind[j] for j in range(a, b) if j in kind]
        sub, distance = None, None
        if c == "substitute":
            r, h = ref[a], hyp[x]
            digits = any(w.isdigit() or w in E.NUMBER_WORDS for w in (r, h))
            alike = {z for z in double_metaphone(r) if z} & {z for z in double_metaphone(h) if z}
            sub = "named_entity_error" if inside and inside[0] in E.NAMED else "number_error" if digits and r != h else "phonetic_similar" if alike else "semantic_drift"
            p, q = ("".join(z[0] or z[1] for z in map(double_metaphone, ws)) for ws in (ref[a:b], hyp[x:y]))
            distance = _distance(p, q) / max(len(p), len(q)) if p and q else float(bool(p or q))
        out.append((c, sub, "critical" if inside else "function", " ".join(ref[a:b]), " ".join(hyp[x:y]), inside[0] if inside else None, distance))
    return out


def test_annotated_errors_equal_brute_force(spark):
    from uttermark.operators.annotate import annotate_errors

    gold = [(1, "set an alarm for sarah at seven am", [("person", [4]), ("time", [6, 7])]), (2, "play two songs", []), (3, "", []), (4, "call bob", [("person", [1])])]
    tokens = [(i, t, [(w,) for w in t.split()] if i != 2 else [], e, "s", "i", []) for i, t, e in gold]
    g = spark.createDataFrame(tokens, "slurp_id long, sentence string, tokens array<struct<surface:string>>, entities array<struct<type:string,span:array<int>>>, scenario string, intent string, recordings array<struct<file:string>>")
    said = [(1, "set an alarm for sara at heaven am"), (1, "set the alarm for david and joe at 7 am"), (1, ""), (2, "play too songs now"), (2, "play 3 songs"), (3, "x"), (4, None), (4, "call rob"), (9, "no gold"), (1, "Set an alarm, for SARAH at seven a.m.")]
    df = spark.createDataFrame([(s, t, 0.5, i) for i, (s, t) in enumerate(said)], "slurp_id long, transcription string, wer double, nr int")
    got = {r["nr"]: r for r in annotate_errors(df, g).collect()}
    assert len(got) == len(said)
    for i, (s, t) in enumerate(said[:9]):
        sentence, entities = next(((x, e) for k, x, e in gold if k == s), ("", []))
        want = annotate_slowly(sentence, entities if s != 2 else [], t) if t else []
        chunks = [tuple(c[k] for k in ("type", "error_subtype", "slot_position", "ref", "hyp", "entity_type")) for c in got[i]["error_categories"]]
        assert chunks == [w[:6] for w in want], (s, t)
        distances = [w[6] for w in want if w[0] == "substitute" and w[2] == "critical"]
        assert got[i]["phonetic_distance"] == (pytest.approx(sum(distances) / len(distances)) if distances else None)
    assert got[6]["full_hallucination"] is None and got[8]["full_hallucination"] is None and got[0]["full_hallucination"] is False
    assert got[0]["phonetic_distance"] > 0 and {c["error_subtype"] for c in got[4]["error_categories"]} == {"number_error"}


def test_word_error_rates_equal_brute_force(spark, tmp_path):
    """Whole turns, long ones and other speakers' too."""
    turns = [(1, 0, "user", " ".join(f"w{i % 150}" for i in range(400))), (1, 1, "assistant", "one two three four five"), (2, 0, "user", "a"), (3, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    t = {(r["tid"], r["cond"]): (r["ref"], r["hyp"]) for r in evaluation.text_rows(spark, str(tmp_path)).collect()}
    got = {(r["tid"], r["cond"]): r["wer"] for r in evaluation.QUERIES["f4_wer"](spark, str(tmp_path)).collect()}
    assert set(got) == set(t) and len(t) == 12
    for k, (ref, hyp) in t.items():
        assert got[k] == pytest.approx(_distance(ref, hyp) / len(ref) if hyp else 1.0, abs=1e-6)


def table(spark):
    return evaluation.cells(spark, SF).toPandas()


def test_calibrated_tables_equal_brute_force(spark):
    """a7, a8 and a10 from the fitted curves, in pandas."""
    er = table(spark)
    curves = {(r["asr"], r["llm"]): r for r in evaluation.QUERIES["m1_clean_calibration"](spark, SF).collect()}
    er["w"], clean = er["wer"].clip(upper=1), er[er["degradation"] == "clean"]
    anchor = clean.set_index(["slurp_id", "asr", "llm"])[["ees", "wer"]].to_dict("index")
    p = lambda c, w: 1 / (1 + math.exp(-(c["a"] + c["b"] * w)))
    a7 = {(r["asr"], r["degradation"], r["snr_db"], r["llm"]): r for r in evaluation.QUERIES["a7_calibrated_stats"](spark, SF).collect()}
    a8 = {(r["asr"], r["degradation"], r["snr_db"], r["llm"]): r for r in evaluation.QUERIES["a8_calibrated_paired"](spark, SF).collect()}
    a10 = {(r["asr"], r["degradation"], r["snr_db"], r["llm"]): r for r in evaluation.QUERIES["a10_absorption_table"](spark, SF).collect()}
    cells = er[er["degradation"] != "clean"].groupby(["asr", "degradation", "snr_db", "llm"])
    assert set(a10) == {(a, d, int(s), m) for a, d, s, m in cells.groups}
    a4 = {(r["asr"], r["degradation"], r["snr_db"], r["llm"]): r for r in evaluation.QUERIES["a4_cell_stats"](spark, SF).collect()}
    a5 = {(r["asr"], r["degradation"], r["snr_db"], r["llm"]): r for r in evaluation.QUERIES["a5_paired_stats"](spark, SF).collect()}
    for (a, d, s, m), part in list(cells)[::7]:
        key, own = (a, d, int(s), m), part[part["wer"].notna()]
        for other in (a4, a5, a7):
            for c in other[key].asDict() if key in other else []:
                assert a10[key][c] == (pytest.approx(other[key][c], abs=2e-6) if isinstance(other[key][c], float) else other[key][c]), (key, c)
        if not len(own):
            assert key not in a7 and a10[key]["n_calibrated"] is None and a10[key]["n_paired"] is None
            continue
        c = curves[a, m]
        seen, want = own["ees"].mean(), np.mean([p(c, w) for w in own["w"]])
        assert a7[key]["n_calibrated"] == len(own) and a7[key]["gain_calibrated"] == pytest.approx(seen - want, abs=5e-6)
        pairs = [(r.ees, r.w, anchor[r.slurp_id, a, m]) for r in own.itertuples() if r.wer > 0 and anchor[r.slurp_id, a, m]["ees"] == 1]
        ratio = np.mean([min(p(c, w) / p(c, min(o["wer"], 1)), 1) for _, w, o in pairs])
        assert a8[key]["n_paired"] == len(pairs) and a8[key]["gain_calibrated_paired"] == pytest.approx(np.mean([y for y, _, _ in pairs]) - ratio, abs=5e-6)


def test_cell_bootstrap_equals_brute_force(spark):
    """Every metric of one cell and replicate count, with the curve refitted, from the same draws."""
    draws, er = 20, table(spark)
    er = er[(er["asr"] == "asr-0") & (er["llm"] == "llm-1") & (er["degradation"].isin(["clean", "babble"]))].copy()
    er["has_critical_error"], er["has_function_error"] = (er["slurp_id"] % 3 == 0).astype(int), 1
    cols = ["slurp_id", "asr", "llm", "degradation", "snr_db", "wer", "ees", "has_critical_error", "has_function_error"]
    data = [tuple(None if x != x else x.item() if hasattr(x, "item") else x for x in row) for row in er[cols].itertuples(index=False)]
    df = spark.createDataFrame([(*r[:4], None if r[4] is None else int(r[4]), *r[5:]) for r in data], "slurp_id long, asr string, llm string, degradation string, snr_db int, wer double, ees int, has_critical_error int, has_function_error int").repartition(3)
    got = {r["metric"]: r for r in M.bootstrap_cells(df, replicates=draws).where("degradation = 'babble' and snr_db = 0").collect()}
    assert set(got) == set(M.METRICS)
    clean, cell = er[er["degradation"] == "clean"], er[(er["degradation"] == "babble") & (er["snr_db"] == 0)]
    weight = dict(zip(er["slurp_id"].unique(), M.poisson_weights(er["slurp_id"].unique(), draws, 42), strict=True))
    first = clean.set_index("slurp_id")["ees"].to_dict()
    out = {m: [] for m in M.METRICS}
    for b in range(draws):
        of = lambda d: np.repeat(np.arange(len(d)), [weight[i][b] for i in d["slurp_id"]])  # noqa: B023,E731
        c, d = clean.iloc[of(clean)], cell.iloc[of(cell)]
        x, n = np.unique(c["wer"].clip(upper=1), return_counts=True)
        curve = M.logistic(x, n.astype(float), np.array([c["ees"][c["wer"].clip(upper=1) == v].sum() for v in x], float))
        w, err, perfect = d["wer"].clip(upper=1), d["wer"] > 0, d["wer"] == 0
        pair = d[err & (d["slurp_id"].map(first) == 1)]
        gain = lambda q: q["ees"].mean() - (1 - q["wer"].clip(upper=1).mean())
        a, k = curve
        values = {
            "outcome": d["ees"].mean(), "absorption": d["ees"][err].mean(), "retention": pair["ees"].mean(), "gain_paired": gain(pair),
            "gain_ceiling": d["ees"][err].mean() - d["ees"][perfect].mean() * (1 - w[err].mean()), "gain_legacy": d["ees"][err].mean() - (1 - w.mean()),
            "gain_calibrated": d["ees"].mean() - (1 / (1 + np.exp(-(a + k * w)))).mean(), "gain_critical": gain(pair[pair["has_critical_error"] == 1]),
            "gain_function": gain(pair[pair["has_critical_error"] == 0]), "calibration_a": a, "calibration_b": k,
        }
        values["gain_critical_minus_function"] = values["gain_critical"] - values["gain_function"]
        for m, v in values.items():
            out[m].append(v)
    for m, values in out.items():
        lo, mid, hi = np.nanpercentile(values, [2.5, 50, 97.5]) if not np.isnan(values).all() else (None,) * 3
        for name, want in (("lo", lo), ("median", mid), ("hi", hi)):
            assert got[m][name] == (None if want is None else pytest.approx(want, abs=1e-7)), (m, name)


def test_designs_find_what_was_planted_and_refuse_the_rest(spark):
    from uttermark.operators import designs

    rng = np.random.default_rng(2)
    data = []
    for i in range(400):
        base = rng.normal(0, 0.5)
        for deg in ("clean", "noise", "babble"):
            for snr in (None,) if deg == "clean" else (20, 0):
                for path, asr, llm, fam in (("cascade", "org/w", "org/big", "f"), ("cascade", "org/w", "org/small", "f"), ("cascade", "org/v", "org/small", "f"), ("omni", None, "org/omni", "f")):
                    w = 0.0 if deg == "clean" else float(rng.integers(0, 6)) / 10
                    crit, fun = int(rng.random() < 0.4 and w > 0), int(rng.random() < 0.5 and w > 0)
                    z = 1.5 + base - 1.0 * w * (path == "cascade") - 1.2 * crit * (path == "cascade") + (0.9 if path == "omni" and deg == "babble" else 0) - 0.5 * (deg == "babble")
                    y = int(rng.random() < 1 / (1 + math.exp(-z)))
                    omni = path == "omni"
                    data.append((i, asr, llm, path, fam, deg, snr, None if omni else w, y, y, None if omni else crit, None if omni else fun))
    df = cell_columns(spark.createDataFrame(data, "slurp_id long, asr_model string, llm_model string, pathway string, model_family string, degradation string, snr_db int, wer double, tsa int, ees int, has_critical_error int, has_function_error int"))
    df = df.withColumns({"pf": F.col("ees").cast("double"), "phonetic_distance": F.lit(None).cast("double"), "error_categories": F.array().cast(f"array<{E.CHUNK}>")})
    got = {m.model: m for m in designs.run_models(df, "w", ["big"])}
    assert got["h1"].refused is None and got["h1"].contrast[0] < -0.6 and got["h1"].contrast[2] < 1e-3
    assert got["h2"].refused is None and {t for t, *_ in got["h2"].table} == {"intercept", "wer", "snr_20", "asr[w]", "degradation[clean]", "degradation[noise]", "llm[small]"}
    assert got["h3"].refused == "no rows are left"
    own = {t: b for t, b, *_ in got["h4b"].table}
    assert "pathway[omni]:degradation[babble]" in own and own["pathway[omni]:degradation[babble]"] > 0.4 and got["h4b"].joint[1] == 2 and got["h4b"].joint[2] < 0.01
    flat = designs.run_models(df.where("pathway = 'omni'"), "w", ["big"], ["h4b"])[0]
    assert "no variation in pathway" in flat.refused
    thin = designs.run_models(df.where("llm = 'big' or degradation = 'clean'"), "w", ["big"], ["h2"])[0]
    assert "covers 1 of 5" in thin.refused


def test_noise_has_the_wanted_power(spark):
    from uttermark.functions import signals as S

    x = [math.sin(i / 5) for i in range(400)]
    df = spark.createDataFrame([(1, x, [0.5, -0.2, 0.1], 7, 10), (2, [], [1.0], 7, 10), (3, x, [], 7, 0), (4, None, [1.0], 7, 10)], "id int, x array<double>, t array<double>, seed long, snr int")
    for f, args in ((S.add_noise, ("x", "seed", "snr")), (S.mix_track, ("x", "t", "seed", "snr"))):
        got = {r["id"]: r["noisy"] for r in f(df, *args).collect()}
        e = np.array(got[1]) - np.array(x)
        assert 10 * math.log10(np.mean(np.square(x)) / np.mean(e**2)) == pytest.approx(10) and got[2] == [] and got[4] == []
        assert got == {r["id"]: r["noisy"] for r in f(df.repartition(4), *args).collect()}
    assert np.array(got[3]).tolist() == x  # an empty track adds nothing


def test_bootstraps_draw_as_often_as_the_reference_from_exact_rates(spark, monkeypatch):
    drawn, whole = {}, M.replicate_parts

    def count(rows, cell, values, replicates, seed, cluster="slurp_id", more=None):
        drawn.setdefault(name, []).append((replicates, rows))
        return whole(rows, cell, values, 2, seed, cluster, more)

    monkeypatch.setattr(M, "replicate_parts", count)
    for name in ("m3_pathway_bootstrap", "m4_condition_bootstrap", "m11_mediation_bootstrap"):
        evaluation.QUERIES[name](spark, SF)
    assert [[n for n, _ in drawn[k]] for k in sorted(drawn)] == [[200], [2000], [2000]]
    rows = drawn["m11_mediation_bootstrap"][0][1]
    assert {r["llm"] for r in rows.select("llm").distinct().collect()} == {"llm-0", "llm-1", "llm-2"}
    assert any(abs(r["x"] - round(r["x"], 3)) > 1e-9 for r in rows.select("x").distinct().collect())
    monkeypatch.undo()
    seen = []
    monkeypatch.setattr(M, "replicate_curves", lambda rows, outcome, replicates, seed: seen.append(replicates) or {})
    evaluation.QUERIES["m2_bootstrap_cells"](spark, SF)
    assert seen == [2000]
