"""Queries over evaluation rows, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.functions import params as P
from uttermark.functions import signals as S
from uttermark.functions import text as X
from uttermark.functions.errors import error_flags
from uttermark.keys import cap_wer, cell_columns
from uttermark.operators import cells as C
from uttermark.operators import chunks as K
from uttermark.operators import models as M
from uttermark.operators import pairs as J
from uttermark.operators import rows as R
from uttermark.operators.annotate import word_error_rates
from uttermark.operators.chain import score_chain
from uttermark.plans.fixtures import CELLS, LABELS, SECOND, TEXT, eval_rows, read, second_pass, spoken_rows, text_gold, text_rows, with_distance

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Fractions to six places, as in the SQL."""
    return df.select(*(F.round(c, 6).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns))


def query(name: str, sql: str | None = None, prefix: str = CELLS) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = f"with {prefix} {sql}" if prefix else sql
        return f

    return add


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return cell_columns(eval_rows(spark, sf))


def r(x: str) -> str:
    return f"round({x}, 6)"


CELL = "asr, degradation, snr_db, llm"
LARGE = ["llm-1", "llm-2"]  #: the routers of the confirmatory comparisons
D = "degradation<>'clean'"


@query("p3_cell_columns", f"select slurp_id, {CELL} from er")
def _(s, d):
    return cells(s, d).select("slurp_id", "asr", "degradation", "snr_db", "llm")


@query("p9_reference_rows", "select slurp_id, asr, llm, degradation, snr_db, ees from er where pathway='omni' or (asr='asr-0' and llm in ('llm-0','llm-2'))")
def _(s, d):
    return R.reference_rows(cells(s, d), "asr-0", ["llm-0", "llm-2"]).select("slurp_id", "asr", "llm", "degradation", "snr_db", "ees")


@query("p12_failing_rows", "select slurp_id, asr_model, llm_model, degradation, snr_db, gold_intent, predicted_intent from er where tsa=0")
def _(s, d):
    return R.failing_rows(cells(s, d))


@query("p13_frame_drops", "select case when pf is null then 'null_outcome' when wer is null then 'null_wer' end drop_reason, count(*) n from er group by 1")
def _(s, d):
    return R.build_frame(cells(s, d), "pf")[1]


@query(
    "p13_build_frame",
    f"select slurp_id, asr, llm, degradation, {r('w')} wer, pf, case when snr_db=20 then 1 else 0 end snr_20, case when snr_db=10 then 1 else 0 end snr_10 from er where pf is not null and wer is not null",
)
def _(s, d):
    return R.build_frame(cells(s, d), "pf")[0].select("slurp_id", "asr", "llm", "degradation", "wer", "pf", "snr_20", "snr_10")


@query(
    "p14_contrast_frame",
    f"select slurp_id, asr, llm, cast({D} as int) treated, {r('w')} wer, ees from er where degradation='clean' or (degradation='babble' and snr_db=0)",
)
def _(s, d):
    return R.contrast_frame(cells(s, d), "babble", 0).select("slurp_id", "asr", "llm", "treated", cap_wer().alias("wer"), "ees")


@query("p15_router_arm", "select degradation, count(*) n, sum(tsa) correct from er where llm='llm-1' group by 1")
def _(s, d):
    return R.router_arm(cells(s, d).where("llm = 'llm-1'")).groupBy("degradation").agg(F.count(F.lit(1)).alias("n"), F.sum("tsa").alias("correct"))


@query("f31_degradation_group", "select case when degradation='clean' then 'clean' when degradation in ('noise','clipping','codec') then 'preserving' else 'destroying' end grp, count(*) n from er group by 1")
def _(s, d):
    g = R.degradation_group(F.col("degradation"), ["noise", "clipping", "codec"], ["reverb", "farfield", "babble"])
    return cells(s, d).groupBy(g.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("a1_tsa_by_cell", f"select {CELL}, count(*) n, sum(tsa) correct, {r('avg(tsa)')} accuracy from er where tsa is not null group by all")
def _(s, d):
    return C.accuracy(cells(s, d), ["asr", "degradation", "snr_db", "llm"])


@query("a2_tsa_by_intent", f"select {CELL}, gold_intent, count(*) n, sum(tsa) correct, {r('avg(tsa)')} accuracy from er where tsa is not null group by all")
def _(s, d):
    return C.accuracy(cells(s, d), ["asr", "degradation", "snr_db", "llm", "gold_intent"])


LEVELS = ["clean", "noise", "reverb", "farfield", "codec", "clipping", "babble"]
_pivot = ", ".join(f"case when count(tsa) filter (degradation='{x}')>=10 then {r(f'''avg(tsa) filter (degradation='{x}')''')} end \"{x}\"" for x in LEVELS)


@query("a3_intent_by_degradation", f"select asr, gold_intent, {_pivot} from er group by all")
def _(s, d):
    return C.pivoted(cells(s, d), ["asr", "gold_intent"], "degradation", LEVELS, 10)


_STATS = f"""count(*) n, count(*) filter (sc) n_scored, count(*) filter (sc and wer>0) n_err, count(*) filter (sc and wer=0) n_ceiling,
    count(*) filter (wer>1) n_collapse, avg(w) mean_wer_all, quantile_cont(w,0.5) median_wer, avg(w) filter (sc and wer>0) mean_wer_err,
    avg(ees) filter (sc) mean_outcome, avg(ees) filter (sc and wer=0) ceiling, avg(ees) filter (sc and wer>0) absorption"""
_STATS_COLS = ", ".join(
    ["n", "n_scored", "n_err", "n_ceiling", "n_collapse"]
    + [f"{r(x)} {x}" for x in ("mean_wer_all", "median_wer", "mean_wer_err", "mean_outcome", "ceiling", "absorption")]
    + [f"{r('1-mean_wer_all')} naive_legacy", f"{r('ceiling*(1-mean_wer_err)')} naive_ceiling", f"{r('absorption-(1-mean_wer_all)')} gain_legacy"]
    + [f"{r('absorption-ceiling*(1-mean_wer_err)')} gain_ceiling"]
)
@query("a4_cell_stats", f"select {CELL}, {_STATS_COLS} from (select {CELL}, {_STATS} from (select *, wer is not null and ees is not null sc from er) group by all)")
def _(s, d):
    return C.cell_stats(cells(s, d))


_PAIRED = f"""select {CELL}, count(*) filter (t and ees_clean=1) n_paired, count(*) filter (t and not has_anchor) n_dropped_no_anchor,
    avg(w) filter (t and ees_clean=1) mean_wer_paired, avg(ees) filter (t and ees_clean=1) retention
    from (select *, wer>0 and ees is not null t from ad where {D} and wer is not null) group by all"""


@query(
    "a5_paired_stats",
    f"select {CELL}, n_paired, n_dropped_no_anchor, {r('mean_wer_paired')} mean_wer_paired, {r('retention')} retention, {r('1-mean_wer_paired')} naive_paired, {r('retention-(1-mean_wer_paired)')} gain_paired, n_paired<30 underpowered from ({_PAIRED})",
)
def _(s, d):
    return C.paired_stats(cells(s, d))


@query(
    "a6_paired_incremental",
    f"select {CELL}, count(*) n_paired, {r('avg(inc)')} mean_incremental_wer, {r('avg(ees)')} retention, {r('1-avg(inc)')} naive_incremental, {r('avg(ees)-(1-avg(inc))')} gain_incremental from (select *, greatest(w-coalesce(least(wer_clean,1.0),0.0),0.0) inc from pd) group by all",
)
def _(s, d):
    return C.paired_incremental(cells(s, d))


@query("m1_clean_calibration")
def _(s, d):
    return M.clean_calibration(cells(s, d))


@query("a7_calibrated_stats")
def _(s, d):
    rows = cells(s, d)
    return C.calibrated_stats(rows, M.clean_calibration(rows))


@query("a8_calibrated_paired")
def _(s, d):
    rows = cells(s, d)
    return C.calibrated_paired(rows, M.clean_calibration(rows))


@query("a10_absorption_table")
def _(s, d):
    rows = cells(s, d)
    return C.absorption_table(rows, M.clean_calibration(rows))


# chunks of errors: the n-th of a row's e errors, by its number
CATEGORIES = """transform(filter(sequence(1, greatest(cast(e as int), 1)), i -> i <= e and asr_model is not null), i -> named_struct(
    'type', case when i%3=1 then 'substitute' when i%3=2 then 'delete' else 'insert' end,
    'error_subtype', case when i%3=1 then case i%4 when 0 then 'named_entity_error' when 1 then 'number_error' when 2 then 'phonetic_similar' else 'semantic_drift' end end,
    'slot_position', case when i%3=0 then 'function' when (slurp_id+i)%2=0 then 'critical' else 'function' end))"""
CHUNKS = (
    CELLS
    + """, ch as (select er.*, i, case when i%3=1 then 'substitute' when i%3=2 then 'delete' else 'insert' end type,
    case when i%3=1 then case i%4 when 0 then 'named_entity_error' when 1 then 'number_error' when 2 then 'phonetic_similar' else 'semantic_drift' end end subtype,
    case when i%3=0 then 'function' when (slurp_id+i)%2=0 then 'critical' else 'function' end pos
    from (select * from er where asr_model is not null and e>0) er, unnest(range(1, e+1)) as u(i))"""
)


def with_chunks(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).withColumn("error_categories", F.expr(CATEGORIES))


@query(
    "p11_error_flags",
    "select crit has_critical_error, fn has_function_error, count(*) n from (select slurp_id, asr, llm, cond, max(cast(pos='critical' as int)) crit, max(cast(pos='function' as int)) fn from ch group by all union all select slurp_id, asr, llm, cond, 0, 0 from er where asr_model is null or e<=0) group by 1, 2",
    CHUNKS,
)
def _(s, d):
    a, b = error_flags(F.col("error_categories"))
    return with_chunks(s, d).select(a.alias("has_critical_error"), b.alias("has_function_error")).groupBy("has_critical_error", "has_function_error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a9_stats_by_slot_position",
    f"select {CELL}, slot_position, {_STATS_COLS} from (select {CELL}, slot_position, {_STATS} from (select er.*, wer is not null and ees is not null sc, f.slot_position from er join (select slurp_id, asr, llm, cond, case when max(cast(pos='critical' as int))=1 then 'critical' else 'function' end slot_position from ch group by all) f using (slurp_id, asr, llm, cond)) group by all)",
    CHUNKS,
)
def _(s, d):
    return C.stats_by_slot_position(with_chunks(s, d))


@query(
    "a11_report_cells",
    f"select {CELL}, count(*) n, {r('avg(tsa)')} mean_tsa, {r('avg(pf)')} mean_pf, {r('avg(ees)')} mean_ees, {r('avg(ees_strict)')} mean_ees_strict, {r('avg(w)')} mean_wer, count(*) filter (wer>1) n_collapse, {r('list_sort(list(w) filter (w is not null))[cast(floor(count(w)/2) as int)+1]')} median_upper from er group by all",
)
def _(s, d):
    return C.report_cells(cells(s, d))


@query(
    "a12_dose_response",
    f"select degradation, {r('avg(tsa) filter (snr_db=20)')} snr_20, {r('avg(tsa) filter (snr_db=10)')} snr_10, {r('avg(tsa) filter (snr_db=0)')} snr_0, (select {r('avg(tsa)')} from er where asr='asr-0' and degradation='clean') clean from er where asr='asr-0' and {D} group by all",
)
def _(s, d):
    return C.dose_response(cells(s, d).where("asr = 'asr-0'"))


@query("a13_condition_grid", f"select gold_intent, degradation, count(*) n, {r('avg(tsa)')} accuracy from er where degradation='clean' or snr_db=10 group by all having count(*)>=5")
def _(s, d):
    return C.condition_grid(cells(s, d))


@query("a14_error_subtype_table", "select case when type='substitute' then subtype else type end kind, pos as \"position\", count(*) n, count(distinct slurp_id) utterances from ch group by all", CHUNKS)
def _(s, d):
    return K.error_subtype_table(with_chunks(s, d))


@query("a15_error_subtype_by", "select degradation, case when type='substitute' then subtype else type end kind, pos as \"position\", count(*) n, count(distinct slurp_id) utterances from ch group by all", CHUNKS)
def _(s, d):
    return K.error_subtype_table(with_chunks(s, d), ["degradation"])


@query("a16_exploratory_cells", "select degradation, case when type='substitute' then subtype else type end kind, pos as \"position\", count(*) n, count(distinct slurp_id) utterances from ch group by all having count(*)<30", CHUNKS)
def _(s, d):
    return K.exploratory_cells(K.error_subtype_table(with_chunks(s, d), ["degradation"]))


@query(
    "a17_annotation_summary",
    "select 'kind' \"by\", coalesce(subtype, type) value, count(*) n from ch group by all union all select 'position', pos, count(*) from ch group by all union all select 'rows', 'with_errors', count(*) from er where asr_model is not null and e>0",
    CHUNKS,
)
def _(s, d):
    return K.annotation_summary(with_chunks(s, d))


@query("a19_pool_pathway_cells", None)
def _(s, d):
    return J.pool_pathway_cells(J.pathway_stats(J.pathway_pairs(cells(s, d), "asr-0")))


_PP = """, comp as materialized (select o.llm omni_llm, c.llm cascade_llm from (select distinct llm, model_family from er where pathway='omni') o join (select distinct llm, model_family from er where pathway='cascade') c using (model_family)),
co as materialized (select comp.omni_llm, comp.cascade_llm, slurp_id, degradation, snr_db, coalesce(snr_db, -1) sk, ees yc from er join comp on llm=cascade_llm where pathway='cascade' and asr='asr-0' and wer>0 and ees is not null),
oo as materialized (select llm omni_llm, slurp_id, degradation, coalesce(snr_db, -1) sk, ees yo from er where pathway='omni' and ees is not null),
pp as materialized (select omni_llm, cascade_llm, degradation, snr_db, yc, yo from co join oo using (omni_llm, slurp_id, degradation, sk)),
ps as (select omni_llm, cascade_llm, degradation, snr_db, count(*) n_pairs, avg(yc) cascade_rate, avg(yo) omni_rate from pp group by all)"""
SQL["a19_pool_pathway_cells"] = (
    f"with {CELLS}{_PP} select omni_llm, cascade_llm, degradation, cast(sum(n_pairs) as bigint) pairs, count(*) n_cells, {r('sum(cascade_rate*n_pairs)/sum(n_pairs)')} cascade_rate, {r('sum(omni_rate*n_pairs)/sum(n_pairs)')} omni_rate, {r('sum(omni_rate*n_pairs)/sum(n_pairs)-sum(cascade_rate*n_pairs)/sum(n_pairs)')} gain_pathway, sum(n_pairs)<30 underpowered, case when degradation='clean' then 'anchor' else 'degradation' end scope from ps group by all"
)


@query(
    "j9_pathway_stats",
    f"select omni_llm, cascade_llm, degradation, snr_db, n_pairs, {r('cascade_rate')} cascade_rate, {r('omni_rate')} omni_rate, {r('omni_rate-cascade_rate')} gain_pathway, n_pairs<30 underpowered from ps",
    CELLS + _PP,
)
def _(s, d):
    return J.pathway_stats(J.pathway_pairs(cells(s, d), "asr-0"))


@query("j10_pathway_comparisons", "select distinct o.model_family, o.llm omni_llm, c.llm cascade_llm, c.llm in ('llm-1','llm-2') confirmatory from (select distinct llm, model_family from er where pathway='omni') o join (select distinct llm, model_family from er where pathway='cascade') c using (model_family)")
def _(s, d):
    return J.pathway_comparisons(cells(s, d), LARGE)


@query(
    "a20_sweep_facts",
    "select count(*) n_rows, (select count(*) from (select distinct asr_model, degradation, snr_db, llm_model from er)) cells, count(distinct asr_model) asrs, count(distinct llm_model) routers, count(distinct pathway) pathways from er",
)
def _(s, d):
    return C.sweep_facts(cells(s, d))


_CLAIMS = "select 'rows' claim, count(*)::double observed from er union all select 'clean_wer_zero', count(*)::double from er where degradation='clean' and wer=0 union all select 'omni_rows', count(*)::double from er where pathway='omni'"


def claims(rows: DataFrame) -> DataFrame:
    at = lambda name, cond: F.struct(F.lit(name).alias("claim"), F.count(F.when(cond, 1)).cast("double").alias("observed"))
    one = rows.agg(F.array(at("rows", F.lit(True)), at("clean_wer_zero", (F.col("degradation") == "clean") & (F.col("wer") == 0)), at("omni_rows", F.col("pathway") == "omni")).alias("c"))
    return one.select(F.explode("c").alias("c")).select("c.*")


@query("a21_claim_checks", f"select claim, {r('expected::double')} expected, 0.5::double tolerance, observed, abs(observed-expected)<=0.5 ok from ({_CLAIMS}) join (select 'rows' claim, 209.0*count(*) expected from part union all select 'clean_wer_zero', 1.0*count(*) from part union all select 'omni_rows', 38.0*count(*) from part) using (claim)")
def _(s, d):
    n = read(s, d, "part").agg(F.count(F.lit(1)).cast("double").alias("n"))
    want = lambda k, m: F.struct(F.lit(k).alias("claim"), (F.col("n") * m).alias("expected"), F.lit(0.5).alias("tolerance"))
    expected = n.select(F.explode(F.array(want("rows", 209.0), want("clean_wer_zero", 1.0), want("omni_rows", 38.0))).alias("x")).select("x.*")
    return C.claim_checks(claims(cells(s, d)), expected)


@query(
    "a22_extreme_cells",
    f"select min_by(k, (retention, k)) lowest, {r('min(retention)')} lowest_retention, min_by(k, (-retention, k)) highest, {r('max(retention)')} highest_retention from (select concat_ws('|', asr, degradation, snr_db::varchar, llm) k, retention from ({_PAIRED}))",
)
def _(s, d):
    return C.extreme_cells(C.paired_stats(cells(s, d)))


@query("a23_verdict_counts", f"select count(*) filter (lo>0) above, count(*) filter (hi<0) below, count(*) filter (not lo>0 and not hi<0) over_zero from (select {CELL}, avg(ees)-(1-avg(w))-0.05 lo, avg(ees)-(1-avg(w))+0.05 hi from pd group by all)")
def _(s, d):
    g = C.paired_stats(cells(s, d)).where("n_paired > 0")
    return C.verdict_counts(g.select((F.col("gain_paired") - 0.05).alias("lo"), (F.col("gain_paired") + 0.05).alias("hi")), "lo", "hi")


@query("a24_level_coverage", "select llm, count(*) n_cells from (select distinct llm, asr, degradation, snr_db from er) group by 1")
def _(s, d):
    return C.level_coverage(cells(s, d), "llm", ["asr", "degradation", "snr_db"])


@query("a25_thin_levels", "select llm, n_cells, max_cells most from (select llm, count(*) n_cells, max(count(*)) over () max_cells from (select distinct llm, asr, degradation, snr_db from er) group by 1) where n_cells<0.5*max_cells")
def _(s, d):
    return C.thin_levels(cells(s, d), "llm", ["asr", "degradation", "snr_db"])


@query("a26_varying_terms", "select 'snr_db' term, count(distinct snr_db)+max(cast(snr_db is null as int))>1 varies from er union all select 'wer', count(distinct wer)+max(cast(wer is null as int))>1 from er union all select 'e_zero', count(distinct e*0)+max(cast(e is null as int))>1 from er")
def _(s, d):
    return C.varying_terms(cells(s, d).withColumn("e_zero", F.col("e") * 0), ["snr_db", "wer", "e_zero"])


@query("a27_pathway_condition_means", f"select model_family, pathway, degradation, snr_db, {r('avg(ees)')} mean_ees, {r('avg(ees) filter (not coalesce(wer>=1, false))')} mean_ees_without from er group by all")
def _(s, d):
    return C.pathway_condition_means(cells(s, d).withColumn("full_hallucination", F.col("wer") >= 1))


@query("a28_ablation_table", f"select degradation as \"condition\", {r('avg(tsa) filter (slurp_id%3=0 and item<>6)')} v0, {r('avg(tsa) filter (slurp_id%3=1 and item<>6)')} v1, {r('avg(tsa) filter (slurp_id%3=2 and item<>6)')} v2, count(*) filter (item=6) n_failed from er group by 1")
def _(s, d):
    a = cells(s, d).select(F.col("degradation").alias("condition"), F.concat(F.lit("v"), (F.col("slurp_id") % 3).cast("string")).alias("variant"), (F.col("item") == 6).alias("failed"), "tsa")
    return C.ablation_table(a, ["v0", "v1", "v2"])


#: the clean row of an item by a window: few columns, made once
ANCHORED = (
    CELLS
    + """, an as materialized (select slurp_id, asr, degradation, snr_db, llm, wer, ees, max(case when degradation='clean' then ees end) over item ees_clean,
    max(case when degradation='clean' then wer end) over item wer_clean, bool_or(degradation='clean') over item has_anchor from er window item as (partition by slurp_id, asr, llm))"""
)


@query("j3_anchor_join", f"select slurp_id, asr, llm, degradation, snr_db, ees, ees_clean clean_outcome, {r('wer_clean')} clean_wer, has_anchor from an where wer is not null", ANCHORED)
def _(s, d):
    return J.with_anchor(cells(s, d)).select("slurp_id", "asr", "llm", "degradation", "snr_db", "ees", "clean_outcome", "clean_wer", "has_anchor")


@query("j4_paired_rows", f"select slurp_id, {CELL}, ees, {r('wer')} wer from an where {D} and wer>0 and ees is not null and ees_clean=1", ANCHORED)
def _(s, d):
    return J.paired_rows(cells(s, d)).select("slurp_id", "asr", "degradation", "snr_db", "llm", "ees", "wer")


@query(
    "j5_classify_pairs",
    f"""select {CELL}, category, n, {r('100.0*n/sum(n) over cell')} "percent",
    {r("sum(n) filter (category='ABSORBED') over cell/nullif(sum(n) filter (category in ('ABSORBED','PROPAGATED')) over cell, 0)")} retention from (select {CELL},
    case when ees_clean=1 and ees=0 then case when coalesce(wer,0)>0 then 'PROPAGATED' else 'NEW_ERROR' end when ees_clean=1 and ees=1 then case when coalesce(wer,0)>0 then 'ABSORBED' else 'SAME_OK' end
    when ees_clean=0 and ees=1 then 'RECOVERED' when ees_clean=0 and ees=0 then 'SAME_FAIL' else 'OTHER' end category, count(*) n from ad where {D} and has_anchor group by all) window cell as (partition by asr, degradation, snr_db, llm)""",
)
def _(s, d):
    return J.classify_pairs(cells(s, d))


@query(
    "j6_paired_router_test",
    f"select *, {r('least(1.0, 2*list_sum(list_transform(range(0, least(a_only, b_only)+1), lambda i: exp(lgamma(a_only+b_only+1)-lgamma(i+1)-lgamma(a_only+b_only-i+1)-(a_only+b_only)*ln(2)))))')} p from (select count(*) n, {r('avg(ya)')} rate_a, {r('avg(yb)')} rate_b, {r('avg(yb)-avg(ya)')} gap, count(*) filter (ya=1 and yb=0) a_only, count(*) filter (ya=0 and yb=1) b_only from (select a.tsa ya, b.tsa yb from er a join er b on a.slurp_id=b.slurp_id and a.asr=b.asr and a.cond=b.cond where a.llm='llm-0' and b.llm='llm-1'))",
)
def _(s, d):
    return J.paired_router_test(cells(s, d), "llm-0", "llm-1")


_J7 = "er a full join second b on a.slurp_id=b.slurp_id and a.asr_model is not distinct from b.asr_model and a.cond=b.cond and a.llm_model=b.llm_model"


def _first_pass(s, d) -> DataFrame:
    return cells(s, d).selectExpr("slurp_id", "asr_model", "degradation", "snr_db", "llm_model", "predicted_intent", "map('item', cast(item as string)) predicted_parameters", "tsa", "pf", "ees", "ees_strict")


@query(
    "j7_determinism_compare",
    f"""select count(*) filter (bo) n_common, count(*) filter (bo and i) intent_differs, count(*) filter (bo and (i or p)) decision_differs, count(*) filter (bo and t) score_differs,
    count(*) filter (nb) only_in_a, count(*) filter (na) only_in_b from (select a.slurp_id is not null and b.slurp_id is not null bo, b.slurp_id is null nb, a.slurp_id is null na,
    a.predicted_intent is distinct from b.predicted_intent i, a.item is distinct from b.item p, a.tsa is distinct from b.tsa or a.pf is distinct from b.pf or a.ees is distinct from b.ees t from {_J7})""",
    CELLS + SECOND,
)
def _(s, d):
    return J.determinism_compare(_first_pass(s, d), second_pass(cells(s, d)))


_J8 = f"select a.degradation, a.snr_db, count(*) n, avg(a.tsa) mean_a, avg(b.tsa) mean_b from {_J7.replace('full join', 'join')} group by 1, 2"


@query("j8_outcome_drift", f"select degradation, snr_db, n, {r('mean_a')} mean_a, {r('mean_b')} mean_b, {r('abs(mean_b-mean_a)')} drift from ({_J8})", CELLS + SECOND)
def _(s, d):
    return J.outcome_drift(_first_pass(s, d), second_pass(cells(s, d)))


@query("j8_drift_summary", f"select cast(sum(n) as bigint) n, {r('sum(mean_a*n)/sum(n)')} mean_a, {r('sum(mean_b*n)/sum(n)')} mean_b, {r('avg(abs(mean_b-mean_a))')} mean_abs_drift, {r('max(abs(mean_b-mean_a))')} max_drift, {r('abs(sum(mean_b*n)/sum(n)-sum(mean_a*n)/sum(n))')} drift from ({_J8})", CELLS + SECOND)
def _(s, d):
    return J.drift_summary(_first_pass(s, d), second_pass(cells(s, d)))


@query("l2_worst_cells", f"select degradation, snr_db, n, {r('mean_a')} mean_a, {r('mean_b')} mean_b, {r('abs(mean_b-mean_a)')} drift from ({_J8}) order by abs(mean_b-mean_a) desc, degradation, snr_db nulls first limit 5", CELLS + SECOND)
def _(s, d):
    return J.worst_cells(J.outcome_drift(_first_pass(s, d), second_pass(cells(s, d))), 5)


@query("j11_design_grid", "select p_partkey slurp_id, degradation, snr_db from part, (select distinct degradation, snr_db from g)")
def _(s, d):
    grid = s.createDataFrame([("clean", None)] + [(x, n) for x in LEVELS[1:] for n in (20, 10, 0)], "degradation string, snr_db int")
    return J.design_grid(read(s, d, "part").select(F.col("p_partkey").alias("slurp_id")), grid)


@query("j12_skip_done", "select slurp_id, degradation, snr_db, asr_model, llm_model from er where not (tsa=1 and slurp_id%2=0)")
def _(s, d):
    rows = cells(s, d)
    keys = ["slurp_id", "degradation", "snr_db", "asr_model", "llm_model"]
    return J.skip_done(rows, rows.where("tsa = 1 and slurp_id % 2 = 0"), keys).select(*keys)


@query("j14_capacity_gap", f"select asr, degradation, snr_db, count(*) filter (llm='llm-0') n, {r('a')} ees_a, {r('b')} ees_b, {r('b-a')} gap, {r('1-(a+b)/2')} difficulty from (select asr, degradation, snr_db, llm, avg(ees) filter (llm='llm-0') over w a, avg(ees) filter (llm='llm-1') over w b from er where llm in ('llm-0','llm-1') window w as (partition by asr, degradation, snr_db)) group by asr, degradation, snr_db, a, b")
def _(s, d):
    return J.capacity_gap(cells(s, d), "llm-0", "llm-1")


@query("j14_capacity_summary", f"select count(b-a) n_cells, {r('avg(b-a)')} mean_gap, {r('corr(b-a, 1-(a+b)/2)')} r from (select asr, degradation, snr_db, avg(ees) filter (llm='llm-0') a, avg(ees) filter (llm='llm-1') b from er where llm in ('llm-0','llm-1') group by all)")
def _(s, d):
    return J.capacity_summary(J.capacity_gap(cells(s, d), "llm-0", "llm-1"))


@query("u2_key_overlap", "select slurp_id, asr_model, cond from er where llm='llm-0' and tsa=1 intersect select slurp_id, asr_model, cond from er where llm='llm-1' and tsa=1")
def _(s, d):
    rows = cells(s, d).where("tsa = 1")
    return J.key_overlap(rows.where("llm = 'llm-0'"), rows.where("llm = 'llm-1'"), ["slurp_id", "asr_model", "cond"])


@query("u3_only_in_one", "select slurp_id, asr_model, llm_model, cond, 'a' side from er where (slurp_id+cond)%101=0")
def _(s, d):
    rows = cells(s, d)
    return J.only_in_one(rows, second_pass(rows), ["slurp_id", "asr_model", "llm_model", "cond"])


@query("u4_label_set_check", "select predicted_intent label, 'gold' side from er group by 1 having predicted_intent not in (select gold_intent from er)")
def _(s, d):
    rows = cells(s, d)
    return J.label_set_check(rows.select(F.col("predicted_intent").alias("label")), rows.select(F.col("gold_intent").alias("label")), "label")


@query("w1_first_per_key", f"select slurp_id, asr, llm, cond, tsa, case when slurp_id%20=0 then 1 else 0 end repeats from er where {D}")
def _(s, d):
    rows = cells(s, d).where("degradation <> 'clean'").withColumn("line", F.lit(1))
    again = rows.where("slurp_id % 20 = 0").withColumns({"line": F.lit(2), "tsa": 1 - F.col("tsa")})
    one = J.first_per_key(rows.unionByName(again), ["slurp_id", "asr", "llm", "cond"], ["line"])
    return one.select("slurp_id", "asr", "llm", "cond", "tsa", "repeats")


@query("w2_duplicate_keys", "select slurp_id, degradation, snr_db, asr_model, llm_model, pathway, degradation as file, 2 line, 1 first_line from er where slurp_id%20=0")
def _(s, d):
    rows = cells(s, d).select("slurp_id", "degradation", "snr_db", "asr_model", "llm_model", "pathway", F.col("degradation").alias("file"), F.lit(1).alias("line"))
    keys = ["slurp_id", "degradation", "snr_db", "asr_model", "llm_model", "pathway"]
    return R.duplicate_keys(rows.unionByName(rows.where("slurp_id % 20 = 0").withColumn("line", F.lit(2))), keys)


@query("w3_top_examples", "select * from (select gold_intent, slurp_id, asr, llm, cond, row_number() over (partition by gold_intent order by slurp_id, cond, asr, llm) as \"rank\" from er where tsa=0) where \"rank\"<=3")
def _(s, d):
    rows = cells(s, d).where("tsa = 0").select("gold_intent", "slurp_id", "asr", "llm", "cond")
    return R.top_examples(rows, "gold_intent", ["slurp_id", "cond", "asr", "llm"], 3)


@query("w4_waterfall", f"select asr as \"group\", degradation part, {r('v')} v, {r('sum(v) over (partition by asr order by degradation)-v')} \"start\", {r('sum(v) over (partition by asr order by degradation)')} \"end\" from (select asr, degradation, avg(ees)-0.5 v from er group by all)")
def _(s, d):
    parts = cells(s, d).groupBy(F.col("asr").alias("group"), F.col("degradation").alias("part")).agg((F.avg("ees") - 0.5).alias("v"))
    return R.waterfall(parts, "part", "v")


@query("l1_sample_n", "select slurp_id from (select distinct slurp_id from er) order by sha256(concat_ws('|','7',slurp_id::varchar)), slurp_id limit 50")
def _(s, d):
    return R.sample_n(cells(s, d).select("slurp_id").distinct(), 50, 7)


@query("m3_pathway_bootstrap")
def _(s, d):
    p = J.pathway_pairs(cells(s, d), "asr-0").withColumns({"one": F.lit(1.0), "gain": F.col("yo") - F.col("yc")})
    cell = ["omni_llm", "cascade_llm", "degradation", "snr_db"]
    # pairs were joined by clip; all pairs of an utterance come together, so that its weights are drawn in one batch
    p = p.select("slurp_id", *cell, "one", "gain").repartition("slurp_id").sortWithinPartitions("slurp_id")
    return M.interval(M.replicate_sums(p, cell, ["one", "gain"], 2000), cell, F.col("gain") / F.col("one"), "gain_")


@query("m4_condition_bootstrap")
def _(s, d):
    rows = cells(s, d).withColumn("one", F.lit(1.0))
    cell = ["model_family", "pathway", "degradation", "snr_db"]
    return M.interval(M.replicate_sums(rows, cell, ["one", "ees"], 2000), cell, F.col("ees") / F.col("one"), "ees_")


@query("m2_bootstrap_cells")
def _(s, d):
    a, b = error_flags(F.col("error_categories"))
    return M.bootstrap_cells(with_chunks(s, d).withColumns({"has_critical_error": a, "has_function_error": b}))


# --- text, parameters, signals ---------------------------------------------------------------------------------


@query("f1_normalize_text", "select conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', ' ', 'g'), '\\s+', ' ', 'g')) norm from conversations", "")
def _(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", X.normalize_text(F.col("text")).alias("norm"))


@query("f4_wer")
def _(s, d):
    t = text_rows(s, d).select("tid", "cond", X.normalize_text(F.col("sentence")).alias("r"), X.normalize_text(F.col("transcription")).alias("h"))
    return word_error_rates(t, "r", "h").select("tid", "cond", "wer")


@query("f5_cer", f"select tid, cond, {r('case when length(transcription)=0 then 1.0 else levenshtein(sentence, transcription)/length(sentence) end')} cer from tx", TEXT)
def _(s, d):
    return text_rows(s, d).select("tid", "cond", X.cer(F.col("sentence"), F.col("transcription")).alias("cer"))


def _gold(t: DataFrame) -> DataFrame:
    return t.selectExpr(
        "*", "transform(ref, w -> named_struct('surface', w)) tokens",
        "transform(filter(sequence(1, size(ref)), j -> (tid+j)%4=0), j -> named_struct('type', case j%4 when 0 then 'person' when 1 then 'date' when 2 then 'time' else 'event_name' end, 'span', array(j-1))) entities",
    )


_SLOTS = "list_filter(ref, lambda w, j: (tid+j)%4=0)"


@query("f6_slot_error_rate", f"select tid, cond, {r(f'case when len({_SLOTS})>0 then len(list_filter({_SLOTS}, lambda w: not list_contains(hyp, w)))/len({_SLOTS}) end')} ser from tx", TEXT)
def _(s, d):
    t = _gold(text_rows(s, d))
    return t.select("tid", "cond", X.slot_error_rate(X.slot_words(F.col("tokens"), F.col("entities")), F.col("transcription")).alias("ser"))


@query("f7_gold_parameters", "select tid, cond, array_to_string(list_sort(list_transform(list_filter(range(1, len(ref)+1), lambda j: (tid+j)%4=0), lambda j, i: (case when j%4=0 then 'person' when j%4=1 then 'date' when j%4=2 then 'time' else 'event_name' end) || (case when i>1 then '_' || i else '' end) || '=' || ref[j])), ';') params from tx where cond=0", TEXT)
def _(s, d):
    m = X.gold_parameters(F.col("tokens"), F.col("entities"))
    t = _gold(text_rows(s, d).where("cond = 0"))
    return t.select("tid", "cond", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("params"))


@query("f28_full_hallucination", None)
def _(s, d):
    from uttermark.functions.errors import full_hallucination

    t = word_error_rates(text_rows(s, d), "sentence", "transcription")
    return t.select("tid", "cond", full_hallucination(F.col("wer"), F.col("ref"), F.col("hyp")).alias("full_hallucination"))


@query("f21_align_words")
def _(s, d):
    from uttermark.functions.errors import aligned

    # whole texts, so that none is joined from its words again for each of its chunks
    t = text_rows(s, d).select(F.col("sentence").alias("ref"), F.col("transcription").alias("hyp")).distinct()
    return aligned(t).select("ref", "hyp", F.explode("chunks").alias("c")).select("ref", "hyp", "c.*")


_PARAMS = """pp as (select p_partkey id, p_name n, p_type t, p_brand b, case p_partkey%5 when 0 then [p_name,p_type,p_brand] when 1 then [string_split(p_name,' ')[1]] when 2 then [] when 3 then ['zzz'] else [p_brand] end pv from part),
nm as (select id, list_transform([n,t,b], lambda x: lower(x)) g, list_transform(pv, lambda x: lower(x)) p from pp),
mt as (select id, len(g) n_gold, len(p) n_pred, len(list_filter(g, lambda x: len(list_filter(p, lambda y: x=y or (length(x)>=3 and contains(y,x)) or (length(y)>=3 and contains(x,y))
    or len(list_filter(list_intersect(string_split(x,' '), string_split(y,' ')), lambda w: length(w)>=3))>0))>0)) n_matched from nm)"""


def _params(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").selectExpr(
        "p_partkey id", "map('item_name', p_name, 'list_name', p_type, 'event_name', p_brand) gold",
        "case p_partkey%5 when 0 then map('item_name', p_name, 'list_name', p_type, 'event_name', p_brand) when 1 then map('item_name', split(p_name,' ')[0]) when 2 then cast(map() as map<string,string>) when 3 then map('item_name','zzz') else map('wrong', p_brand) end pred",
    )


@query("f16_param_recall", f"select id, {r('n_matched/n_gold')} pf, n_gold pf_n_gold, n_matched pf_n_matched from mt", _PARAMS)
def _(s, d):
    pf, n, m = P.param_recall(F.col("gold"), F.col("pred"))
    return _params(s, d).select("id", pf.alias("pf"), n.cast("long").alias("pf_n_gold"), m.cast("long").alias("pf_n_matched"))


_EES = "case when tsa is null then null when n_gold=0 then tsa else cast(tsa=1 and n_matched/n_gold>={} as int) end"


@query("f17_ees", f"select id, {_EES.format(0.5)} ees, {_EES.format(1.0)} ees_strict from (select id, case id%4 when 0 then 0 when 1 then null else 1 end tsa, case when id%7=0 then 0 else n_gold end n_gold, n_matched from mt)", _PARAMS)
def _(s, d):
    """Right, wrong and unscored intents, with and without gold parameters."""
    none = F.create_map().cast("map<string,string>")
    t = _params(s, d).withColumn("gold", F.when(F.col("id") % 7 == 0, none).otherwise(F.col("gold")))
    pf, _, _ = P.param_recall(F.col("gold"), F.col("pred"))
    tsa = F.when(F.col("id") % 4 == 0, 0).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(1)
    t = t.select("id", pf.alias("pf"), tsa.alias("tsa"))
    return t.select("id", P.ees(F.col("tsa"), F.col("pf")).alias("ees"), P.ees(F.col("tsa"), F.col("pf"), 1.0).alias("ees_strict"))


@query("f19_tch_category", "select id, case when n_pred=0 then 'schema_mismatch' when n_matched>0 then 'semantic_drift' else 'fabricated' end tch from mt", _PARAMS)
def _(s, d):
    return _params(s, d).select("id", P.tch_category(F.col("gold"), F.col("pred")).alias("tch"))


_TSH = "case when predicted_intent='NO_TRANSCRIPTION' then 'missing' when predicted_intent='unknown' then 'unknown' when predicted_intent='set_alarm' then 'hallucinated' else 'wrong' end"


@query("f18_tsh_category", f"select {_TSH} tsh, count(*) n from er where tsa=0 group by 1")
def _(s, d):
    return cells(s, d).where("tsa = 0").groupBy(P.tsh_category(F.col("predicted_intent"), LABELS).alias("tsh")).agg(F.count(F.lit(1)).alias("n"))


@query("a18_failure_tallies", f"select 'tsh' \"of\", {_TSH} label, count(*) n from er where tsa=0 group by 2 union all select 'tch', case when item=0 then 'schema_mismatch' else 'fabricated' end, count(*) from er where tsa=1 and pf<0.5 group by 2")
def _(s, d):
    gold, pred = F.create_map(F.lit("k"), F.lit("value")), F.when(F.col("item") == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("k"), F.lit("other")))
    t = cells(s, d).select(
        F.when(F.col("tsa") == 0, P.tsh_category(F.col("predicted_intent"), LABELS)).alias("tsh"),
        F.when((F.col("tsa") == 1) & (F.col("pf") < 0.5), P.tch_category(gold, pred)).alias("tch"),
    )
    return K.failure_tallies(t)


@query("f9_normalize_predicted_intent", "select case when predicted_intent='set_alarm' then 'alarm_set' when predicted_intent='NO_TRANSCRIPTION' then 'no_transcription' else predicted_intent end intent, count(*) n from er group by 1")
def _(s, d):
    return cells(s, d).groupBy(X.normalize_predicted_intent(F.col("predicted_intent"), LABELS + ["unknown"]).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query("f12_parse_response", "select slurp_id, llm, case when slurp_id%6 in (4,5) then null else predicted_intent end intent from er")
def _(s, d):
    shape = """case slurp_id%6 when 0 then concat('{"intent":"',predicted_intent,'"}') when 1 then concat('```json\\n{"intent":"',predicted_intent,'"}\\n```')
        when 2 then concat('Sure: {"intent":"',predicted_intent,'"} done') when 3 then concat('```{"intent":"',predicted_intent,'"}```') when 4 then '{"error":"timeout"}' else 'no json {' end"""
    rows = cells(s, d).withColumn("response", F.expr(shape))
    return rows.select("slurp_id", "llm", X.parse_response(F.col("response"))["intent"].alias("intent"))


@query("f10_model_family", "select model_family, count(*) n from er group by 1")
def _(s, d):
    name = F.concat(F.lit("org/"), F.when(F.col("model_family") == "google", "Gemma-").otherwise("Qwen-"), F.col("llm"))
    return cells(s, d).groupBy(X.model_family(name).alias("model_family")).agg(F.count(F.lit(1)).alias("n"))


@query("f32_stable_seed", "select p_partkey, cast(('0x' || substr(sha256('42|' || p_partkey || '|noise'),1,8)) as bigint) seed from part", "")
def _(s, d):
    return read(s, d, "part").select("p_partkey", S.stable_seed(42, F.col("p_partkey"), F.lit("noise")).alias("seed"))


@query("f33_peak_normalize", f"select vec_id, {r('list_sum(list_transform(embedding, lambda x: abs(x::double)/pk*0.95))')} total, {r('list_max(list_transform(embedding, lambda x: abs(x::double)/pk*0.95))')} peak from (select *, list_max(list_transform(embedding, lambda x: abs(x)))::double pk from embeddings)", "")
def _(s, d):
    t = read(s, d, "embeddings").select("vec_id", S.peak_normalize(F.col("embedding")).alias("x"))
    return t.select("vec_id", F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("total"), S.peak(F.col("x")).alias("peak"))


@query("f34_hard_clip", f"select vec_id, {r('list_sum(list_transform(embedding, lambda x: greatest(least(x::double, pk*0.3), -pk*0.3)))')} total from (select *, list_max(list_transform(embedding, lambda x: abs(x)))::double pk from embeddings)", "")
def _(s, d):
    t = read(s, d, "embeddings").select("vec_id", S.hard_clip(F.col("embedding"), 0.3).alias("x"))
    return t.select("vec_id", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("f35_add_noise")
def _(s, d):
    t = read(s, d, "embeddings").select("vec_id", "embedding", S.stable_seed(42, F.col("vec_id")).alias("seed"), F.lit(10).alias("snr_db"))
    return S.add_noise(t, "embedding", "seed", "snr_db").select("vec_id", F.aggregate("noisy", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("f36_mix_track")
def _(s, d):
    t = read(s, d, "embeddings").select("vec_id", "embedding", S.stable_seed(42, F.col("vec_id")).alias("seed"), F.lit(10).alias("snr_db"), F.slice("embedding", 1, 16).alias("track"))
    return S.mix_track(t, "embedding", "track", "seed", "snr_db").select("vec_id", F.aggregate("noisy", F.lit(0.0), lambda a, v: a + v).alias("total"))


# --- clustered models and mediation -----------------------------------------------------------------------------


def _designed(s: SparkSession, d: str) -> DataFrame:
    """Rows with error flags and phonetic distances, as the regression designs need them."""
    a, b = error_flags(F.col("error_categories"))
    return with_distance(with_chunks(s, d)).withColumns({"has_critical_error": a, "has_function_error": b})


FIT = "term string, coef double, se double, z double, p double"
REFERENCE = "asr-0"


@query("m5_rank_report")
def _(s, d):
    """Of the second design's columns."""
    from uttermark.operators import designs, gee

    design = designs.designs(REFERENCE, LARGE)["h2"]
    frame, _ = designs.frame_of(_designed(s, d), design)
    flags, terms, _ = designs.flags_of(frame, design)
    cols = [F.lit(1.0), *((flags[t] if t in flags else F.col(t)).cast("double") for t in terms)]
    sums = frame.agg(*(F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols))).first()
    n = len(cols)
    rank, columns, least = gee.rank_report(gee.np.array(list(sums), float).reshape(n, n))
    return s.createDataFrame([(rank, columns, least)], "rank int, columns int, smallest double")


@query("m6_gee_fit")
def _(s, d):
    from uttermark.operators import designs

    got = designs.run_models(_designed(s, d), REFERENCE, LARGE, ["h2"])[0]
    return s.createDataFrame(got.table, FIT)


def _models(s: SparkSession, rows: DataFrame) -> DataFrame:
    """Coefficients, contrasts and joint tests of the four designs; a refusal is a row too."""
    from uttermark.operators import designs

    # only what the designs read is made and held: no character error rates, rules or texts of chunks
    out, held = [], designs.narrowed(rows).persist(StorageLevel.DISK_ONLY)
    try:
        for m in designs.run_models(held, REFERENCE, LARGE):
            out += [(m.model, "term", *row, None) for row in m.table]
            if m.contrast:
                out.append((m.model, "contrast", "critical - function", m.contrast[0], m.contrast[1], None, m.contrast[2], None))
            if m.joint:
                out.append((m.model, "joint", f"interactions, df {m.joint[1]}", m.joint[0], None, None, m.joint[2], None))
            if m.refused:
                out.append((m.model, "refused", None, None, None, None, None, m.refused))
    finally:
        held.unpersist()
    return s.createDataFrame(out, "model string, kind string, term string, value double, se double, z double, p double, refused string")


@query("m9_run_models")
def _(s, d):
    return _models(s, _designed(s, d))


@query("m12_mediation_table")
def _(s, d):
    """Every degradation and noise level, with the share mediated where the bootstrap's interval allows it."""
    rows, by = cells(s, d), ["degradation", "snr_db"]
    return M.mediation_table(rows, by=by, bands=M.mediation_bootstrap(rows, by=by))


@query("m11_mediation_bootstrap")
def _(s, d):
    return M.mediation_bootstrap(cells(s, d))


# --- error chunks of texts ----------------------------------------------------------------------------------------


def annotated(s: SparkSession, d: str) -> DataFrame:
    """Every turn under four conditions with the error chunks of its transcript."""
    from uttermark.operators.annotate import annotate_errors

    t = text_rows(s, d)
    rows = t.select(F.col("tid").alias("slurp_id"), "cond", F.concat(F.lit("c"), "cond").alias("degradation"), "transcription", X.normalize_text(F.col("sentence")).alias("r"), X.normalize_text(F.col("transcription")).alias("h"))
    return annotate_errors(word_error_rates(rows, "r", "h").drop("r", "h"), text_gold(t))


@query("f22_annotate_errors")
def _(s, d):
    c = F.posexplode("error_categories").alias("at", "c")
    return annotated(s, d).select("slurp_id", "cond", c).select("slurp_id", "cond", "at", "c.*")


def chained(s: SparkSession, d: str) -> DataFrame:
    """The whole scoring chain over the turns' transcripts and answers."""
    return score_chain(*spoken_rows(s, d), LABELS, ["s0", "s1", "s2"])


@query("chain")
def _(s, d):
    return chained(s, d).withColumn("violations", F.transform("violations", lambda v: F.concat_ws(":", v["rule"], v["field"])))


@query("chain_slot_position")
def _(s, d):
    """Cell statistics by the position of the errors that the chain has found."""
    return C.stats_by_slot_position(cell_columns(chained(s, d).where("not failed")))


@query("chain_models")
def _(s, d):
    """The four designs over the chain's own chunks and distances."""
    a, b = error_flags(F.col("error_categories"))
    rows = cell_columns(chained(s, d).where("not failed")).withColumns({"has_critical_error": a, "has_function_error": b})
    return _models(s, rows)


@query("f24_double_metaphone")
def _(s, d):
    from uttermark.functions.phonetic import word_codes

    t = text_rows(s, d)
    return word_codes(t.select(F.explode("hyp").alias("word")))


@query("f25_phonetic_similar")
def _(s, d):
    """Substituted first words of all chunks, and whether they sound alike."""
    from uttermark.functions.phonetic import phonetic_similar, word_codes

    c = annotated(s, d).select(F.explode("error_categories").alias("c")).where("c.type = 'substitute'")
    pairs = c.select(F.split("c.ref", " ")[0].alias("a"), F.split("c.hyp", " ")[0].alias("b")).distinct()
    codes = word_codes(pairs.select(F.explode(F.array("a", "b")).alias("word"))).select("word", F.struct("primary", "secondary").alias("code"))
    left, right = codes.toDF("a", "ca"), codes.toDF("b", "cb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", phonetic_similar(F.col("ca"), F.col("cb")).alias("similar"))


@query("f26_metaphone_distance")
def _(s, d):
    """Neighbouring words of all turns, and the distance of their codes."""
    from uttermark.functions.phonetic import code_distance, main_code, word_codes

    ref = text_rows(s, d).where("cond = 0").select("ref").distinct()
    pairs = ref.select(F.explode(F.expr("transform(slice(ref, 1, size(ref) - 1), (w, i) -> struct(w as a, ref[i + 1] as b))")).alias("p")).select("p.*").distinct()
    codes = word_codes(pairs.select(F.explode(F.array("a", "b")).alias("word"))).select("word", main_code(F.struct("primary", "secondary")).alias("code"))
    left, right = codes.toDF("a", "ca"), codes.toDF("b", "cb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", code_distance(F.col("ca"), F.col("cb")).alias("distance"))


@query("f27_row_phonetic_distance")
def _(s, d):
    return annotated(s, d).select("slurp_id", "cond", "phonetic_distance", "full_hallucination")


@query("f23_classify_substitution")
def _(s, d):
    """Error subtypes of the texts' chunks by condition and position."""
    return K.error_subtype_table(annotated(s, d), ["degradation"])


@query("f3_token_surfaces", "select conv_id, turn, regexp_replace(lower(text), '[''’ʼ]|[!-/:-@\\[-`{-~]', '', 'g') surface from (select conv_id, turn, trim(text) text from conversations)", "")
def _(s, d):
    t = read(s, d, "conversations")
    return t.select("conv_id", "turn", F.element_at(X.token_surfaces(F.array(F.struct(F.trim("text").alias("surface")))), 1).alias("surface"))


# --- validation, sources and streams ----------------------------------------------------------------------------


def damaged(s: SparkSession, d: str) -> DataFrame:
    """Rows of which some break a rule."""
    return eval_rows(s, d).selectExpr(
        "slurp_id", "case when slurp_id%11=0 and cond=1 then 'both' else pathway end pathway", "model_family", "asr_model", "llm_model", "predicted_intent", "gold_intent",
        "degradation", "case when slurp_id%13=0 and cond=0 then 10 when slurp_id%17=0 and cond=5 then null else snr_db end snr_db",
        "case when slurp_id%19=0 and cond=2 then -wer-1 else wer end wer", "tsa", "pf", "case when slurp_id%23=0 then 1-ees else ees end ees", "ees_strict",
    )


_DAMAGED = """, dm as (select case when slurp_id%11=0 and cond=1 then 'both' else pathway end pathway, slurp_id, degradation, asr_model,
    case when slurp_id%13=0 and cond=0 then 10 when slurp_id%17=0 and cond=5 then null else snr_db end snr_db, case when slurp_id%19=0 and cond=2 then -wer-1 else wer end wer,
    tsa, pf, case when slurp_id%23=0 then 1-ees else ees end ees, ees_strict from ev),
vi as (select 'bad_enum' rule, 'pathway' field, slurp_id from dm where pathway not in ('cascade','omni')
    union all select 'clean_row_has_snr', 'snr_db', slurp_id from dm where degradation='clean' and snr_db is not null
    union all select 'degraded_row_has_no_snr', 'snr_db', slurp_id from dm where degradation<>'clean' and snr_db is null
    union all select 'cascade_asr_model_null', 'asr_model', slurp_id from dm where asr_model is null and pathway='cascade'
    union all select 'cascade_metric_null', 'wer', slurp_id from dm where wer is null and pathway='cascade'
    union all select 'value_out_of_range', 'wer', slurp_id from dm where wer<0
    union all select 'ees_formula', 'ees', slurp_id from dm where ees<>case when pf is null then tsa else cast(tsa=1 and pf>=0.5 as int) end)"""


@query("v1_schema_report", "select rule, field, count(*) n, count(distinct slurp_id) keys, min(slurp_id) as \"first\" from vi group by all", CELLS + _DAMAGED)
def _(s, d):
    from uttermark.operators.validate import schema_report, validate_rows

    # fields that these rows never have would break a rule in every row; they are left out before the report counts keys
    rows = validate_rows(damaged(s, d)).withColumn("violations", F.filter("violations", lambda v: v["rule"] != "missing_field"))
    report = schema_report(rows, examples=0)
    return report.select("rule", "field", "n", "keys", "first")


@query("p4_clear_prediction_fields", "select slurp_id, asr_model, degradation, snr_db, wer, cast(null as varchar) llm_model, cast(null as int) tsa, cast(null as int) ees from ev")
def _(s, d):
    return R.clear_prediction_fields(eval_rows(s, d)).select("slurp_id", "asr_model", "degradation", "snr_db", F.round("wer", 6).alias("wer"), "llm_model", "tsa", "ees")


SQL["p4_clear_prediction_fields"] = SQL["p4_clear_prediction_fields"].replace("snr_db, wer,", "snr_db, round(wer,6) wer,")


_BLANK = "asr_model is not null and item=0"
_STAMPED = f"{_BLANK} and not (predicted_intent='NO_TRANSCRIPTION' and tsa=0)"


@query(
    "p5_stamp_no_transcription",
    f"select slurp_id, cond, llm_model, pathway, case when {_STAMPED} then 'NO_TRANSCRIPTION' else predicted_intent end predicted_intent, case when {_STAMPED} then 'NO_TRANSCRIPTION' else predicted_intent end predicted_intent_raw, case when {_BLANK} then 0 else tsa end tsa, case when {_STAMPED} then 0 else 1 end n_parameters, case when {_STAMPED} then ' | no_transcription' end notes from ev",
)
def _(s, d):
    rows = eval_rows(s, d).withColumns(
        {
            "transcription": F.when(F.col("item") == 0, F.lit(" ")).otherwise("text"), "notes": F.lit(None).cast("string"), "predicted_intent_raw": F.col("predicted_intent"),
            "predicted_parameters": F.create_map(F.lit("item"), F.col("item").cast("string")),
        }
    )
    out = R.stamp_no_transcription(rows)
    return out.select("slurp_id", "cond", "llm_model", "pathway", "predicted_intent", "predicted_intent_raw", "tsa", F.size("predicted_parameters").alias("n_parameters"), "notes")


_ANSWER = """case slurp_id%7 when 0 then concat('{"intent":"', predicted_intent, '","parameters":{"a":"b"}}') when 1 then '{"parameters":{}}' when 2 then 'no json' when 3 then '{"error":"llm_request_failed","detail":"x"}'
    when 4 then 'null' when 5 then concat('```json {"intent":"', upper(gold_intent), '"} ```') else '{"error":"other"}' end"""
_RAW = "case when blank then 'NO_TRANSCRIPTION' when slurp_id%7=0 then predicted_intent when slurp_id%7=1 then 'MISSING_INTENT' when slurp_id%7=5 then upper(gold_intent) else 'JSON_PARSE_ERROR' end"
_KNOWN = ", ".join(f"'{x}'" for x in LABELS)
_NORMAL = f"case when raw in ({_KNOWN}, 'JSON_PARSE_ERROR') or blank then raw when lower(raw)='set_alarm' then 'alarm_set' else lower(raw) end"


@query(
    "p7_apply_predictions",
    f"""select slurp_id, cond, asr_model, llm_model, case when not failed then raw end predicted_intent_raw, case when not failed then {_NORMAL} end predicted_intent,
    case when not failed then cast(case when blank then 0 else {_NORMAL}=gold_intent end as int) end tsa, case when not failed then cast(not blank and slurp_id%7=0 as int) end n_parameters, failed from
    (select *, {_RAW} raw, slurp_id%7=3 and not blank failed from (select *, item=0 and asr_model is not null and cond%2=0 blank from ev))""",
)
def _(s, d):
    keys = ["slurp_id", "cond", "asr_model", "llm_model"]
    blank = F.expr("item=0 and asr_model is not null and cond%2=0")
    rows = eval_rows(s, d).withColumns({"transcription": F.when(blank, F.lit("")).otherwise("text"), "notes": F.lit("")})
    responses = rows.where(~blank).select(*keys, F.expr(_ANSWER).alias("response"))
    scored = R.with_predictions(rows, responses, keys, LABELS)
    n = F.when(~F.col("failed"), F.size("predicted_parameters"))  # the size of a null is not null
    return scored.select(*keys, "predicted_intent_raw", "predicted_intent", "tsa", n.alias("n_parameters"), "failed")


@query("p6_no_transcription_violations", "select slurp_id, cond, llm_model from ev where asr_model is not null and item=0 and predicted_intent<>'NO_TRANSCRIPTION'")
def _(s, d):
    rows = eval_rows(s, d).withColumn("transcription", F.when(F.col("item") == 0, F.lit("")).otherwise("text"))
    return R.no_transcription_violations(rows).select("slurp_id", "cond", "llm_model")


@query("p8_drop_hallucinations", "select slurp_id, cond, asr, llm from er where not coalesce(wer>=1, false)")
def _(s, d):
    return R.drop_hallucinations(cells(s, d).withColumn("full_hallucination", F.col("wer") >= 1)).select("slurp_id", "cond", "asr", "llm")


@query("p10_critical_substitution_rows", "select distinct slurp_id, asr, llm, cond from ch where type='substitute' and pos='critical' and item>0", CHUNKS)
def _(s, d):
    rows = with_distance(with_chunks(s, d)).withColumn("phonetic_distance", F.when(F.col("item") > 0, F.col("phonetic_distance")))
    return R.critical_substitution_rows(rows).select("slurp_id", "asr", "llm", "cond")


@query("j1_join_gold", "select tid, cond, sentence, len(ref) n_tokens from tx", TEXT)
def _(s, d):
    t = text_rows(s, d)
    joined = R.join_gold(t.select(F.col("tid").alias("slurp_id"), "cond"), text_gold(t))
    return joined.select(F.col("slurp_id").alias("tid"), "cond", "sentence", F.size("tokens").cast("long").alias("n_tokens"))


_SHORT = "regexp_extract(gold_intent, '^[a-z]+_(.*)$', 1)"


@query("j2_override_labels", "select slurp_id, case when slurp_id%7=0 then 'corrected' else gold_intent end label, slurp_id%7=0 overridden from (select distinct slurp_id, gold_intent from ev)")
def _(s, d):
    """Half of the gold labels lack their scenario, which is put before them again."""
    gold = eval_rows(s, d).select("slurp_id", "gold_intent").distinct()
    gold = gold.withColumn("scenario", F.regexp_extract("gold_intent", "^([a-z]+)_", 1))
    gold = gold.withColumn("gold_intent", F.when(F.col("slurp_id") % 2 == 0, F.expr(_SHORT)).otherwise(F.col("gold_intent")))
    fixed = gold.where("slurp_id % 7 = 0").select("slurp_id", F.lit("corrected").alias("label"))
    return R.override_labels(gold, fixed, LABELS).select("slurp_id", "label", "overridden")


@query("j13_point_with_interval", f"select {CELL}, {r('avg(ees)')} retention, {r('avg(ees)-0.1')} lo, {r('avg(ees)+0.1')} hi from pd group by all")
def _(s, d):
    points = C.paired_stats(cells(s, d)).where("n_paired > 0").select("asr", "degradation", "snr_db", "llm", "retention")
    bands = points.select("asr", "degradation", "snr_db", "llm", (F.col("retention") - 0.1).alias("lo"), (F.col("retention") + 0.1).alias("hi"), F.lit(True).alias("has_interval"))
    return J.point_with_interval(points, bands)


@query("f2_normalize_hyp", "select conv_id, turn, trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '[''’ʼ]', '', 'g')), '[!-/:-@\\[-`{-~]', ' ', 'g'), '\\s+', ' ', 'g')) norm from conversations", "")
def _(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", X.normalize_hyp(F.col("text")).alias("norm"))


@query("f14_normalize_value", "select p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) || ' 7 20' norm from part", "")
def _(s, d):
    return read(s, d, "part").select("p_partkey", P.normalize_value(F.concat("p_name", F.lit("  Seven, twenty!"))).alias("norm"))


@query("f13_canonical_map", "select p_partkey, p_name || '|' || p_type entries, p_partkey%3<>0 or p_name=p_type same, p_partkey%3<>1 swapped from part", "")
def _(s, d):
    """Maps with their entries in another order, sometimes with another value or a key more."""
    t = read(s, d, "part").withColumn("k", F.col("p_partkey") % 3)
    a = F.create_map(F.lit("x"), "p_name", F.lit("y"), "p_type")
    b = F.create_map(F.lit("y"), "p_type", F.lit("x"), F.when(F.col("k") == 0, F.col("p_type")).otherwise(F.col("p_name")))
    c = F.when(F.col("k") == 1, F.create_map(F.lit("x"), "p_name", F.lit("z"), "p_type")).otherwise(F.create_map(F.lit("y"), "p_type", F.lit("x"), "p_name"))
    values = F.array_join(F.transform(J.canonical_map(a), lambda e: e["value"]), "|")
    same = lambda x: J.canonical_map(a) == J.canonical_map(x)
    return t.select("p_partkey", values.alias("entries"), same(b).alias("same"), same(c).alias("swapped"))


_NUMBERS = ["seven", "TWENTIETH ", "7", "7.5", "7,5", "7.", "seven7", "7th", "twice", "3.5.1", "", "half"]
_IS_NUMBER = "regexp_full_match(lower(trim(word)), '[0-9]+([.,][0-9]+)?') or lower(trim(word)) in ('seven', 'twentieth', 'twice')"


@query(
    "f20_is_numeric",
    f"select p_partkey, word, {_IS_NUMBER} is_numeric from (select p_partkey, p_size::varchar word from part union all select p_partkey, p_name from part union all select p_partkey, {_NUMBERS}[1+p_partkey%12] from part)",
    "",
)
def _(s, d):
    """Sizes, names, and words that nearly are numbers."""
    from uttermark.functions.errors import is_numeric

    part = read(s, d, "part")
    odd = F.array(*map(F.lit, _NUMBERS))[(F.col("p_partkey") % len(_NUMBERS)).cast("int")]
    words = [F.col("p_size").cast("string"), F.col("p_name"), odd]
    every = part.select("p_partkey", F.explode(F.array(*words)).alias("word"))
    return every.withColumn("is_numeric", is_numeric(F.col("word")))


@query("w5_slot_suffix", "select p_partkey, case p_partkey%3 when 0 then 'a,b,a_2' when 1 then 'a,a_2,a_3' else 'a,b,b_2' end names from part", "")
def _(s, d):
    types = F.split(F.when(F.col("p_partkey") % 3 == 0, "a,b,a").when(F.col("p_partkey") % 3 == 1, "a,a,a").otherwise("a,b,b"), ",")
    return read(s, d, "part").select("p_partkey", F.array_join(X.slot_suffix(types), ",").alias("names"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
