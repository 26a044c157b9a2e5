"""Evaluation rows and side tables derived from the given tables, once for Spark and as SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = [
    "alarm_set", "weather_query", "calendar_set", "play_music", "email_query", "lists_createoradd", "iot_hue_lightoff", "transport_taxi", "news_query",
]

_label = lambda of: "case " + " ".join(f"when ({of})%9={i} then '{x}'" for i, x in enumerate(LABELS)) + " end"
_conds = ", ".join(f"({i})" for i in range(19))

EVAL = f"""conds as (select * from (values {_conds}) as t(cond)),
three as (select * from (values (0), (1), (2)) as t(i)),
g as (select cond,
    case when cond=0 then 'clean' when cond<=3 then 'noise' when cond<=6 then 'reverb'
         when cond<=9 then 'farfield' when cond<=12 then 'codec' when cond<=15 then 'clipping'
         else 'babble' end degradation,
    case when cond=0 then null when (cond-1)%3=0 then 20 when (cond-1)%3=1 then 10 else 0 end snr_db,
    case when cond=0 then 0 else (cond-1)%3+1 end sev from conds),
m as (select a.i asr, l.i llm from three a cross join three l union all select -1, i+3 from three where i<2),
x as (select p_partkey id, 4+p_partkey%9 n_ref, g.*, m.*,
    p_partkey*7919+(case when asr<0 then 0 else asr end)*104729+cond*1299709 x1,
    p_partkey*6151+(asr+1)*15485863+cond*32452843+llm*49979687 x2
    from {{part}} cross join g cross join m),
h as (select *, (x1*x1%1000003)%1000 h1, ((x2%1000003)*(x2%1000003)%1000003)%1000 h2 from x),
e as (select *, case when h1>=985 then n_ref+h1%4
    else greatest(0,cast(floor(h1*(3+4*sev)/1000.0) as bigint)-1) end e from h),
t as (select *, case when asr<0 then 850-150*sev
    else 850-cast(floor(600.0*least(e,n_ref)/n_ref) as bigint) end thr from e),
r as (select id slurp_id, cond, e, n_ref,
    case when asr<0 then null else concat('org/asr-',asr) end asr_model,
    concat('org/llm-',llm) llm_model,
    case when asr<0 then 'omni' else 'cascade' end pathway,
    case when llm in (2,4) then 'google' else 'qwen' end model_family,
    degradation, snr_db,
    case when asr<0 then null else cast(e as double)/n_ref end wer,
    cast(h2<thr+100 as int) tsa,
    case when id%10=0 then null when h2*2<thr then cast(1.0 as double)
         when h2<thr then cast(0.5 as double) else cast(0.0 as double) end pf from t),
s as (select *, case when pf is null then tsa else cast(tsa=1 and pf>=0.5 as int) end ees,
    case when pf is null then tsa else cast(tsa=1 and pf>=1.0 as int) end ees_strict from r),
ev as materialized (select *, {_label("slurp_id")} gold_intent,
    case when tsa=1 then {_label("slurp_id")}
         when (slurp_id+cond)%4=0 then {_label("slurp_id+1")}
         when (slurp_id+cond)%4=1 then 'unknown'
         when (slurp_id+cond)%4=2 then 'set_alarm' else 'NO_TRANSCRIPTION' end predicted_intent,
    slurp_id%7 item from s)"""

#: with the cell columns of the library
CELLS = (
    EVAL.replace("{part}", "part")
    + """,
er as materialized (select *, case when asr_model is null then '?' else replace(asr_model,'org/','') end asr,
    replace(llm_model,'org/','') llm, case when wer is not null then least(wer,1.0) end w from ev),
anchor as (select slurp_id, asr, llm, wer wer_clean, ees ees_clean, tsa tsa_clean from er where degradation='clean'),
ad as (select er.*, anchor.wer_clean, anchor.ees_clean, anchor.slurp_id is not null has_anchor
    from er left join anchor using (slurp_id, asr, llm)),
pd as (select * from ad where degradation<>'clean' and wer>0 and ees is not null and ees_clean=1)"""
)

#: the same rows in a second pass: some changed, some missing
SECOND = """,
b2 as (select * from er where (slurp_id+cond)%101<>0),
second as (select slurp_id, asr_model, degradation, snr_db, llm_model, cond,
    case when (slurp_id+cond)%50=0 then concat(predicted_intent,'_x') else predicted_intent end predicted_intent,
    case when (slurp_id+cond)%37=0 then item+100 else item end item,
    case when (slurp_id+cond)%97=0 then 1-tsa else tsa end tsa, pf, ees, ees_strict from b2)"""

_WORDS = "filter(split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ')), ' '), x -> x <> '')"

TEXT = """tc as (select conv_id*1000+turn tid, list_filter(string_split_regex(regexp_replace(lower(text),'[^a-z0-9]+',' ','g'),' +'),
    lambda x: x<>'') ref from conversations),
tcond as (select * from (values (0),(1),(2),(3)) as t(cond)),
tk as (select tid, cond, ref, case when cond=0 then ref else flatten(list_transform(ref, lambda w, j:
    case when (tid*31+j*17+cond*7)%12<cond then [] when (tid*31+j*17+cond*7)%12=5 then [reverse(w)]
         when (tid*31+j*17+cond*7)%12=8 then [w,'uh'] else [w] end)) end hyp from tc, tcond where len(ref)>0),
tx as (select tid, cond, array_to_string(ref,' ') sentence, array_to_string(hyp,' ') transcription, ref, hyp from tk)"""


#: the same for Spark, in whole numbers: ``x1`` is reduced before it is squared, so that large part keys do not overflow, and floors of
#: quotients are integer divisions, without decimals in every row
SPARK_EVAL = EVAL.replace(" as materialized (", " as (")
for _sql, _whole in (
    ("(x1*x1%1000003)", "((x1%1000003)*(x1%1000003)%1000003)"),
    ("cast(floor(h1*(3+4*sev)/1000.0) as bigint)", "(h1*(3+4*sev) div 1000)"),
    ("cast(floor(600.0*least(e,n_ref)/n_ref) as bigint)", "(600*least(e,n_ref) div n_ref)"),
):
    assert _sql in SPARK_EVAL
    SPARK_EVAL = SPARK_EVAL.replace(_sql, _whole)
# errors and thresholds pass a generator of one row: a filter on what is made of them stays behind it, and is not pushed into the cross join
# as one expression that repeats the arithmetic for every mention of a column
_KEPT = "id, cond, n_ref, asr, llm, degradation, snr_db"
_once = f"once as (select {_KEPT}, v.e, v.h2, v.thr from t lateral view inline(array(named_struct('e', e, 'h2', h2, 'thr', thr))) v as e, h2, thr)"
assert SPARK_EVAL.count("\nr as (") == 1 and SPARK_EVAL.count("pf from t)") == 1
SPARK_EVAL = SPARK_EVAL.replace("\nr as (", f"\n{_once},\nr as (").replace("pf from t)", "pf from once)")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """209 evaluation rows for each part: models, conditions, error rates and outcomes by integer arithmetic."""
    part = read(spark, sf_dir, "part").select("p_partkey")
    # few bytes become 209 rows each, so the parts are spread over all cores first
    part = part.repartition(max(spark.sparkContext.defaultParallelism, 2), "p_partkey")
    return spark.sql(f"with {SPARK_EVAL} select * from ev", part=part)


def with_distance(rows: DataFrame) -> DataFrame:
    """Chunked rows with a phonetic distance where a critical substitution is among the chunks."""
    some = F.exists("error_categories", lambda c: (c["type"] == "substitute") & (c["slot_position"] == "critical"))
    return rows.withColumn("phonetic_distance", F.when(F.coalesce(some, F.lit(False)), F.col("item") / 7.0))


def text_gold(rows: DataFrame) -> DataFrame:
    """Gold annotations of the turns in ``text_rows``: every fourth word is an entity."""
    one = rows.where("cond = 0").selectExpr(
        "tid slurp_id", "sentence", "transform(ref, w -> named_struct('surface', w)) tokens",
        "transform(filter(sequence(1, size(ref)), j -> (tid+j)%4=0), j -> named_struct('type', case j%4 when 0 then 'person' when 1 then 'date' when 2 then 'time' else 'event_name' end, 'span', array(j-1))) entities",
    )
    return one


def second_pass(rows: DataFrame) -> DataFrame:
    """The rows again as another run would have made them: some altered, some missing."""
    return rows.where("(slurp_id+cond)%101<>0").selectExpr(
        "slurp_id", "asr_model", "degradation", "snr_db", "llm_model", "cond",
        "case when (slurp_id+cond)%50=0 then concat(predicted_intent,'_x') else predicted_intent end predicted_intent",
        "map('item', cast(case when (slurp_id+cond)%37=0 then item+100 else item end as string)) predicted_parameters",
        "case when (slurp_id+cond)%97=0 then 1-tsa else tsa end tsa", "pf", "ees", "ees_strict",
    )


#: six models and five conditions for each turn: two recognisers with two routers each, and two that hear the audio themselves
SPOKEN = """cond as (select * from (values (0,'clean',cast(null as int)),(1,'noise',20),(2,'babble',10),(3,'noise',0),(4,'babble',0)) as t(cond,degradation,snr_db)),
model as (select * from (values ('cascade','org/asr-0','org/llm-1','qwen'),('cascade','org/asr-0','org/llm-2','google'),('cascade','org/asr-1','org/llm-1','qwen'),
    ('cascade','org/asr-1','org/llm-2','google'),('omni',null,'org/omni-1','qwen'),('omni',null,'org/omni-2','google')) as t(pathway,asr_model,llm_model,model_family)),
heard as (select tid, ref, cond, asr_model, coalesce(cast(right(asr_model,1) as int),0) a from {ref}, cond, (select distinct asr_model from model)),
said as (select tid, cond, asr_model, case when asr_model is null then null when (tid+cond*3+a)%97=0 then '' else array_join(flatten(transform(ref, (w, i) ->
    case when (tid*31+i*17+cond*7+a*5)%14<cond then cast(array() as array<string>) when cond+a>0 and (tid*31+i*17+cond*7+a*5)%14=5 then array(reverse(w))
         when cond>0 and (tid*31+i*17+cond*7+a*5)%14=8 then array(w,'uh') else array(w) end)),' ') end transcription, ref from heard)"""


def spoken_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Transcripts of all turns by two recognisers under five conditions with the answers of models, and the turns' gold annotations.
    Answers go wrong more often the more a condition takes away; some are no JSON, some requests failed."""
    # a few large files become many rows each, so the turns are spread over all cores first
    conv = read(spark, sf_dir, "conversations").repartition(max(spark.sparkContext.defaultParallelism, 2), "conv_id", "turn")
    ref = spark.sql(f"select conv_id*1000+turn tid, {_WORDS} ref from {{conv}}", conv=conv).where("size(ref) > 0")
    gold = text_gold(ref.selectExpr("tid", "0 cond", "array_join(ref,' ') sentence", "ref"))
    gold = gold.selectExpr("*", f"{_label('slurp_id')} intent", "concat('s', slurp_id%3) scenario")
    luck = "(tid*7919+cond*104729+(length(llm_model)+cast(right(llm_model,1) as int)*3)*1299709+coalesce(cast(right(asr_model,1) as int),7)*611953)%1000003%100"
    intent = f"case when luck<88-8*cond-if(pathway='omni',4,0) then {_label('tid')} when luck%4=0 then {_label('tid+1')} when luck%4=1 then 'set_alarm' when luck%4=2 then 'unknown' else null end"
    answer = f"case when luck=99 then 'no json' when luck=98 then to_json(named_struct('error', 'llm_request_failed')) else to_json(named_struct('intent', {intent}, 'parameters', given)) end"
    rows = spark.sql(
        f"""with {SPOKEN}, every as (select said.*, cond.degradation, cond.snr_db, model.pathway, model.llm_model, model.model_family from said join cond using (cond)
            join model on model.asr_model is not distinct from said.asr_model),
        lucky as (select *, {luck} luck, case when (tid+cond)%7=0 then map() when ({luck})%9=4 then map('a', 'zzz') when ({luck})%5<2+cond then map('a', coalesce(get(ref, cast(3-tid%4 as int)),'x'), 'b', 'zzz') else map('a', array_join(ref,' ')) end given from every)
        select tid slurp_id, concat('turn-', tid, '.wav') audio_file, pathway, model_family, asr_model, degradation, snr_db, cast(tid as bigint) rng_seed, transcription, llm_model, 'v1' llm_prompt_variant,
            cast(null as string) notes, case when transcription='' then null else {answer} end response from lucky""",
        ref=ref,
    )
    return rows, gold


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and hypothesis word lists of all turns: words dropped, reversed or followed by a filler."""
    # a few large files become many rows each, so the turns are spread over all cores first
    conv = read(spark, sf_dir, "conversations").repartition(max(spark.sparkContext.defaultParallelism, 2), "conv_id", "turn")
    return spark.sql(
        f"""with tc as (select conv_id*1000+turn tid, {_WORDS} ref from {{conv}}),
        tk as (select tid, cond, ref, case when cond=0 then ref else flatten(transform(ref, (w, i) ->
            case when (tid*31+(i+1)*17+cond*7)%12<cond then cast(array() as array<string>) when (tid*31+(i+1)*17+cond*7)%12=5 then array(reverse(w))
                 when (tid*31+(i+1)*17+cond*7)%12=8 then array(w,'uh') else array(w) end)) end hyp
            from tc cross join (values (0),(1),(2),(3)) as c(cond) where size(ref)>0)
        select tid, cond, array_join(ref,' ') sentence, array_join(hyp,' ') transcription, ref, hyp from tk""",
        conv=conv,
    )
