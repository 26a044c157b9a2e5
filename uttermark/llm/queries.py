"""Thin queries over the operators, one for each, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.llm import align, decontam, langid, licences, lm, minhash, mixing, packing, quality, resample, rules, sharding, suffix

TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.shard(rows, 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_of(_read(spark, sf_dir, "documents"), shingle=2, percent=80)


def _remainder(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "common", "item_shingles", "containment")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    net = quality.fit(docs, labels.where(_remainder(5) != 0))
    held_out = (_remainder(5) == 0).alias("held_out")
    scored = quality.score(docs, net) if net else docs.select("doc_id", F.lit(0.5).alias("score"))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(_read(spark, sf_dir, "documents"), width=50)
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    ratio = rules.log_ratio(docs, rules.trusted_texts(docs, trusted))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    return rules.judge(docs, ratio).select(cols)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = lm.score(docs, public_tokenizers.path(VOCABULARY), _remainder(7) != 2)
    held_out = (_remainder(7) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", F.col("mixed_score").alias("score"), F.col("score").alias("lattice_score"), "adapted_score")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_remainder(5) != 0))
    held_out = (_remainder(5) == 0).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, mixing.cyclic_weights(docs, [1, 2, 3]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return align.align(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(VOCABULARY))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_sharding": op2_sharding,
        "op3_decontamination": op3_decontamination,
        "op4_quality": op4_quality,
        "op5_suffix": op5_suffix,
        "op6_rules": op6_rules,
        "op7_licences": op7_licences,
        "op8_minhash": op8_minhash,
        "op9_lm": op9_lm,
        "op10_langid": op10_langid,
        "op11_mixing": op11_mixing,
        "op12_alignment": op12_alignment,
        "op13_resample": op13_resample,
    }


_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_RUNS = "list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))"

SQL = {
    "op11_mixing": r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size from documents),
    s as (select source, cast(sum(size) as bigint) source_size, (row_number() over (order by source is null, source) - 1) % 3 + 1 weight from d group by source),
    c as (select *, 3 * source_size cap, sum(3 * source_size) over o caps, sum(weight) over o weights, sum(source_size) over () total, sum(weight) over () every
        from s window o as (order by 3.0 * source_size / weight, source rows unbounded preceding)),
    f as (select *, cast(cap as double) * (every - weights + weight) <= cast(weight as double) * (total - caps + cap) reached from c),
    t as (select source, source_size, case when reached then cast(cap as double) else
        cast(weight * (total - coalesce(sum(cap) filter (reached) over (), 0)) as double) / cast(every - coalesce(sum(weight) filter (reached) over (), 0) as double) end target from f),
    b as (select *, cast(floor(target + 0.5) as bigint) budget, coalesce(sum(size) over (partition by d.source order by md5('17:' || coalesce(cast(doc_id as varchar), '')), doc_id, size
        rows between unbounded preceding and 1 preceding), 0) before from d join t on d.source is not distinct from t.source)
    select doc_id, cast(size as bigint) size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) as bigint) taken, epochs
    from (select *, coalesce(budget // nullif(source_size, 0), 0) epochs from b)""",
    "op3_decontamination": f"""with i as (select item_id, least(5, len(w)) k, w from (select item_id, {_WORDS.format(t="text")} w from benchmark) where len(w) > 0),
    b as (select distinct item_id, k, unnest({_RUNS}) s from i),
    n as (select item_id, count(*) item_shingles from b group by item_id),
    d as (select distinct doc_id, k, unnest({_RUNS}) s from (select doc_id, {_WORDS.format(t="text")} w from documents), (select distinct k from i) where len(w) >= k)
    select doc_id, item_id, count(*) common, any_value(item_shingles) item_shingles, count(*) / any_value(item_shingles) containment
    from d join b using (k, s) join n using (item_id) group by doc_id, item_id having 100 * count(*) >= 80 * any_value(item_shingles)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
