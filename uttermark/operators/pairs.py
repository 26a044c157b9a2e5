"""Joins of evaluation rows: clean anchors, passes, routers and pathways."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from uttermark.keys import CELL, CLIP, ITEM, UNDERPOWERED, is_clean, same


def first_per_key(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an explicit order, with the number of its repeats (``repeats``).

    The row is chosen and the repeats are counted by one aggregation, partly in each task already, so a key with very many rows
    costs one row for each task. A null in ``order`` comes first, as in a sort. Of rows that are equal in ``order``, any may be
    taken. Null keys are keys like any other; columns of any type are kept.
    """
    whole = F.struct(*(F.col(c) for c in rows.columns))
    # a null is before all values; a struct of flag and value says so wherever structs are compared
    place = F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in order))
    pick = F.max_by if last else F.min_by
    chosen = rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(pick(whole, place).alias("__row"), (F.count(F.lit(1)) - 1).alias("__more"))
    return chosen.select("__row.*", F.col("__more").alias("repeats"))


SOURCE = ["file", "block", "line"]  #: where a row was read, as ``sources.read_rows`` gives it


def _anchor_value(rows: DataFrame, outcome: str, order: list[str] | None) -> Column:
    """What is least in an item's anchor of all its clean rows."""
    by = order if order is not None else [c for c in SOURCE if c in rows.columns]
    return F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(by)), F.col(outcome).alias("y"), F.col("wer").alias("w"))


def anchors(rows: DataFrame, outcome: str = "ees", order: list[str] | None = None) -> DataFrame:
    """One clean row for each item: its outcome and error rate. Of repeated rows, the first by ``order``, which is
    the rows' place in their files unless given. Rows without a place are taken by outcome and error rate."""
    value = _anchor_value(rows, outcome, order)
    clean = rows.where(is_clean()).groupBy(*ITEM).agg(F.min(value).alias("v"))
    return clean.select(*ITEM, F.col("v.y").alias("clean_outcome"), F.col("v.w").alias("clean_wer"), F.lit(True).alias("has_anchor"))


def with_anchor(rows: DataFrame, outcome: str = "ees", order: list[str] | None = None, rated: bool = True) -> DataFrame:
    """Every row beside its item's clean outcome and error rate. Rows without an error rate (omni) are left out
    unless ``rated`` is false."""
    can = rows.where("wer is not null") if rated else rows
    joined = can.join(anchors(can, outcome, order), ITEM, "left")
    return joined.withColumn("has_anchor", F.coalesce("has_anchor", F.lit(False)))


def together_with_anchor(rows: DataFrame, columns: list[str], outcome: str = "ees", order: list[str] | None = None) -> DataFrame:
    """``columns`` of all rows and their item's ``clean_outcome``, as ``with_anchor`` gives it, with all rows of an utterance in one task
    and side by side: they are moved once, by the utterance, and an item's anchor is found among its neighbours."""
    own = rows.select(*dict.fromkeys([*ITEM, *columns]), F.when(is_clean(), _anchor_value(rows, outcome, order)).alias("__anchor"))
    own = own.repartition("slurp_id").sortWithinPartitions(*ITEM)
    found = F.min("__anchor").over(W.partitionBy(*ITEM))["y"]
    return own.withColumn("clean_outcome", F.when(F.col("slurp_id").isNotNull(), found)).drop("__anchor")


def paired_rows(rows: DataFrame, outcome: str = "ees", order: list[str] | None = None) -> DataFrame:
    """Degraded rows with an error whose clean row succeeded."""
    d = with_anchor(rows, outcome, order)
    return d.where(~is_clean() & (F.col("wer") > 0) & F.col(outcome).isNotNull() & (F.col("clean_outcome") == 1))


def pair_class(clean: Column, degraded: Column, wer: Column) -> Column:
    error = F.coalesce(wer, F.lit(0.0)) > 0
    return (
        F.when((clean == 1) & (degraded == 0), F.when(error, "PROPAGATED").otherwise("NEW_ERROR"))
        .when((clean == 1) & (degraded == 1), F.when(error, "ABSORBED").otherwise("SAME_OK"))
        .when((clean == 0) & (degraded == 1), "RECOVERED")
        .when((clean == 0) & (degraded == 0), "SAME_FAIL")
        .otherwise("OTHER")
    )


def classify_pairs(rows: DataFrame, outcome: str = "ees", order: list[str] | None = None) -> DataFrame:
    """Counts and shares of transitions from clean to degraded per cell, and the cell's retention: the share
    absorbed of what was absorbed or propagated, null without either."""
    d = with_anchor(rows, outcome, order, rated=False).where(~is_clean() & F.col("has_anchor"))
    d = d.withColumn("category", pair_class(F.col("clean_outcome"), F.col(outcome), F.col("wer")))
    counts = d.groupBy(*CELL, "category").agg(F.count(F.lit(1)).alias("n"))
    cell = W.partitionBy(*CELL)
    absorbed, propagated = (F.sum(F.when(F.col("category") == x, F.col("n")).otherwise(0)).over(cell) for x in ("ABSORBED", "PROPAGATED"))
    both = absorbed + propagated
    return counts.withColumns({"percent": 100 * F.col("n") / F.sum("n").over(cell), "retention": F.when(both > 0, absorbed / both)})


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided binomial p-value of two discordant counts."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * sum(map(math.exp, log)))


def paired_router_test(rows: DataFrame, a: str, b: str, outcome: str = "tsa") -> DataFrame:
    """Two routers on identical rows: rates, gap, discordant counts (``a_only``, ``b_only``) and their exact p-value."""
    keys = ["slurp_id", "asr_model", "degradation", "snr_db"]
    left = rows.where((F.col("llm") == a) & F.col(outcome).isNotNull()).select(*keys, F.col(outcome).alias("ya"))
    right = rows.where((F.col("llm") == b) & F.col(outcome).isNotNull()).select(*keys, F.col(outcome).alias("yb"))
    j = left.join(right, same(left, right, keys))
    count = lambda c: F.count(F.when(c, 1))
    sums = j.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("ya").alias("rate_a"),
        F.avg("yb").alias("rate_b"),
        (F.avg("yb") - F.avg("ya")).alias("gap"),
        count((F.col("ya") == 1) & (F.col("yb") == 0)).alias("a_only"),
        count((F.col("ya") == 0) & (F.col("yb") == 1)).alias("b_only"),
    )
    one = sums.first()  # one row; the p-value is a function of two counts
    return sums.sparkSession.createDataFrame([(*one, mcnemar(one["a_only"], one["b_only"]))], [*sums.schema.names, "p"])


def canonical_map(c: Column) -> Column:
    """A map's entries in order, for comparison by content."""
    return F.array_sort(F.map_entries(c))


PASS = ["slurp_id", "asr_model", "degradation", "snr_db", "llm_model"]


def determinism_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two passes at three levels: intent, intent or parameters, any score; rows of one pass alone are counted."""
    x, y = a.withColumn("in_a", F.lit(True)), b.withColumn("in_b", F.lit(True))
    j = x.join(y, same(x, y, PASS), "full_outer")
    both = F.col("in_a") & F.col("in_b")
    intent = ~x["predicted_intent"].eqNullSafe(y["predicted_intent"])
    params = ~canonical_map(x["predicted_parameters"]).eqNullSafe(canonical_map(y["predicted_parameters"]))
    score = ~x["tsa"].eqNullSafe(y["tsa"])
    for c in ("pf", "ees", "ees_strict"):
        score = score | ~x[c].eqNullSafe(y[c])
    count = lambda c: F.count(F.when(c, 1))
    return j.agg(
        count(both).alias("n_common"),
        count(both & intent).alias("intent_differs"),
        count(both & (intent | params)).alias("decision_differs"),
        count(both & score).alias("score_differs"),
        count(F.col("in_b").isNull()).alias("only_in_a"),
        count(F.col("in_a").isNull()).alias("only_in_b"),
    )


def outcome_drift(a: DataFrame, b: DataFrame, outcome: str = "tsa") -> DataFrame:
    """Mean outcome of each pass per condition, and the absolute difference."""
    x, y = a.select(*PASS, F.col(outcome).alias("ya")), b.select(*PASS, F.col(outcome).alias("yb"))
    j = x.join(y, same(x, y, PASS)).select(x["degradation"], x["snr_db"], "ya", "yb")
    out = j.groupBy("degradation", "snr_db").agg(F.count(F.lit(1)).alias("n"), F.avg("ya").alias("mean_a"), F.avg("yb").alias("mean_b"))
    return out.withColumn("drift", F.abs(F.col("mean_b") - F.col("mean_a")))


def drift_summary(a: DataFrame, b: DataFrame, outcome: str = "tsa") -> DataFrame:
    """Overall means of two passes over their common rows, their difference, and the mean absolute drift of conditions."""
    cells = outcome_drift(a, b, outcome)
    n = F.sum("n")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / n
    out = cells.agg(n.alias("n"), mean("mean_a").alias("mean_a"), mean("mean_b").alias("mean_b"), F.avg("drift").alias("mean_abs_drift"), F.max("drift").alias("max_drift"))
    return out.withColumn("drift", F.abs(F.col("mean_b") - F.col("mean_a")))


def worst_cells(drift: DataFrame, k: int) -> DataFrame:
    """The k conditions of largest drift; the key breaks ties."""
    return drift.orderBy(F.desc("drift"), "degradation", F.asc_nulls_first("snr_db")).limit(k)


def pathway_comparisons(rows: DataFrame, large_routers: list[str] | None = None) -> DataFrame:
    """Omni models beside the cascade routers of their family; comparisons with one of ``large_routers`` are
    ``confirmatory``, all others descriptive."""
    models = rows.select("llm", "model_family", F.coalesce("pathway", F.lit("cascade")).alias("pathway")).distinct()
    omni = models.where("pathway = 'omni'").select(F.col("llm").alias("omni_llm"), "model_family")
    cascade = models.where("pathway = 'cascade'").select(F.col("llm").alias("cascade_llm"), "model_family")
    return omni.join(cascade, "model_family").withColumn("confirmatory", F.col("cascade_llm").isin(large_routers or []))


def pathway_pairs(rows: DataFrame, asr: str, outcome: str = "ees") -> DataFrame:
    """Omni against cascade on the clips where the cascade's transcript has an error, per comparison and cell.
    Raises when a clip occurs twice on a side."""
    comp = pathway_comparisons(rows).drop("confirmatory")
    cascade = rows.where((F.col("pathway") == "cascade") & (F.col("asr") == asr) & (F.col("wer") > 0) & F.col(outcome).isNotNull())
    cascade = cascade.groupBy(F.col("llm").alias("cascade_llm"), *CLIP).agg(F.max(outcome).alias("yc"), F.count(F.lit(1)).alias("nc"))
    omni = rows.where((F.col("pathway") == "omni") & F.col(outcome).isNotNull())
    omni = omni.groupBy(F.col("llm").alias("omni_llm"), *CLIP).agg(F.max(outcome).alias("yo"), F.count(F.lit(1)).alias("no"))
    c = cascade.join(F.broadcast(comp), "cascade_llm")  # a row for each pair of models
    j = c.join(omni, same(c, omni, [*CLIP, "omni_llm"])).select(c["omni_llm"], "cascade_llm", c["degradation"], c["snr_db"], "yc", "yo", "nc", "no", c["slurp_id"])
    once = F.when((F.col("nc") > 1) | (F.col("no") > 1), F.raise_error(F.lit("a clip occurs twice")).cast("boolean")).otherwise(True)
    return j.where(once).drop("nc", "no")


def pathway_stats(pairs: DataFrame) -> DataFrame:
    out = pairs.groupBy("omni_llm", "cascade_llm", "degradation", "snr_db").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("yc").alias("cascade_rate"), F.avg("yo").alias("omni_rate")
    )
    return out.withColumns({"gain_pathway": F.col("omni_rate") - F.col("cascade_rate"), "underpowered": F.col("n_pairs") < UNDERPOWERED})


def pool_pathway_cells(cells: DataFrame) -> DataFrame:
    """Cells pooled to a degradation, weighted by their pairs; clean stays apart as anchor."""
    n = F.sum("n_pairs")
    out = cells.groupBy("omni_llm", "cascade_llm", "degradation").agg(
        n.alias("pairs"),
        F.count(F.lit(1)).alias("n_cells"),
        (F.sum(F.col("cascade_rate") * F.col("n_pairs")) / n).alias("cascade_rate"),
        (F.sum(F.col("omni_rate") * F.col("n_pairs")) / n).alias("omni_rate"),
    )
    return out.withColumns(
        {
            "gain_pathway": F.col("omni_rate") - F.col("cascade_rate"),
            "underpowered": F.col("pairs") < UNDERPOWERED,
            "scope": F.when(is_clean(), "anchor").otherwise("degradation"),
        }
    )


def design_grid(items: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every item under every condition; conditions are a handful of rows."""
    return items.crossJoin(F.broadcast(conditions))


def skip_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not among the done rows with a usable result."""
    return work.join(done.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct(), [work[k].eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")


def point_with_interval(points: DataFrame, intervals: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Point estimates beside their intervals; raises where an interval is missing."""
    j = points.join(intervals, same(points, intervals, keys), "left").drop(*(intervals[k] for k in keys))
    there = F.when(F.col("lo").isNull() & F.col("has_interval").isNull(), F.raise_error(F.lit("a cell has no interval")).cast("boolean")).otherwise(True)
    return j.where(there).drop("has_interval")


def capacity_gap(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Success of two routers per condition on the same rows, with gap and difficulty."""
    at = lambda x: F.avg(F.when(F.col("llm") == x, F.col("ees")))
    out = rows.where(F.col("llm").isin(a, b)).groupBy("asr", "degradation", "snr_db").agg(
        F.count(F.when(F.col("llm") == a, 1)).alias("n"), at(a).alias("ees_a"), at(b).alias("ees_b")
    )
    return out.withColumns({"gap": F.col("ees_b") - F.col("ees_a"), "difficulty": 1 - (F.col("ees_a") + F.col("ees_b")) / 2})


def capacity_summary(gaps: DataFrame) -> DataFrame:
    """Number of cells, mean gap, and Pearson correlation of the gap with the difficulty."""
    return gaps.agg(F.count("gap").alias("n_cells"), F.avg("gap").alias("mean_gap"), F.corr("gap", "difficulty").alias("r"))


def key_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def only_in_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def label_set_check(gold: DataFrame, ontology: DataFrame, label: str) -> DataFrame:
    """Labels that only one of two sets holds."""
    x, y = gold.select(label).distinct(), ontology.select(label).distinct()
    return x.subtract(y).withColumn("side", F.lit("gold")).unionByName(y.subtract(x).withColumn("side", F.lit("ontology")))
