"""Aggregates per analysis cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttermark.functions.errors import error_flags
from uttermark.keys import CELL, CURVE, HIGH_WER, UNDERPOWERED, cap_wer, is_clean, sigmoid
from uttermark.operators.pairs import with_anchor

OUTCOMES = ("tsa", "pf", "ees", "ees_strict")


def _check(outcome: str) -> None:
    if outcome not in OUTCOMES:
        raise ValueError(f"outcome must be one of {OUTCOMES}, got {outcome!r}")


def accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, correct and accuracy of intents per key; unscored rows are skipped."""
    return rows.where("tsa is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("tsa").alias("correct"), F.avg("tsa").alias("accuracy"))


def pivoted(rows: DataFrame, keys: list[str], column: str, levels: list[str], least: int) -> DataFrame:
    """Accuracy per key with a column for each level; null where fewer than ``least`` rows were scored."""
    aggs = []
    for level in levels:
        here = F.when(F.col(column) == level, F.col("tsa"))
        aggs.append(F.when(F.count(here) >= least, F.avg(here)).alias(level))
    return rows.groupBy(*keys).agg(*aggs)


def _where(cond: Column, value: Column | str) -> Column:
    return F.when(cond, F.col(value) if isinstance(value, str) else value)


def cell_stats(rows: DataFrame, outcome: str = "ees", keys: list[str] | None = None) -> DataFrame:
    """Counts, error rates, ceiling, absorption, naive baselines and gains per cell, in one aggregation.

    The median is over all rows with an error rate, not only scored ones; rates are capped at 1.
    """
    _check(outcome)
    return _cell_gains(rows.groupBy(*(keys or CELL)).agg(*_cell_aggregates(outcome)))


def _cell_aggregates(outcome: str) -> list[Column]:
    w, y = cap_wer(), F.col(outcome).cast("double")
    scored = F.col("wer").isNotNull() & y.isNotNull()
    err, perfect = scored & (F.col("wer") > 0), scored & (F.col("wer") == 0)
    count = lambda c: F.count(F.when(c, 1))
    return [
        F.count(F.lit(1)).alias("n"),
        count(scored).alias("n_scored"),
        count(err).alias("n_err"),
        count(perfect).alias("n_ceiling"),
        count(F.col("wer") > 1).alias("n_collapse"),
        F.avg(w).alias("mean_wer_all"),
        F.percentile(w, 0.5).alias("median_wer"),
        F.avg(_where(err, w)).alias("mean_wer_err"),
        F.avg(_where(scored, y)).alias("mean_outcome"),
        F.avg(_where(perfect, y)).alias("ceiling"),
        F.avg(_where(err, y)).alias("absorption"),
    ]


def _cell_gains(out: DataFrame) -> DataFrame:
    out = out.withColumns({"naive_legacy": 1 - F.col("mean_wer_all"), "naive_ceiling": F.col("ceiling") * (1 - F.col("mean_wer_err"))})
    return out.withColumns({"gain_legacy": F.col("absorption") - F.col("naive_legacy"), "gain_ceiling": F.col("absorption") - F.col("naive_ceiling")})


def stats_by_slot_position(rows: DataFrame, outcome: str = "ees") -> DataFrame:
    """``cell_stats`` apart for rows with a critical error and for rows with other errors only."""
    critical, function = error_flags(F.col("error_categories"))
    position = F.when(critical == 1, "critical").when(function == 1, "function")
    return cell_stats(rows.withColumn("slot_position", position).where("slot_position is not null"), outcome, [*CELL, "slot_position"])


def _paired(outcome: str) -> Column:
    y = F.col(outcome)
    return (~is_clean()) & (F.col("wer") > 0) & y.isNotNull()


def paired_stats(rows: DataFrame, outcome: str = "ees", order: list[str] | None = None) -> DataFrame:
    """Retention and gain per degraded cell, over items that succeeded on clean audio and whose transcript has an error."""
    _check(outcome)
    d = with_anchor(rows, outcome, order).where(~is_clean())
    return _paired_gains(d.groupBy(*CELL).agg(*_paired_aggregates(outcome)))


def _paired_aggregates(outcome: str) -> list[Column]:
    tested = _paired(outcome)
    kept = tested & (F.col("clean_outcome") == 1)
    return [
        F.count(F.when(kept, 1)).alias("n_paired"),
        F.count(F.when(tested & ~F.coalesce("has_anchor", F.lit(False)), 1)).alias("n_dropped_no_anchor"),
        F.avg(_where(kept, cap_wer())).alias("mean_wer_paired"),
        F.avg(_where(kept, F.col(outcome).cast("double"))).alias("retention"),
    ]


def _paired_gains(out: DataFrame) -> DataFrame:
    out = out.withColumn("naive_paired", 1 - F.col("mean_wer_paired"))
    return out.withColumns({"gain_paired": F.col("retention") - F.col("naive_paired"), "underpowered": F.col("n_paired") < UNDERPOWERED})


def paired_incremental(rows: DataFrame, outcome: str = "ees", order: list[str] | None = None) -> DataFrame:
    """As ``paired_stats``, charging only the error rate added over the clean row."""
    d = with_anchor(rows, outcome, order)
    kept = _paired(outcome) & (F.col("clean_outcome") == 1)
    added = F.greatest(cap_wer() - F.coalesce(cap_wer("clean_wer"), F.lit(0.0)), F.lit(0.0))
    out = d.where(kept).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_paired"), F.avg(added).alias("mean_incremental_wer"), F.avg(F.col(outcome).cast("double")).alias("retention")
    )
    out = out.withColumn("naive_incremental", 1 - F.col("mean_incremental_wer"))
    return out.withColumn("gain_incremental", F.col("retention") - F.col("naive_incremental"))


def predicted(wer: str = "wer") -> Column:
    """What the clean curve (a, b) predicts; null where it was refused."""
    return sigmoid(F.col("a") + F.col("b") * cap_wer(wer))


def calibrated_stats(rows: DataFrame, curves: DataFrame, outcome: str = "ees") -> DataFrame:
    """Observed minus predicted over the full degraded sample of each cell; the text of a refusal stays beside nulls."""
    d = rows.where(~is_clean() & F.col("wer").isNotNull() & F.col(outcome).isNotNull())
    d = d.join(F.broadcast(curves), CURVE, "left")  # a row for each pair of models
    out = d.groupBy(*CELL).agg(*_calibrated_aggregates(outcome, F.lit(True)))
    return out.withColumn("gain_calibrated", F.col("mean_observed") - F.col("mean_predicted"))


def _calibrated_aggregates(outcome: str, scored: Column) -> list[Column]:
    usable = scored & F.col("a").isNotNull()
    y = F.col(outcome).cast("double")
    return [
        F.count(F.when(scored, 1)).alias("n_calibrated"),
        F.avg(_where(usable, y)).alias("mean_observed"),
        F.avg(_where(scored, predicted())).alias("mean_predicted"),
        F.avg(_where(usable, (cap_wer() >= HIGH_WER).cast("double"))).alias("share_at_high_wer"),
        F.max(_where(usable, "n_clean_at_high_wer")).alias("n_clean_at_high_wer"),
        F.max(F.when(scored & F.col("a").isNull(), F.coalesce("refused", F.lit("no clean calibration")))).alias("refused"),
    ]


def calibrated_paired(rows: DataFrame, curves: DataFrame, outcome: str = "ees", order: list[str] | None = None) -> DataFrame:
    """On the paired subset, each item's own survival: min(P(degraded) / P(clean), 1)."""
    d = with_anchor(rows, outcome, order).where(_paired(outcome) & (F.col("clean_outcome") == 1))
    d = d.join(F.broadcast(curves), CURVE, "left")
    clean = sigmoid(F.col("a") + F.col("b") * F.coalesce(cap_wer("clean_wer"), F.lit(0.0)))
    ratio = F.when(clean <= 0, F.lit(1.0)).when(clean.isNotNull(), F.least(predicted() / clean, F.lit(1.0)))
    usable = F.col("a").isNotNull()
    out = d.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_paired"), F.avg(_where(usable, F.col(outcome).cast("double"))).alias("retention"), F.avg(ratio).alias("mean_predicted")
    )
    return out.withColumn("gain_calibrated_paired", F.col("retention") - F.col("mean_predicted"))


def absorption_table(rows: DataFrame, curves: DataFrame, outcome: str = "ees", order: list[str] | None = None) -> DataFrame:
    """Cell, paired and calibrated statistics of every degraded cell, in one aggregation after one join.

    A cell without a row that can be paired (or calibrated) has nulls in place of those statistics.
    """
    _check(outcome)
    d = with_anchor(rows, outcome, order, rated=False).where(~is_clean())
    d = d.join(F.broadcast(curves), CURVE, "left")  # a row for each pair of models
    scored = F.col("wer").isNotNull() & F.col(outcome).isNotNull()
    rated = F.count("wer").alias("__rated")
    out = d.groupBy(*CELL).agg(*_cell_aggregates(outcome), *_paired_aggregates(outcome), *_calibrated_aggregates(outcome, scored), rated)
    out = _paired_gains(_cell_gains(out)).withColumn("gain_calibrated", F.col("mean_observed") - F.col("mean_predicted"))
    # as if joined: cells without a rated row have no paired part, cells without a scored one no calibrated part
    gone = {c: F.when(F.col("__rated") > 0, F.col(c)) for c in ("n_paired", "n_dropped_no_anchor", "underpowered")}
    return out.withColumns({**gone, "n_calibrated": F.when(F.col("n_calibrated") > 0, F.col("n_calibrated"))}).drop("__rated")


def report_cells(rows: DataFrame) -> DataFrame:
    """Means per cell with the upper of the middle error rates as median.

    Rows are first counted and summed by cell and distinct rate, in hash tables: percentiles over the rows themselves would sort them all
    where there are more than some hundred cells. The median is the first rate that over half of a cell's rates don't lie above.
    """
    count = lambda c: F.count(F.when(c, 1))
    sums = {f"__{c}": F.sum(F.col(c).cast("double")) for c in OUTCOMES} | {f"__n_{c}": F.count(c) for c in OUTCOMES}
    made = {"__n": F.count(F.lit(1)), "__collapse": count(F.col("wer") > 1), **sums}
    rates = rows.groupBy(*CELL, cap_wer().alias("__w")).agg(*(v.alias(k) for k, v in made.items()))
    rated = F.when(F.col("__w").isNotNull(), F.col("__n"))
    cell = Window.partitionBy(*CELL)
    upto = cell.orderBy("__w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rates = rates.withColumns({"__upto": F.sum(rated).over(upto), "__all": F.sum(rated).over(cell)})
    return rates.groupBy(*CELL).agg(
        F.sum("__n").alias("n"),
        *(F.try_divide(F.sum(f"__{c}"), F.sum(f"__n_{c}")).alias(f"mean_{c}") for c in OUTCOMES),
        F.try_divide(F.sum(F.col("__w") * F.col("__n")), F.sum(rated)).alias("mean_wer"),
        F.sum("__collapse").alias("n_collapse"),
        F.min(F.when(2 * F.col("__upto") > F.col("__all"), F.col("__w"))).alias("median_upper"),
    )


def dose_response(rows: DataFrame) -> DataFrame:
    """Accuracy per degradation at clean and three noise levels; the clean value stands in every row."""
    clean = rows.where(is_clean()).agg(F.avg("tsa").alias("clean"))
    at = lambda s: F.avg(F.when(F.col("snr_db") == s, F.col("tsa"))).alias(f"snr_{s}")
    levels = rows.where(~is_clean()).groupBy("degradation").agg(at(20), at(10), at(0))
    return levels.crossJoin(F.broadcast(clean))  # one row


def condition_grid(rows: DataFrame, snr: int = 10, least: int = 5) -> DataFrame:
    """Accuracy per intent and condition at one noise level and on clean audio, where enough rows were scored."""
    kept = rows.where(is_clean() | (F.col("snr_db") == snr)).where("tsa is not null")
    return kept.groupBy("gold_intent", "degradation").agg(F.count(F.lit(1)).alias("n"), F.avg("tsa").alias("accuracy")).where(F.col("n") >= least)


def sweep_facts(rows: DataFrame) -> DataFrame:
    """Rows, cells and models; a cell with nulls in its key counts."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.struct("asr_model", "degradation", "snr_db", "llm_model")).alias("cells"),
        F.count_distinct("asr_model").alias("asrs"),
        F.count_distinct("llm_model").alias("routers"),
        F.count_distinct("pathway").alias("pathways"),
    )


def extreme_cells(paired: DataFrame) -> DataFrame:
    """Cells of lowest and highest retention; the key breaks ties."""
    name = F.concat_ws("|", "asr", "degradation", F.col("snr_db").cast("string"), "llm")
    rank = lambda sign: F.struct((F.col("retention") * sign).alias("v"), name.alias("k"))
    low, high = F.min(rank(1)), F.min(rank(-1))
    return paired.agg(low["k"].alias("lowest"), low["v"].alias("lowest_retention"), high["k"].alias("highest"), (-high["v"]).alias("highest_retention"))


def verdict_counts(intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    """Intervals above, below and over zero; an endpoint at zero does not exclude it."""
    above, below = F.col(lo) > 0, F.col(hi) < 0
    count = lambda c: F.count(F.when(c, 1))
    return intervals.agg(count(above).alias("above"), count(below).alias("below"), count(~above & ~below).alias("over_zero"))


def level_coverage(rows: DataFrame, column: str, cells: list[str]) -> DataFrame:
    """Distinct design cells of each level of a column."""
    return rows.groupBy(column).agg(F.count_distinct(F.struct(*cells)).alias("n_cells"))


def thin_levels(rows: DataFrame, column: str, cells: list[str], least: float = 0.5) -> DataFrame:
    """Levels that cover less than a share of what the fullest level covers."""
    c = level_coverage(rows, column, cells)
    most = c.agg(F.max("n_cells").alias("most"))
    return c.crossJoin(F.broadcast(most)).where(F.col("n_cells") < least * F.col("most"))


def varying_terms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Whether each column has more than one value, null being one."""
    one = rows.agg(*((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("term"), (F.col(c) > 1).alias("varies")) for c in columns))).alias("x")).select("x.*")


def pathway_condition_means(rows: DataFrame) -> DataFrame:
    """Mean success per family, pathway and condition, and without full hallucinations; raises if the rows of a
    model are not one for every utterance and condition."""
    holes = rows.groupBy("llm", "asr").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("slurp_id").alias("u"), F.count_distinct(F.struct("degradation", "snr_db")).alias("c")
    )
    bad = holes.agg(F.count(F.when(F.col("n") != F.col("u") * F.col("c"), 1)).alias("bad"))
    out = rows.groupBy("model_family", "pathway", "degradation", "snr_db").agg(
        F.avg("ees").alias("mean_ees"), F.avg(F.when(~F.coalesce("full_hallucination", F.lit(False)), F.col("ees"))).alias("mean_ees_without")
    )
    checked = out.crossJoin(F.broadcast(bad))
    return checked.where(F.when(F.col("bad") > 0, F.raise_error(F.lit("incomplete grid")).cast("boolean")).otherwise(True)).drop("bad")


def ablation_table(answers: DataFrame, variants: list[str]) -> DataFrame:
    """Accuracy per condition with a column for each prompt variant; failed requests are counted, not scored."""
    aggs = [F.avg(F.when((F.col("variant") == v) & ~F.col("failed"), F.col("tsa"))).alias(v) for v in variants]
    return answers.groupBy("condition").agg(*aggs, F.count(F.when(F.col("failed"), 1)).alias("n_failed"))


def claim_checks(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed against expected values by claim; ``ok`` when they agree within the tolerance."""
    j = expected.join(observed, "claim", "left")
    return j.withColumn("ok", F.coalesce(F.abs(F.col("observed") - F.col("expected")) <= F.col("tolerance"), F.lit(False)))
