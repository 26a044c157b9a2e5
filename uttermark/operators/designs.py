"""The confirmatory regression designs, built and fitted one by one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.functions.errors import has_critical_substitution
from uttermark.keys import cap_wer
from uttermark.operators import gee
from uttermark.operators.rows import build_frame, frame_reason, reference_rows, snr_dummies


@dataclass
class Design:
    """One hypothesis: its rows, outcome, plain terms, factors (column to reference level), and what is tested."""

    outcome: str
    terms: list[str]
    factors: dict[str, str | None]
    rows: Callable[[DataFrame], DataFrame]
    required: list[str]
    interact: tuple[str, str] | None = None  #: two factors whose products are terms, too
    needs_wer: bool = True
    contrast: tuple[str, str] | None = None


def _cascade(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("pathway", F.lit("cascade")) == "cascade")


def _with_distance(rows: DataFrame) -> DataFrame:
    critical = F.col("critical_substitution") if "critical_substitution" in rows.columns else has_critical_substitution(F.col("error_categories"))
    return _cascade(rows).where(F.col("phonetic_distance").isNotNull() & critical)


USED = [
    "slurp_id", "pathway", "model_family", "asr", "llm", "degradation", "snr_db", "wer", "tsa", "ees", "pf", "has_critical_error", "has_function_error",
    "phonetic_distance", "critical_substitution",
]


def narrowed(rows: DataFrame) -> DataFrame:
    """Only what the designs read, for rows that are held while they are fitted: of the error chunks, whether a critical substitution is
    among them."""
    return rows.withColumn("critical_substitution", has_critical_substitution(F.col("error_categories"))).select(*USED)


NOISE = ["snr_20", "snr_10"]


def designs(asr: str, large_routers: list[str]) -> dict[str, Design]:
    """h1: errors in slots against errors in function words. h2: which routers absorb more. h3: phonetic distance against what is
    left of the parameters. h4b: whether the pathways differ, by degradation, against the reference cascade alone."""
    models = {"asr": None, "degradation": None, "llm": None}
    return {
        "h1": Design("tsa", ["wer", "has_critical_error", "has_function_error", *NOISE], models, _cascade, ["has_critical_error", "has_function_error"], contrast=("has_critical_error", "has_function_error")),
        "h2": Design("ees", ["wer", *NOISE], models, _cascade, ["llm"]),
        "h3": Design("pf", ["phonetic_distance", *NOISE], models, _with_distance, ["phonetic_distance"]),
        "h4b": Design(
            "ees", NOISE, {"pathway": "cascade", "degradation": "clean", "model_family": None}, lambda r: reference_rows(r, asr, large_routers),
            ["pathway", "degradation"], interact=("pathway", "degradation"), needs_wer=False,
        ),
    }


@dataclass
class Outcome:
    """What became of one design: coefficients, a contrast, a joint test, warnings, or why there is none."""

    model: str
    table: list[tuple[str, float, float, float, float]] = field(default_factory=list)
    contrast: tuple[float, float, float] | None = None
    joint: tuple[float, int, float] | None = None
    n: int = 0
    dropped: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    refused: str | None = None


def frame_of(rows: DataFrame, design: Design, outcome: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The design's rows with capped rate and noise flags, and how many were dropped, by reason."""
    own = design.rows(rows)
    if not design.needs_wer:
        own = own.withColumn("wer", F.coalesce("wer", F.lit(0.0)))
    frame, counts = build_frame(own, outcome or design.outcome)
    return frame, {r["drop_reason"]: r["n"] for r in counts.collect() if r["drop_reason"]}  # a row for each reason


def flags_of(frame: DataFrame, design: Design) -> tuple[dict[str, Column], list[str], dict[str, list[str]]]:
    """Flag columns, terms that vary, and each factor's levels. A term without variation is no term."""
    once = [F.collect_set(F.col(c).cast("string")).alias(c) for c in design.factors]  # a few levels each
    plain = [F.struct(F.min(t).alias("lo"), F.max(t).alias("hi")).alias(f"t_{t}") for t in design.terms]
    seen = frame.agg(*once, *plain).first()
    terms = [t for t in design.terms if seen[f"t_{t}"]["lo"] != seen[f"t_{t}"]["hi"]]
    levels = {c: sorted(seen[c]) for c in design.factors}
    flags = _flags(design, levels)
    return flags, [*terms, *flags], levels


def _flags(design: Design, levels: dict[str, list[str]]) -> dict[str, Column]:
    flags: dict[str, Column] = {}
    own: dict[str, list[tuple[str, Column]]] = {}
    for c, reference in design.factors.items():
        others = [x for x in levels[c] if x != (reference if reference in levels[c] else levels[c][0])] if levels[c] else []
        own[c] = [(f"{c}[{x}]", (F.col(c) == x).cast("int")) for x in others]
        flags |= dict(own[c])
    if design.interact:
        a, b = design.interact
        flags |= {f"{x}:{y}": u * v for x, u in own[a] for y, v in own[b]}
    return flags


@dataclass
class Survey:
    """What one pass over a design's rows says: rows dropped by reason, rows left, terms that vary, those of them that are 0 or 1, each
    factor's levels, and the conditions that each level covers."""

    dropped: dict[str, int]
    n: int
    terms: list[str]
    marks: list[str]
    levels: dict[str, list[str]]
    coverage: dict[str, dict[str | None, int]]

    def thin(self, factor: str, least: float) -> list[str]:
        """Levels that cover less than a share of what the fullest level covers."""
        most = max(self.coverage[factor].values())
        return [f"{factor} {level} covers {n} of {most} conditions" for level, n in self.coverage[factor].items() if n < least * most]


def surveyed(rows: DataFrame, design: Design, outcome: str) -> tuple[DataFrame, Survey]:
    """The design's frame and its survey: a row for each reason, condition and combination of levels comes to the driver."""
    own = design.rows(rows)
    if not design.needs_wer:
        own = own.withColumn("wer", F.coalesce("wer", F.lit(0.0)))
    s20, s10 = snr_dummies(F.col("snr_db"))
    marked = own.withColumn("drop_reason", frame_reason(outcome)).withColumns({"wer": cap_wer(), "snr_20": s20, "snr_10": s10})
    kinds = {f.name: f.dataType.simpleString() for f in marked.schema}
    keys = ["drop_reason", *(F.col(c).cast("string").alias(f"l_{c}") for c in design.factors), F.col("degradation").alias("at"), F.col("snr_db").alias("at_db")]
    ends = [f(t).alias(f"{n}_{t}") for t in design.terms for n, f in (("lo", F.min), ("hi", F.max))]
    seen = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ends).collect()
    dropped: dict[str, int] = {}
    for r in seen:
        if r["drop_reason"]:
            dropped[r["drop_reason"]] = dropped.get(r["drop_reason"], 0) + r["n"]
    left = [r for r in seen if not r["drop_reason"]]
    ends = {t: [f((r[f"{n}_{t}"] for r in left if r[f"{n}_{t}"] is not None), default=None) for n, f in (("lo", min), ("hi", max))] for t in design.terms}
    terms = [t for t in design.terms if ends[t][0] != ends[t][1]]
    marks = [t for t in terms if kinds[t] in ("int", "boolean") and int(ends[t][0]) >= 0 and int(ends[t][1]) <= 1]
    levels = {c: sorted({r[f"l_{c}"] for r in left} - {None}) for c in design.factors}
    met = {c: {(r[f"l_{c}"], r["at"], r["at_db"]) for r in left} for c in design.factors}
    coverage = {c: {x: sum(y == x for y, *_ in met[c]) for x in sorted({y for y, *_ in met[c]}, key=lambda v: (v is not None, v))} for c in design.factors}
    return marked.where("drop_reason is null").drop("drop_reason"), Survey(dropped, sum(r["n"] for r in left), terms, marks, levels, coverage)


def run_model(rows: DataFrame, name: str, design: Design, outcome: str | None = None, least_coverage: float = 0.5, cluster: str = "slurp_id") -> Outcome:
    """Fit one design. Nothing is fitted without rows, without variation in what the hypothesis is about, or where a level of a
    required factor covers less than a share of the conditions of the fullest; other thin levels are warnings. Rows are read twice: for
    their survey, and for the fit, which holds them packed."""
    out = Outcome(name)
    try:
        frame, seen = surveyed(rows, design, outcome or design.outcome)
        out.dropped = seen.dropped
        if not seen.n:
            raise gee.Refused("no rows are left")
        flags = _flags(design, seen.levels)
        terms = [*seen.terms, *flags]
        still = [r for r in design.required if r not in terms and len(seen.levels.get(r, [])) < 2]
        if still:
            raise gee.Refused(f"no variation in {', '.join(still)}")
        for c in design.factors:
            if c == "degradation":
                continue
            for text in seen.thin(c, least_coverage):
                if c in design.required:
                    raise gee.Refused(text)
                out.warnings.append(text)
        short = {t: f"f{i}" for i, t in enumerate(flags)}
        held = frame.withColumns({short[t]: c for t, c in flags.items()})
        fit = gee.fit(held, outcome or design.outcome, [short.get(t, t) for t in terms], cluster, flags=[*seen.marks, *short.values()])
        fit.terms = ["intercept", *terms]
        out.table, out.n = fit.table(), fit.n
        if design.contrast:
            out.contrast = fit.contrast(*design.contrast)
        crossed = [t for t in terms if ":" in t]
        if crossed:
            out.joint = fit.joint(crossed)
    except gee.Refused as e:
        out.refused = str(e)
    return out


def run_models(rows: DataFrame, asr: str, large_routers: list[str], names: list[str] | None = None, **options) -> list[Outcome]:
    """Fit each design by name; one that is refused stops no other."""
    known = designs(asr, large_routers)
    return [run_model(rows, n, known[n], **options) for n in names or list(known)]
