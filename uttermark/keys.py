"""Key columns of evaluation rows. ``snr_db`` is null on clean rows and ``asr_model`` on omni rows, so
joins on these keys are null-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["asr", "degradation", "snr_db", "llm"]
ITEM = ["slurp_id", "asr", "llm"]
CURVE = ["asr", "llm"]
CLIP = ["slurp_id", "degradation", "snr_db"]
RESUME = ["slurp_id", "degradation", "snr_db", "asr_model", "llm_model", "pathway"]
UNDERPOWERED = 30
HIGH_WER = 0.8


def short_name(c: Column | str) -> Column:
    """The part after the last slash."""
    return F.element_at(F.split(c, "/"), -1)


def cell_columns(rows: DataFrame) -> DataFrame:
    """Add ``asr`` and ``llm`` (base names, ``?`` where missing) and fill a missing degradation with clean."""
    unknown = F.lit("?")
    return rows.withColumns(
        {
            "asr": F.coalesce(short_name("asr_model"), unknown),
            "llm": F.coalesce(short_name("llm_model"), unknown),
            "degradation": F.coalesce("degradation", F.lit("clean")),
        }
    )


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of all keys."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def cap_wer(c: Column | str = "wer") -> Column:
    """Word error rate, at most 1; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.least(c, F.lit(1.0)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def is_clean() -> Column:
    return F.col("degradation") == "clean"
