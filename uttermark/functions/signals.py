"""Seeds and operations on sample arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_seed(base: int, *parts: Column) -> Column:
    """First four bytes of the SHA-256 of ``base|part|...`` as an unsigned number."""
    text = F.concat_ws("|", F.lit(str(base)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))


def peak_normalize(samples: Column, target: float = 0.95) -> Column:
    """Scale so that the largest magnitude is ``target``; silence stays."""
    p = peak(samples).cast("double")
    return F.when(p > 0, F.transform(samples, lambda x: x.cast("double") / p * target)).otherwise(F.transform(samples, lambda x: x.cast("double")))


def hard_clip(samples: Column, share: float) -> Column:
    """Clamp to plus and minus a share of the peak."""
    limit = peak(samples).cast("double") * share
    return F.transform(samples, lambda x: F.greatest(F.least(x.cast("double"), limit), -limit))


def add_noise(rows: DataFrame, samples: str, seed: str, snr_db: str) -> DataFrame:
    """Add seeded Gaussian noise, scaled to a signal-to-noise ratio, as ``noisy``."""
    return _mixed(rows, samples, snr_db, lambda n, s, _: np.random.default_rng(s).standard_normal(n), seed, None)


def mix_track(rows: DataFrame, samples: str, track: str, seed: str, snr_db: str) -> DataFrame:
    """Add a segment of a noise track (repeated where it is short, from a seeded place), as ``noisy``."""

    def segment(n: int, s: int, t: np.ndarray) -> np.ndarray:
        t = np.tile(t, -(-n // len(t)) + 1) if len(t) < 2 * n else t
        at = int(np.random.default_rng(s).integers(0, len(t) - n + 1))
        return t[at : at + n]

    return _mixed(rows, samples, snr_db, segment, seed, track)


def _mixed(rows: DataFrame, samples: str, snr_db: str, noise, seed: str, track: str | None) -> DataFrame:
    from pyspark.sql import types as T

    at = {c: rows.columns.index(c) for c in (samples, seed, snr_db)}
    track_at = rows.columns.index(track) if track else None
    schema = T.StructType([*rows.schema.fields, T.StructField("noisy", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(column: pa.Array, i: int) -> np.ndarray:
            values = column[i].values  # a view of the batch's flat buffer
            return np.zeros(0) if values is None else values.to_numpy(zero_copy_only=False).astype(float)

        for rb in batches:
            out = []
            seeds, levels = rb.column(at[seed]).to_pylist(), rb.column(at[snr_db]).to_pylist()
            for i in range(rb.num_rows):
                x = numbers(rb.column(at[samples]), i)
                t = numbers(rb.column(track_at), i) if track_at is not None else None
                if not len(x) or t is not None and not len(t):
                    out.append(x)
                    continue
                e = noise(len(x), int(seeds[i]), t)
                power, loud = float(np.mean(x**2)), float(np.mean(e**2))
                want = power / 10 ** (levels[i] / 10)
                out.append(x + e * np.sqrt(want / loud) if loud > 0 else x)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)
