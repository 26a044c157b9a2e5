"""Calibration curves and cluster bootstraps as distributed sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from uttermark.keys import CURVE, HIGH_WER, cap_wer, is_clean

#: cells and their numbers in a batch's rows, the batch, and the rows' numbers of utterances -> weights of the utterances by replicate and the
#: first replicate -> a sum for each cell by replicate
More = Callable[[list[tuple], np.ndarray, pa.RecordBatch, np.ndarray], Callable[[np.ndarray, int], np.ndarray]]
CURVES = "asr string, llm string, a double, b double, n_clean long, n_clean_at_high_wer long, p_at_zero double, refused string"


def logistic(x: np.ndarray, n: np.ndarray, k: np.ndarray, steps: int = 100, tol: float = 1e-10) -> tuple[float, float] | None:
    """Maximum-likelihood a, b of P = sigmoid(a + b x) from k successes of n at each x; None if not identified."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(design @ beta / 2))
        h = (design * (n * p * (1 - p))[:, None]).T @ design
        if not np.isfinite(h).all() or abs(np.linalg.det(h)) < 1e-12:
            return None
        step = np.linalg.solve(h, design.T @ (k - n * p))
        beta = beta + step
        if not np.isfinite(beta).all():
            return None
        if np.abs(step).max() < tol:
            return float(beta[0]), float(beta[1])
    return None


def _curve(pdf: pd.DataFrame) -> pd.DataFrame:
    x, n, k = (pdf[c].to_numpy(float) for c in ("x", "n", "k"))
    total, high, hits = int(n.sum()), int(n[x >= HIGH_WER].sum()), k.sum()
    one, zero = x[k > 0], x[n - k > 0]
    reason, fit = None, None
    if total < 2:
        reason = f"only {total} clean row(s)"
    elif hits in (0, total):
        reason = "the clean outcome does not vary"
    elif x.max() - x.min() < 1e-12:
        reason = "the clean error rate does not vary"
    elif zero.max() < one.min() or one.max() < zero.min():
        reason = "the clean outcome separates perfectly on the error rate"
    else:
        fit = logistic(x, n, k)
        reason = None if fit else "the fit did not converge"
    a, b = fit or (None, None)
    row = [pdf["asr"].iloc[0], pdf["llm"].iloc[0], a, b, total, high, None if a is None else 1 / (1 + np.exp(-a)), reason]
    return pd.DataFrame([row], columns=["asr", "llm", "a", "b", "n_clean", "n_clean_at_high_wer", "p_at_zero", "refused"])


def clean_calibration(rows: DataFrame, outcome: str = "ees") -> DataFrame:
    """A logistic curve of the outcome on the capped error rate per recogniser and router, from clean rows.

    Rows are first collapsed to distinct error rates with counts, so a group holds a row for each rate.
    """
    clean = rows.where(is_clean() & F.col("wer").isNotNull() & F.col(outcome).isNotNull())
    histogram = clean.groupBy(*CURVE, cap_wer().alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("double")).alias("k"))
    return histogram.groupBy(*CURVE).applyInPandas(_curve, CURVES)


_LIMITS = np.cumsum([np.exp(-1) / np.prod(range(1, i + 1)) for i in range(12)])
_BINS = np.searchsorted(_LIMITS, np.arange(1 << 12) / (1 << 12))  #: weight at the lower end of each of 4096 equal parts of 0 to 1
_BINS = np.where(_BINS == np.searchsorted(_LIMITS, np.arange(1, (1 << 12) + 1) / (1 << 12)), _BINS, -1)  #: -1: not all of the part has it


def poisson_weights(ids: np.ndarray, replicates: int, seed: int, first: int = 0) -> np.ndarray:
    """Poisson(1) weights (id x replicate, from the replicate ``first`` on) from a hash of seed, replicate and id: the same in every
    partition. Mostly the leading bits of the hash say which."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(first + 1, first + replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    x += np.uint64(seed)
    shifted = np.empty_like(x)
    with np.errstate(over="ignore"):
        for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(x, np.uint64(shift), out=shifted)
            x ^= shifted
            x *= np.uint64(m)
    np.right_shift(x, np.uint64(31), out=shifted)
    x ^= shifted
    np.right_shift(x, np.uint64(52), out=shifted)
    found = _BINS[shifted.view(np.int64)]
    open_ = np.nonzero(found < 0)
    found[open_] = np.searchsorted(_LIMITS, x[open_] / 2.0**64)
    return found


REPLICATE_BLOCK = 250  #: replicates of one row of sums
HELD_BYTES = 1 << 28  #: sums that a task holds before it hands them on; those of 209 cells, 22 values and 2,000 replicates take 74 MB
DENSE = 64  #: sums by cell and cluster are made first where they are at most so many times a batch's rows
TOGETHER = 100_000  #: rows whose sums are made at once
GROUPS = 1024  #: rates of cells whose rows are counted at once
FAN = 64  #: rows of one key that meet in the first level of adding are at most a FANth of the tasks


def _together(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``least`` rows; empty ones are left out."""
    held: list[pa.RecordBatch] = []
    for rb in batches:
        if rb.num_rows:
            held.append(rb)
        if sum(x.num_rows for x in held) >= max(least, 1):
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _cut(rb: pa.RecordBatch, cluster: str) -> list[pa.RecordBatch]:
    """The batch, cut into smaller ones where it has so many clusters that their weights would take much memory."""
    most = 10_000
    return [rb] if rb.num_rows <= most or pc.count_distinct(rb.column(cluster)).as_py() <= most // 4 else [rb.slice(s, most) for s in range(0, rb.num_rows, most)]


def _codes(rb: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its values of ``columns``, and for each number its first row."""
    code = np.zeros(rb.num_rows, np.int64)
    for c in columns:
        own = rb.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)
    _, first = np.unique(code, return_index=True)
    return code, first


def replicate_parts(rows: DataFrame, cell: list[str], values: list[str], replicates: int, seed: int, cluster: str = "slurp_id", more: dict[str, More] | None = None) -> DataFrame:
    """Weighted sums of ``values`` by cell from each task: ``cell``, ``block`` (of replicates), ``value`` (its name) and ``sums``, an array
    over the block's replicates. ``more``: further sums by name, from the cells, the rows of a batch and then the utterances' weights."""
    schema = T.StructType([*(rows.schema[c] for c in cell), *T._parse_datatype_string("block int, value string, sums array<double>").fields])
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in cell]
    starts = range(0, replicates, REPLICATE_BLOCK)
    names = [*values, *(more or {})]

    def handed_on(keys: list[tuple], total: np.ndarray) -> pa.RecordBatch:
        every = [(*key, i // len(names), names[i % len(names)]) for key in keys for i in range(len(starts) * len(names))]
        cols = [pa.array([k[j] for k in every], kind) for j, kind in enumerate([*kinds, pa.int32(), pa.string()])]
        sums = [part[v, s : s + REPLICATE_BLOCK] for part in total[: len(keys)] for s in starts for v in range(len(names))]
        ends = np.cumsum([0, *map(len, sums)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sums)))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[tuple, int] = {}  # the place in ``total`` of every cell
        total = np.zeros((0, len(names), replicates))
        for rb in (part for whole in _together(batches, TOGETHER) for part in _cut(whole, cluster)):
            code, first = _codes(rb, cell)
            ids, of = np.unique(rb.column(cluster).to_numpy(zero_copy_only=False), return_inverse=True)
            # rows of one cluster stand together, so that cells x clusters are mostly few: their sums first, then one product with the weights
            dense = len(first) * len(ids) <= DENSE * len(code)
            keys = [tuple(None if x != x else x for x in key) for key in zip(*(rb.column(c).take(pa.array(first)).to_pylist() for c in cell), strict=True)]
            place = np.array([slots.setdefault(key, len(slots)) for key in keys])
            if len(set(keys)) < len(keys):  # values that differ in their bits only
                place, code = np.unique(place[code], return_inverse=True)
                keys = [list(slots)[i] for i in place]
            if len(slots) > len(total):
                total = np.concatenate([total, np.zeros((max(len(slots) * 3 // 2 - len(total), 1), len(names), replicates))])
            v = np.stack([pc.fill_null(rb.column(c).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in values], 1)
            if dense:
                at = code * len(ids) + of
                each = np.concatenate([np.bincount(at, v[:, i], len(keys) * len(ids)).reshape(len(keys), -1) for i in range(len(values))])
            else:
                order = np.argsort(code, kind="stable")
                ends = np.searchsorted(code[order], np.arange(len(keys) + 1))
                sorted_of, sorted_v = of[order], v[order]
            made = [f(keys, code, rb, of) for f in (more or {}).values()]
            for s in starts:
                e = min(s + REPLICATE_BLOCK, replicates)
                drawn = poisson_weights(ids, e - s, seed, s).astype(float)
                if dense:
                    total[place, : len(values), s:e] += (each @ drawn).reshape(len(values), len(keys), -1).transpose(1, 0, 2)
                else:
                    weight = drawn[sorted_of]
                    for i in range(len(values)):
                        total[place, i, s:e] += np.add.reduceat(sorted_v[:, [i]] * weight, ends[:-1])
                for j, f in enumerate(made, len(values)):
                    total[place, j, s:e] += f(drawn, s)
            if len(slots) * total[:1].nbytes > HELD_BYTES:
                yield handed_on(list(slots), total)
                slots, total = {}, total[:0]
        if slots:
            yield handed_on(list(slots), total)

    return rows.mapInArrow(run, schema)


def added(parts: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """One row for each of ``keys`` with the sum of ``sums``, arrays of one length for a key. Rows of a key are added in two levels, first
    those of every ``fan``-th task together; each level is a stream of sorted rows with one open key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: tuple | None = None  # the open key as a batch of one row, its values, and its sum

        def closed(done: list[tuple]) -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x[2]) for x in done)]).astype(np.int32)
            cols = pa.Table.from_batches([x[0] for x in done]).combine_chunks().to_batches()[0].columns
            return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[2] for x in done])))], names=names)

        for rb in batches:
            if not rb.num_rows:
                continue
            names = [*keys, "sums"]
            own, lists = rb.select(keys), rb.column("sums")
            offset, flat = np.asarray(lists.offsets), lists.values.to_numpy()
            new = np.zeros(rb.num_rows, bool)
            new[0] = True
            for c in own.columns:
                code = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(new)
            done: list[tuple] = []
            for s, e in zip(first.tolist(), [*first[1:].tolist(), rb.num_rows], strict=True):
                total = flat[offset[s] : offset[e]].reshape(e - s, -1).sum(0)
                row = own.slice(s, 1)
                key = tuple(row.to_pylist()[0].values())
                if held and held[1] == key:
                    held = (held[0], key, held[2] + total)
                    continue
                if held:
                    done.append(held)
                held = (row, key, total)
            if done:
                yield closed(done)
        if held:
            yield closed([held])

    out = T.StructType([*(parts.schema[k] for k in keys), parts.schema["sums"]])
    level = lambda df, by: df.repartition(*by).sortWithinPartitions(*keys).select(*keys, "sums").mapInArrow(run, out)
    some = level(parts.select(*keys, "sums", (F.spark_partition_id() % fan).alias("__task")), [*keys, "__task"])
    return level(some, keys)


def replicate_sums(rows: DataFrame, cell: list[str], values: list[str], replicates: int, seed: int = 42, cluster: str = "slurp_id") -> DataFrame:
    """Weighted sums of ``values`` for every cell and replicate; clusters (utterances) are drawn, so all rows of one
    carry the same weight everywhere. Tasks give arrays over blocks of replicates, which are added up by cell and block."""
    sums = added(replicate_parts(rows, cell, values, replicates, seed, cluster), [*cell, "block", "value"])
    own = sums.groupBy(*cell, "block").agg(*(F.first(F.when(F.col("value") == v, F.col("sums")), ignorenulls=True).alias(f"__{i}") for i, v in enumerate(values)))
    each = own.select(*cell, "block", F.posexplode(F.arrays_zip(*(F.col(f"__{i}") for i in range(len(values))))).alias("at", "v"))
    replicate = (F.col("block") * REPLICATE_BLOCK + F.col("at")).cast("int").alias("replicate")
    return each.select(*cell, replicate, *(F.col("v")[f"__{i}"].alias(v) for i, v in enumerate(values)))


def interval(sums: DataFrame, cell: list[str], value, name: str = "") -> DataFrame:
    """Median and 2.5 and 97.5 percent points over replicates of an expression of the sums."""
    at = lambda p: F.percentile(value, p)
    return sums.groupBy(*cell).agg(at(0.025).alias(f"{name}lo"), at(0.5).alias(f"{name}median"), at(0.975).alias(f"{name}hi"))


CELL_VALUES = [
    "rated", "rated_w", "scored", "scored_y", "err", "err_y", "err_w", "perfect", "perfect_y", "paired", "paired_y", "paired_w",
    "critical", "critical_y", "critical_w", "function", "function_y", "function_w", "degraded", "degraded_y",
]
METRICS = [
    "outcome", "absorption", "retention", "gain_paired", "gain_ceiling", "gain_legacy", "gain_calibrated", "gain_critical", "gain_function",
    "gain_critical_minus_function", "calibration_a", "calibration_b",
]


def logistic_many(x: np.ndarray, n: np.ndarray, k: np.ndarray, steps: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """``logistic`` for many replicates at once: ``n`` and ``k`` are (distinct x, replicate). NaN where a replicate is refused: under
    two rows, a constant outcome or rate, perfect separation, or no convergence."""
    b = n.shape[1]
    beta, done = np.zeros((2, b)), np.zeros(b, bool)
    total, hits = n.sum(0), k.sum(0)
    at = np.where(n > 0, x[:, None], np.nan)
    one, zero = np.where(k > 0, x[:, None], np.nan), np.where(n - k > 0, x[:, None], np.nan)
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            flat = np.nanmax(at, 0) - np.nanmin(at, 0) < 1e-12
            apart = (np.nanmax(zero, 0) < np.nanmin(one, 0)) | (np.nanmax(one, 0) < np.nanmin(zero, 0))
        bad = (total < 2) | (hits <= 0) | (hits >= total) | flat | apart
        for _ in range(steps):
            p = 0.5 * (1 + np.tanh((beta[0] + beta[1] * x[:, None]) / 2))
            w, r = n * p * (1 - p), k - n * p
            h00, h01, h11 = w.sum(0), (w * x[:, None]).sum(0), (w * x[:, None] ** 2).sum(0)
            g0, g1, det = r.sum(0), (r * x[:, None]).sum(0), h00 * h11 - h01**2
            bad |= ~done & ~(np.abs(det) >= 1e-12)
            step = np.stack([h11 * g0 - h01 * g1, h00 * g1 - h01 * g0]) / np.where(det == 0, 1, det)
            step[:, done | bad] = 0
            beta += step
            bad |= ~np.isfinite(beta).all(0)
            done |= np.abs(step).max(0) < tol
            if (done | bad).all():
                break
    return np.where(bad | ~done, np.nan, beta[0]), np.where(bad | ~done, np.nan, beta[1])


def replicate_curves(rows: DataFrame, outcome: str, replicates: int, seed: int) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """Clean curves (a, b by replicate) of every recogniser and router. One row for each pair of models comes to the driver."""
    clean = rows.where(is_clean() & F.col("wer").isNotNull() & F.col(outcome).isNotNull())
    clean = clean.select("slurp_id", *CURVE, cap_wer().alias("x"), F.lit(1.0).alias("n"), F.col(outcome).cast("double").alias("k"))
    sums = added(replicate_parts(clean, [*CURVE, "x"], ["n", "k"], replicates, seed), [*CURVE, "x", "block", "value"])

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["x"].unique())
        of = {v: np.zeros((len(x), replicates)) for v in ("n", "k")}
        for r in pdf.itertuples(index=False):
            first = r.block * REPLICATE_BLOCK
            of[r.value][np.searchsorted(x, r.x), first : first + len(r.sums)] = r.sums
        a, b = logistic_many(x, of["n"], of["k"])
        return pd.DataFrame({"asr": [pdf["asr"].iloc[0]], "llm": [pdf["llm"].iloc[0]], "a": [a], "b": [b]})

    found = sums.groupBy(*CURVE).applyInPandas(fitted, "asr string, llm string, a array<double>, b array<double>").collect()
    return {(r["asr"], r["llm"]): (np.array(r["a"], float), np.array(r["b"], float)) for r in found}


def bootstrap_cells(rows: DataFrame, outcome: str = "ees", replicates: int = 2000, seed: int = 42, least: int = 10, order: list[str] | None = None) -> DataFrame:
    """Median and 2.5 and 97.5 percent points of every metric of every cell with ``least`` rows or more.

    Utterances are drawn; all sums of a replicate use the same draw, and so do the clean curves, which are
    fitted anew in each. Where ``has_critical_error`` and ``has_function_error`` are columns, the paired gains of rows with
    a critical error and of rows with other errors only, and their difference, are among the metrics. A metric that no
    replicate has is null.
    """
    from uttermark.operators.pairs import together_with_anchor

    curves = replicate_curves(rows, outcome, replicates, seed)
    flags = {"has_critical_error", "has_function_error"} <= set(rows.columns)
    w, y = F.coalesce(cap_wer(), F.lit(0.0)), F.coalesce(F.col(outcome).cast("double"), F.lit(0.0))
    rated = F.col("wer").isNotNull()
    scored = rated & F.col(outcome).isNotNull()
    err, perfect, degraded = scored & (F.col("wer") > 0), scored & (F.col("wer") == 0), scored & ~is_clean()
    paired = degraded & (F.col("wer") > 0) & F.coalesce(F.col("clean_outcome") == 1, F.lit(False))
    critical = paired & (F.col("has_critical_error") == 1) if flags else F.lit(False)
    function = paired & (F.col("has_critical_error") == 0) & (F.col("has_function_error") == 1) if flags else F.lit(False)
    marks = {"rated": rated, "scored": scored, "err": err, "perfect": perfect, "paired": paired, "critical": critical, "function": function, "degraded": degraded}
    values = {}
    for name in CELL_VALUES:
        base, _, of = name.partition("_")
        v = marks[base].cast("double")
        values[name] = v * {"": F.lit(1.0), "w": w, "y": y}[of]
    cell = ["asr", "degradation", "snr_db", "llm"]
    flagged = ["has_critical_error", "has_function_error"] if flags else []
    d = together_with_anchor(rows, [*cell, "wer", outcome, *flagged], outcome, order)
    d = d.select("slurp_id", *cell, w.alias("w"), *(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in values.items()))
    # every task gives sums of all cells, so there are no more tasks than run at once
    d = d.coalesce(max(d.sparkSession.sparkContext.defaultParallelism, 8))
    sums = added(_cell_parts(d, curves, replicates, seed), [*cell, "block", "value"])

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        t = {v: np.concatenate(part.sort_values("block")["sums"].tolist()) for v, part in pdf.groupby("value")}
        if t["n"][0] < least:
            return pd.DataFrame(columns=[*cell, "metric", "lo", "median", "hi"])
        got = _cell_metrics(t, curves.get((one["asr"], one["llm"])))
        out = []
        for m in METRICS:
            known = got[m][np.isfinite(got[m])]
            points = np.percentile(known, [2.5, 50, 97.5]) if len(known) else [None] * 3
            out.append([*(one[c] for c in cell), m, *points])
        return pd.DataFrame(out, columns=[*cell, "metric", "lo", "median", "hi"])

    return sums.groupBy(*cell).applyInPandas(summary, "asr string, degradation string, snr_db int, llm string, metric string, lo double, median double, hi double")


def _cell_metrics(t: dict[str, np.ndarray], curve: tuple[np.ndarray, np.ndarray] | None) -> dict[str, np.ndarray]:
    nothing = np.full(len(t["rated"]), np.nan)
    with np.errstate(all="ignore"):
        mean = lambda a, of: np.where(t[a] > 0, t[f"{a}_{of}"] / t[a], np.nan)
        gain = lambda a: mean(a, "y") - (1 - mean(a, "w"))
        ceiling = mean("perfect", "y")
        out = {
            "outcome": mean("scored", "y"), "absorption": mean("err", "y"), "retention": mean("paired", "y"), "gain_paired": gain("paired"),
            "gain_ceiling": mean("err", "y") - ceiling * (1 - mean("err", "w")), "gain_legacy": mean("err", "y") - (1 - mean("rated", "w")),
            "gain_calibrated": np.where(t["degraded"] > 0, (t["degraded_y"] - t["predicted"]) / t["degraded"], np.nan),
            "gain_critical": gain("critical"), "gain_function": gain("function"),
        }
    out["gain_critical_minus_function"] = out["gain_critical"] - out["gain_function"]
    out["calibration_a"], out["calibration_b"] = curve if curve else (nothing, nothing)
    return out


def _cell_parts(rows: DataFrame, curves: dict, replicates: int, seed: int) -> DataFrame:
    """Sums of ``CELL_VALUES`` by cell and replicate, of what the replicate's curve predicts for degraded rows, and the number of rows."""
    unknown = np.full(replicates, np.nan)

    def predicted(keys: list[tuple], code: np.ndarray, rb: pa.RecordBatch, of: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
        """Degraded rows are counted by cell, rate and utterance; whole numbers of that size are exact in single precision."""
        some = np.flatnonzero(rb.column("degraded").to_numpy())
        rates, rate = np.unique(rb.column("w").to_numpy()[some], return_inverse=True)
        group, number = np.unique(code[some] * max(len(rates), 1) + rate, return_inverse=True)
        cell, rate = group // max(len(rates), 1), group % max(len(rates), 1)
        ids = int(of.max()) + 1
        steps = range(0, len(group), GROUPS)
        order = np.argsort(number, kind="stable")
        cut = np.searchsorted(number[order], [*steps, len(group)])
        curve = [curves.get((key[0], key[3]), (unknown, unknown)) for key in keys]

        def add(weight: np.ndarray, first: int) -> np.ndarray:
            out, weight = np.zeros((len(keys), weight.shape[1])), weight.astype(np.float32)
            a, b = (np.stack([c[i][first : first + weight.shape[1]] for c in curve]) for i in (0, 1))
            for k, lo in enumerate(steps):
                at = order[cut[k] : cut[k + 1]]
                own = slice(lo, min(lo + GROUPS, len(group)))
                n = own.stop - lo
                hot = np.bincount((number[at] - lo) * ids + of[some[at]], minlength=n * ids).astype(np.float32).reshape(n, ids)
                with np.errstate(over="ignore"):
                    made = (hot @ weight) / (1 + np.exp(-(a[cell[own]] + b[cell[own]] * rates[rate[own], None])))
                first_of = np.flatnonzero(np.append(True, np.diff(cell[own]) > 0))
                out[cell[own][first_of]] += np.add.reduceat(made, first_of)
            return out

        return add

    def count(keys: list[tuple], code: np.ndarray, rb: pa.RecordBatch, of: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
        n = np.bincount(code, minlength=len(keys)).astype(float)[:, None]
        return lambda weight, first: np.repeat(n, weight.shape[1], 1)

    return replicate_parts(rows, ["asr", "degradation", "snr_db", "llm"], CELL_VALUES, replicates, seed, more={"predicted": predicted, "n": count})


EFFECT = ["acme", "ade", "total"]
MEDIATION = "acme double, ade double, total double, acme_se double, ade_se double, total_se double, n double, refused string"
Z95 = 1.959963984540054
_NODES, _WEIGHTS = np.polynomial.hermite_e.hermegauss(31)


def mediate(treated: np.ndarray, x: np.ndarray, n: np.ndarray, k: np.ndarray, groups: np.ndarray | None = None, errors: bool = False) -> tuple[float, ...] | str:
    """Effect of the treatment through the mediator x (ACME), past it (ADE), and both, or why there is none.

    The mediator is linear and the outcome (k of n successes) logistic in the treatment and in flags of ``groups`` (recogniser
    and router), the outcome also in the mediator. Outcomes are averaged over the rows' groups and the mediator's residual
    distribution, by Gauss-Hermite quadrature, so the result has no draws in it. With ``errors`` also the standard errors of the three,
    by the delta method: gradients of the effects over the covariances of both fits, which are independent of each other.
    """
    if min(n[treated == 1].sum(), n[treated == 0].sum()) == 0:
        return "one arm is empty"
    if k.sum() <= 0 or k.sum() >= n.sum():
        return "the outcome does not vary"
    if x[n > 0].max() - x[n > 0].min() < 1e-12:
        return "the mediator does not vary"
    flags = np.zeros((len(x), 0)) if groups is None else groups[:, [j for j in range(groups.shape[1]) if 0 < (n * groups[:, j]).sum() < n.sum()]]
    base = np.concatenate([np.ones((len(x), 1)), treated[:, None], flags], 1)
    gram = (base * n[:, None]).T @ base
    if np.linalg.matrix_rank(gram) < base.shape[1]:
        return "the groups and the arms are confounded"
    mean = np.linalg.solve(gram, (base * n[:, None]).T @ x)
    spread = np.sqrt((n * (x - base @ mean) ** 2).sum() / max(n.sum() - base.shape[1], 1))
    d, beta = np.concatenate([base, x[:, None]], 1), np.zeros(base.shape[1] + 1)
    for _ in range(100):
        p = 0.5 * (1 + np.tanh(d @ beta / 2))
        h = (d * (n * p * (1 - p))[:, None]).T @ d
        if not np.isfinite(h).all() or abs(np.linalg.det(h)) < 1e-12 or np.abs(beta).max() > 50:
            return "the outcome model is not identified"
        step = np.linalg.solve(h, d.T @ (k - n * p))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    else:
        return "the outcome model did not converge"
    kinds, of = np.unique(flags, axis=0, return_inverse=True) if flags.shape[1] else (np.zeros((1, 0)), np.zeros(len(x), int))
    share = np.bincount(of.ravel(), weights=n, minlength=len(kinds)) / n.sum()

    def effects(mean: np.ndarray, beta: np.ndarray, spread: float) -> np.ndarray:
        rate = lambda m: mean[0] + mean[1] * m + kinds @ mean[2:]

        def outcome(t: int, m: int) -> float:
            z = (beta[0] + beta[1] * t + kinds @ beta[2:-1])[:, None] + beta[-1] * (rate(m)[:, None] + spread * _NODES)
            return float(share @ (0.5 * (1 + np.tanh(z / 2)) @ _WEIGHTS) / _WEIGHTS.sum())

        acme = (outcome(1, 1) - outcome(1, 0) + outcome(0, 1) - outcome(0, 0)) / 2
        ade = (outcome(1, 1) - outcome(0, 1) + outcome(1, 0) - outcome(0, 0)) / 2
        return np.array([acme, ade, acme + ade])

    found = effects(mean, beta, spread)
    if not errors:
        return tuple(found.tolist())
    cov = np.zeros((2 * len(mean) + 2,) * 2)
    own, other = slice(0, len(mean)), slice(len(mean), 2 * len(mean) + 1)
    cov[own, own], cov[other, other] = spread**2 * np.linalg.inv(gram), np.linalg.inv(h)
    cov[-1, -1] = spread**2 / (2 * max(n.sum() - base.shape[1], 1))
    at = np.concatenate([mean, beta, [spread]])
    slope = np.zeros((3, len(at)))
    for i, v in enumerate(at):
        step = 1e-5 * max(1.0, abs(v))
        ends = [at.copy(), at.copy()]
        ends[0][i] -= step
        ends[1][i] += step
        low, high = (effects(e[own], e[other], e[-1]) for e in ends)
        slope[:, i] = (high - low) / (2 * step)
    return (*found.tolist(), *np.sqrt(np.maximum(np.diag(slope @ cov @ slope.T), 0)).tolist())


def _groups(pdf: pd.DataFrame) -> np.ndarray:
    """Flags of all recognisers and routers but the first of each."""
    cols = [(pdf[c] == level).to_numpy(float) for c in CURVE if c in pdf for level in sorted(pdf[c].unique())[1:]]
    return np.stack(cols, 1) if cols else np.zeros((len(pdf), 0))


def _contrast(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = mediate(*(pdf[c].to_numpy(float) for c in ("treated", "x", "n", "k")), _groups(pdf), errors=True)
        row = [*(pdf[c].iloc[0] for c in keys), *((None,) * 6 if isinstance(got, str) else got), pdf["n"].sum(), got if isinstance(got, str) else None]
        return pd.DataFrame([row], columns=[*keys, *EFFECT, *(f"{c}_se" for c in EFFECT), "n", "refused"])

    return run


def _arms(sums: DataFrame, by: list[str]) -> DataFrame:
    """The clean arm beside every degraded arm (a few dozen); both are histograms of the mediator."""
    arm = sums.where(~is_clean())
    clean = sums.where(is_clean()).drop(*by).crossJoin(F.broadcast(arm.select(*by).distinct()))
    return arm.withColumn("treated", F.lit(1.0)).unionByName(clean.withColumn("treated", F.lit(0.0)).select(*arm.columns, "treated"))


def _known(rows: DataFrame, outcome: str, by: list[str]) -> DataFrame:
    known = rows.where(F.col("wer").isNotNull() & F.col(outcome).isNotNull())
    return known.select("slurp_id", *by, *CURVE, cap_wer().alias("x"), F.lit(1.0).alias("n"), F.col(outcome).cast("double").alias("k"))


def _by(by: list[str]) -> str:
    return ", ".join(f"{c} {'int' if c == 'snr_db' else 'string'}" for c in by)


def mediation_table(rows: DataFrame, outcome: str = "ees", by: list[str] | None = None, bands: DataFrame | None = None) -> DataFrame:
    """ACME, ADE and total of every degradation (or degradation and noise level: ``by``) against clean audio, with the error rate
    as mediator, over all routers, each with its standard error and 95 % interval from the fits (``..._fit_lo``, ``..._fit_hi``).

    ``share``, the part mediated, is shown where the total's interval excludes 0, and with ``bands`` (``mediation_bootstrap``) only where
    theirs does, too: the fits' interval has the uncertainty of the parameters, the other that of the draw of utterances.
    ``share_refused`` says why else.
    """
    by = by or ["degradation"]
    sums = _known(rows, outcome, by).groupBy(*by, *CURVE, "x").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    out = _arms(sums, by).groupBy(*by).applyInPandas(_contrast(by), f"{_by(by)}, {MEDIATION}")
    out = out.withColumns({f"{c}_fit_{side}": F.col(c) + z * F.col(f"{c}_se") for c in EFFECT for side, z in (("lo", -Z95), ("hi", Z95))})
    holds = lambda lo, hi: F.coalesce((F.col(lo) <= 0) & (F.col(hi) >= 0), F.lit(True))
    why = F.when(F.col("refused").isNotNull(), F.col("refused")).when(holds("total_fit_lo", "total_fit_hi"), "the fits' interval of the total effect covers 0")
    if bands is not None:
        other = bands.withColumnsRenamed({c: f"__{c}" for c in by})
        out = out.join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").drop(*(f"__{c}" for c in by))
        why = why.when(holds("total_lo", "total_hi"), "the bootstrap's interval of the total effect covers 0")
    return out.withColumns({"share": F.when(why.isNull(), F.col("acme") / F.col("total")), "share_refused": why})


EFFECTS = 25  #: replicates of an arm that are fitted in one group


def mediation_bootstrap(rows: DataFrame, outcome: str = "ees", replicates: int = 200, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Percent points of the effects over replicates that draw utterances, each with all of its rows; replicates
    that refuse are counted. Rows collapse to weighted histograms of exact rates before anything is fitted: a row for each arm,
    recogniser, router and rate, with arrays over the replicates, of which a group fits ``EFFECTS``."""
    by = by or ["degradation"]
    cell = [*by, *CURVE, "x"]
    sums = added(replicate_parts(_known(rows, outcome, by), cell, ["n", "k"], replicates, seed), [*cell, "block", "value"])
    own = sums.groupBy(*cell, "block").agg(*(F.first(F.when(F.col("value") == v, F.col("sums")), ignorenulls=True).alias(v) for v in ("n", "k")))
    part = F.explode(F.expr(f"sequence(0, cast(ceil(size(n) / {EFFECTS}) as int) - 1)"))
    cut = own.select(*cell, "block", "n", "k", part.alias("part"))
    cut = cut.select(*cell, "block", "part", *(F.slice(c, F.col("part") * EFFECTS + 1, F.lit(EFFECTS)).alias(c) for c in ("n", "k")))
    keys = [*by, "block", "part"]

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        treated, x, (n, k) = pdf["treated"].to_numpy(float), pdf["x"].to_numpy(float), (np.stack(pdf[c].tolist()) for c in ("n", "k"))
        out = []
        for i in range(n.shape[1]):
            seen = n[:, i] > 0
            got = mediate(treated[seen], x[seen], n[seen, i], k[seen, i], _groups(pdf[seen])) if seen.any() else "no rows are left"
            out.append([*(pdf[c].iloc[0] for c in by), *((None, None, None) if isinstance(got, str) else got), got if isinstance(got, str) else None])
        return pd.DataFrame(out, columns=[*by, "acme", "ade", "total", "refused"])

    each = _arms(cut, by).groupBy(*keys).applyInPandas(fitted, f"{_by(by)}, acme double, ade double, total double, refused string")
    points = [F.percentile(c, p).alias(f"{c}_{n}") for c in ("acme", "ade", "total") for n, p in (("lo", 0.025), ("median", 0.5), ("hi", 0.975))]
    return each.groupBy(*by).agg(*points, F.count("refused").alias("n_refused"), F.count(F.lit(1)).alias("n_replicates"))
