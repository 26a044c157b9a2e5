"""Logistic regression with exchangeable correlation inside clusters, as sums over the rows.

With s = sqrt(mu (1 - mu)), z = s x, r = (y - mu) / s and c = rho / (1 + (m - 1) rho) for a cluster of m rows, the
inverse of the exchangeable correlation has a closed form, and a cluster adds

    (sum z r - c (sum z)(sum r)) / (1 - rho)        to the score and
    (sum z z' - c (sum z)(sum z)') / (1 - rho)      to the information.

So every step is one pass over rows that are partitioned by cluster and packed once; only sums of p x p numbers leave a
partition, and the p x p system is solved on the driver. Outcomes between 0 and 1 are allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.operators.models import _codes, _together


class Refused(ValueError):
    """A fit that would give a number without meaning."""


@dataclass
class Fit:
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray  #: robust
    rho: float
    n: int
    clusters: int
    steps: int

    def table(self) -> list[tuple[str, float, float, float, float]]:
        """Term, coefficient, standard error, z, two-sided p."""
        se = np.sqrt(np.diag(self.cov))
        return [(t, float(b), float(s), float(b / s), normal_tail(b / s)) for t, b, s in zip(self.terms, self.beta, se, strict=True)]

    def contrast(self, a: str, b: str) -> tuple[float, float, float]:
        """Difference of two coefficients, its standard error and p."""
        v = np.zeros(len(self.terms))
        v[self.terms.index(a)] += 1
        v[self.terms.index(b)] -= 1
        d, se = float(v @ self.beta), math.sqrt(float(v @ self.cov @ v))
        return d, se, normal_tail(d / se)

    def joint(self, terms: list[str]) -> tuple[float, int, float]:
        """Wald chi-square of a family of terms, its degrees of freedom and p."""
        at = [self.terms.index(t) for t in terms]
        b = self.beta[at]
        x = float(b @ np.linalg.solve(self.cov[np.ix_(at, at)], b))
        return x, len(at), chi2_tail(x, len(at))


def normal_tail(z: float) -> float:
    return math.erfc(abs(float(z)) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the series of the lower incomplete gamma function
    for small x and by a continued fraction for large."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-15:
                break
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


PACKED = 1 << 15  #: rows that are packed together
BITS = 62  #: flags in one number


def _words(flags: list[str]) -> list[list[str]]:
    return [flags[i : i + BITS] for i in range(0, len(flags), BITS)]


def packed(rows: DataFrame, terms: list[str], flags: list[str]) -> DataFrame:
    """Rows (``cluster``, ``y``, ``terms``) by cluster, sorted, in packs: the distinct rows of ``y`` and terms as ``patterns``, each row's
    pattern (``codes``), and the clusters with their numbers of rows (``ids``, ``sizes``). Terms that are 0 or 1 (``flags``) share numbers, so
    little is moved and held of rows that have many."""
    plain = [t for t in terms if t not in flags]
    words = _words(flags)
    bits = [reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(t) == 1, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(w))) for w in words]
    own = rows.select("cluster", "y", *(b.alias(f"b{i}") for i, b in enumerate(bits)), *(F.col(t).cast("double").alias(f"v{i}") for i, t in enumerate(plain)))
    own = own.repartition("cluster").sortWithinPartitions("cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in _together(batches, PACKED):
            code, first = _codes(rb, rb.schema.names[1:])
            some = rb.take(pa.array(first))
            # numbers of flags keep their bits among doubles
            patterns = np.stack([c.to_numpy().view(np.float64) for c in some.columns[1:]], 1)
            cluster = rb.column(0).to_numpy()
            start = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
            parts = (patterns, code.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32), cluster[start], np.diff(np.append(start, len(cluster))))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["patterns", "codes", "ids", "sizes"])

    return own.mapInArrow(run, "patterns binary, codes binary, ids binary, sizes binary")


def _design(patterns: np.ndarray, terms: list[str], words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Outcome and design rows, with the intercept, of the patterns of a pack."""
    y, bits = patterns[:, 0], np.ascontiguousarray(patterns[:, 1 : 1 + len(words)]).view(np.int64)
    place = {t: (i, j) for i, w in enumerate(words) for j, t in enumerate(w)}
    plain = iter(range(1 + len(words), patterns.shape[1]))
    cols = [((bits[:, place[t][0]] >> place[t][1]) & 1).astype(float) if t in place else patterns[:, next(plain)] for t in terms]
    return y, np.stack([np.ones(len(y)), *cols], 1)


def _sums(rows: DataFrame, terms: list[str], flags: list[str], beta: np.ndarray, rho: float) -> dict[str, np.ndarray]:
    """All sums of one step over ``packed`` rows. Each task takes its packs as a stream, with one pack and the sums of one open cluster in
    memory; what depends on the pattern alone is made once for each pattern of a pack."""
    p, words = len(beta), _words(flags)
    size = {"score": p, "info": p * p, "meat": p * p, "xx": p * p, "r2": 1, "rr": 1, "pairs": 1, "n": 1, "clusters": 1, "edge": 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {n: np.zeros((p, p) if n in ("info", "meat", "xx") else k) for n, k in size.items()}
        open_id, open_sums, met = None, np.zeros(3 + 2 * p), False

        def close(each: np.ndarray) -> None:
            """Add whole clusters: rows of count, sum of r, of r squared, of z and of z r."""
            m, sr, srr, sz, szr = each[:, 0], each[:, 1], each[:, 2], each[:, 3 : 3 + p], each[:, 3 + p :]
            c = rho / (1 + (m - 1) * rho)
            u = (szr - (c * sr)[:, None] * sz) / (1 - rho)
            out["score"] += u.sum(0)
            out["info"] -= ((sz * c[:, None]).T @ sz) / (1 - rho)
            out["meat"] += (u.T @ u)
            out["rr"] += ((sr * sr - srr) / 2).sum()
            out["pairs"] += (m * (m - 1) / 2).sum()
            out["clusters"] += len(each)

        for patterns, codes, ids, sizes in ((x.as_py() for x in pack) for rb in batches for pack in zip(*rb.columns, strict=True)):
            met = True
            cluster, sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
            n = int(sizes.sum())
            code = np.frombuffer(codes, np.uint16 if len(codes) == 2 * n else np.uint32).astype(np.int64)
            k = int(code.max()) + 1
            y, x = _design(np.frombuffer(patterns, np.float64).reshape(k, -1), terms, words)
            mu = 0.5 * (1 + np.tanh(x @ beta / 2))
            s = np.sqrt(np.maximum(mu * (1 - mu), 1e-300))
            z, r = x * s[:, None], (y - mu) / s
            row = np.concatenate([np.ones((k, 1)), r[:, None], (r * r)[:, None], z, z * r[:, None]], 1)
            each = np.add.reduceat(row[code], np.cumsum(sizes) - sizes)
            if open_id == cluster[0]:
                each[0] += open_sums
            elif open_id is not None:
                close(open_sums[None])
            close(each[:-1])
            open_id, open_sums = cluster[-1], each[-1]
            of = np.bincount(code, minlength=k).astype(float)
            out["info"] += ((z * of[:, None]).T @ z) / (1 - rho)
            out["xx"] += ((x * of[:, None]).T @ x)
            out["r2"] += (of * r * r).sum()
            out["n"] += n
            out["edge"] += float(of[np.minimum(mu, 1 - mu) < 1e-10].sum())
        if met:
            close(open_sums[None])
            flat = np.concatenate([np.ravel(out[n]) for n in size]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    found = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(sum(size.values()))
    for row in found:
        flat[row["i"]] = row["v"]
    ends = np.cumsum(list(size.values()))
    return {n: flat[e - k : e].reshape((p, p) if n in ("info", "meat", "xx") else k) for (n, k), e in zip(size.items(), ends, strict=True)}


def rank_report(xx: np.ndarray) -> tuple[int, int, float]:
    """Rank, columns and smallest singular value of a design, from the sums of its products."""
    singular = np.sqrt(np.maximum(np.linalg.eigvalsh(xx), 0))
    return int((singular > singular.max() * len(xx) * 1e-12**0.5).sum()), len(xx), float(singular.min())


def fit(frame: DataFrame, outcome: str, terms: list[str], cluster: str = "slurp_id", most: int = 60, tol: float = 1e-8, flags: list[str] | None = None) -> Fit:
    """Fit an intercept and ``terms`` (numeric columns). Raises ``Refused`` for a rank-deficient design, separated
    outcomes, no convergence or standard errors that are not finite. Rows with a null are left out. ``flags``: terms that are 0 or 1."""
    names = ["intercept", *terms]
    p = len(names)
    flags = [t for t in terms if t in (flags or [])]
    rows = frame.select(F.col(cluster).cast("long").alias("cluster"), F.col(outcome).cast("double").alias("y"), *terms)
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in rows.columns)))
    rows = packed(rows, terms, flags).persist(StorageLevel.DISK_ONLY)
    try:
        beta, rho = np.zeros(p), 0.0
        for step in range(1, most + 1):
            s = _sums(rows, terms, flags, beta, rho)
            if s["n"][0] <= p:
                raise Refused("too few rows")
            if step == 1 and rank_report(s["xx"])[0] < p:
                raise Refused(f"the design has rank {rank_report(s['xx'])[0]} of {p}")
            move = np.linalg.solve(s["info"], s["score"])
            if not np.isfinite(move).all() or np.abs(beta).max() > 30:
                raise Refused("the outcome is separated")
            done = step > 2 and np.abs(move).max() < tol
            if done:
                break
            beta = beta + move
            scale = s["r2"][0] / (s["n"][0] - p)
            if step > 1 and s["pairs"][0] > p:
                rho = float(np.clip(s["rr"][0] / ((s["pairs"][0] - p) * scale), -0.5, 0.95))
        else:
            raise Refused("the fit did not converge")
        bread = np.linalg.inv(s["info"])
        cov = bread @ s["meat"] @ bread
        if not np.isfinite(cov).all() or (np.diag(cov) <= 0).any():
            raise Refused("standard errors are not finite")
        return Fit(names, beta, cov, rho, int(s["n"][0]), int(s["clusters"][0]), step)
    finally:
        rows.unpersist()
