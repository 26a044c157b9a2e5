"""Language identification by nearest centroids of normalised TF-IDF byte trigrams.

Texts are lower-cased (A-Z), everything in ASCII but letters becomes a space, and hashed trigrams of
the UTF-8 bytes are counted. Square-rooted counts times inverse document frequencies, scaled to
length one, are compared by cosine with several centroids per language, found by spherical k-means
on a bounded sample. A text whose best cosine is below what nearly all members of that centroid
reach is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm import text as X

DIMS = 1 << 12
SAMPLE_ROWS = 4000  #: most rows that a fit sees, but for one of each language
PER_LANGUAGE = 3
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Centroids:
    idf: np.ndarray
    centre: np.ndarray  #: one column for each centroid
    lang: list[str]
    floor: np.ndarray  #: least cosine accepted by each centroid


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams (row x DIMS)."""
    rows = len(off) - 1
    b = _FOLD[buf].astype(np.uint32)
    if len(b) < 3:
        return np.zeros((rows, DIMS), np.float32)
    tri = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    h = (tri * np.uint32(2654435761)) >> np.uint32(32 - 12)
    row = np.repeat(np.arange(rows), np.diff(off))
    inside = row[:-2] == row[2:]
    key = row[:-2][inside] * DIMS + h[inside]
    return np.bincount(key, minlength=rows * DIMS).reshape(rows, DIMS).astype(np.float32)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(c) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _kmeans(v: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, len(v))
    centre = v[rng.choice(len(v), k, replace=False)]
    for _ in range(steps):
        near = (v @ centre.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                centre[j] = v[near == j].mean(0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre, (v @ centre.T).argmax(1)


def _sparse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, text) to trigram counts of the texts that have a letter."""
    for rb in batches:
        lettered = pa.array([has_letter(x) for x in rb.column(2).to_pylist()], pa.bool_())
        rb = rb.filter(lettered)
        data, off = X.buffers(rb.column(2))
        at, n = [], []
        for i in range(rb.num_rows):
            c = counts(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))[0]
            at.append(np.flatnonzero(c).astype(np.int32))
            n.append(c[at[-1]])
        cols = [rb.column(0), rb.column(1).cast(pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "lang", "at", "n"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, per_language: int = PER_LANGUAGE, seed: int = 7) -> Centroids | None:
    """Centroids from at most ``sample_rows`` rows with id, text and language, drawn by a hash of the id, the
    same number for each language where there are enough; of more languages than that, one row each. Of rows of one
    id and language, the first by text is taken. None if no drawn text has a letter.

    Only the drawn ids, a bounded number, are sent to the tasks that read the texts, and only trigram counts of the
    whole texts, of a fixed size, come to the driver, so long texts are learned from like any others.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null")
    langs = rows.select("lang").distinct().count()
    if not langs:
        return None
    each = max(1, sample_rows // langs)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("hash", "id"))  # tasks pass on no more than this number of each language
    sample = rows.withColumn("hash", F.xxhash64("id")).withColumn("rank", rank).where(F.col("rank") <= each).select("id", "lang").distinct()
    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = texts.where("text is not null").join(F.broadcast(sample), ["id", "lang"]).mapInArrow(
        _sparse_counts, T.StructType([labelled.schema[id_col].__class__("id", labelled.schema[id_col].dataType), T.StructField("lang", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.FloatType()))])
    )
    first = counted.groupBy("id", "lang").agg(F.min(F.struct("at", "n")).alias("c")).select("id", "lang", "c.*")
    sample = sorted(first.collect(), key=lambda r: (r["lang"], r["id"]))
    if not sample:
        return None
    c = np.zeros((len(sample), DIMS), np.float32)
    for i, r in enumerate(sample):
        c[i, r["at"]] = r["n"]
    idf = (np.log((1 + len(c)) / (1 + (c > 0).sum(0))) + 1).astype(np.float32)
    v = vectors(c, idf)
    names = np.array([r["lang"] for r in sample])
    rng = np.random.default_rng(seed)
    centre, lang, floor = [], [], []
    for name in sorted(set(names)):
        mine = v[names == name]
        found, near = _kmeans(mine, per_language, rng)
        for j in range(len(found)):
            cos = mine[near == j] @ found[j]
            centre.append(found[j])
            lang.append(str(name))
            floor.append(float(np.quantile(cos, 0.01)) / 2 if len(cos) else 0.0)
    return Centroids(idf, np.stack(centre).T.copy(), lang, np.array(floor))


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred``, ``score`` (best cosine, 0 to 1) and ``rejected`` of every whole text.

    ``und`` with score 0 and rejected stands for a null text, a text without any letter, and for all
    texts when there is no model. A rejected text keeps its nearest language in ``lang_pred``. Of centroids of equal
    cosine, the first by language is taken. Repeated rows and null ids are handled row by row; other columns are ignored.
    """
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, off = X.buffers(rb.column(1))
            best: list[np.ndarray] = []
            cos: list[np.ndarray] = []
            for a, b in X.slices(off, 1 << 19):
                for lo in range(a, b, 256):
                    hi = min(lo + 256, b)
                    if model is None:
                        best.append(np.zeros(hi - lo, np.int64))
                        cos.append(np.zeros(hi - lo))
                        continue
                    near = vectors(counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), model.idf) @ model.centre
                    best.append(near.argmax(1))
                    cos.append(near.max(1).astype(np.float64))
            which = np.concatenate(best) if best else np.zeros(0, np.int64)
            score = np.concatenate(cos) if cos else np.zeros(0)
            lettered = np.array([has_letter(x) for x in rb.column(1).to_pylist()], bool)
            if model is None:
                lettered[:] = False
                names, floor = [UNKNOWN], np.zeros(1)
            else:
                names, floor = model.lang, model.floor
            pred = [names[i] if ok else UNKNOWN for i, ok in zip(which.tolist(), lettered.tolist(), strict=True)]
            score = np.clip(np.where(lettered, score, 0.0), 0, 1)
            rejected = ~lettered | (score < floor[which])
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
