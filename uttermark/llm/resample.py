"""Importance resampling of documents towards a target corpus by hashed word n-grams.

A pre-tokeniser of the tokenizers library, an untrained split by one pattern, gives each ASCII-lowered text's words with their
offsets. Every window of one to three consecutive words is a pair of offsets into the words joined by single spaces; the CRC-32
of its bytes picks one of 10,000 buckets. The texts are split once: each becomes the sorted list of its buckets, which is
written. Sums of the histograms, 10,000 numbers, give each bucket's gain, and a second pass over the histograms sums
the gains of every document. Documents are drawn without replacement in proportion to exp(weight / 1000) by adding Gumbel
noise made of a hash of the id and taking the highest scores, which are ranked in ranges over all tasks.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm import text as X
from uttermark.llm.order import sums_before
from uttermark.llm.work import folder, written

BUCKETS = 10_000
LONGEST = 3  #: words of a window
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  #: what stands between words of a lowered text
PART = 1 << 18  #: characters that are split at once, more only inside one word
_SPLITTER = []


def _splitter():
    """A tokenizer whose one trait is its pre-tokeniser; of its encodings only the offsets are used."""
    if not _SPLITTER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        tokenizer = Tokenizer(models.WordLevel({"?": 0}, unk_token="?"))
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(BETWEEN), "removed")
        _SPLITTER.append(tokenizer)
    return _SPLITTER[0]


def _parts(text: str) -> Iterator[str]:
    """``text`` in parts that end between words."""
    at, gap = 0, re.compile(BETWEEN)
    while len(text) - at > PART:
        end = gap.search(text, at + PART)
        if not end:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:] if at else text


def words_of(texts: list[str]) -> list[list[bytes]]:
    """Words of lowered texts by the pre-tokeniser's offsets."""
    out = []
    for text, encoding in zip(texts, _splitter().encode_batch(texts, add_special_tokens=False), strict=True):
        out.append([text[s:e].encode() for s, e in encoding.offsets])
    return out


def window_buckets(words: list[bytes], carried: int = 0) -> list[int]:
    """Buckets of all windows of one to ``LONGEST`` words that end after the first ``carried`` words."""
    joined, found = b" ".join(words), []
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts, ends = (ends + 1 - size).tolist(), ends.tolist()
    for k in range(1, LONGEST + 1):
        first = max(0, carried - k + 1)
        found += [crc32(joined[s:e]) % BUCKETS for s, e in zip(starts[first:], ends[first + k - 1 :], strict=False)]
    return found


def histogram(parts: Iterator[list[bytes]]) -> tuple[int, np.ndarray]:
    """Number of words of one text, whose words come in parts, and the buckets of its features in order, repeats kept."""
    n, carried, found = 0, [], []
    for words in parts:
        found.append(np.array(window_buckets(carried + words, len(carried)), np.uint16))
        n += len(words)
        carried = (carried + words)[-(LONGEST - 1) :]
    return n, np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint16)


_HELD = "n_words long, n_features long, buckets binary"  #: two bytes, little-endian, for each feature


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        data, off = X.buffers(rb.column(1))
        for a, b in X.slices(off, PART):
            texts = [data[off[i] : off[i + 1]].tobytes().lower().decode() for i in range(a, b)]  # bytes: A-Z alone
            if b - a == 1 and len(texts[0]) > PART:
                found = [histogram(words_of([p])[0] for p in _parts(texts[0]))]
            else:
                found = [histogram(iter([w])) for w in words_of(texts)]
            cols = [pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int64()), pa.array([f[1].astype("<u2").tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, b - a), *cols], names=["id", "n_words", "n_features", "buckets"])


def histograms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``buckets`` of every whole text."""
    held = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(_HELD).fields])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_histograms, held)


def _buckets(rb: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a batch of histograms, and where each row's begin and end."""
    size = rb.column("n_features").to_numpy()
    return np.frombuffer(b"".join(rb.column("buckets").to_pylist()), "<u2"), np.concatenate([[0], np.cumsum(size)])


def totals(held: DataFrame) -> np.ndarray:
    """Sum of all histograms. A task gives a row for each bucket, and as many rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for rb in batches:
            total += np.bincount(_buckets(rb)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in held.select("n_features", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of every bucket's smoothed share in the target to that in the corpus."""
    s, t = int(corpus.sum()), int(target.sum())
    ratio = [(b + 1) * (s + BUCKETS) / ((a + 1) * (t + BUCKETS)) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _gumbel(id_col: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
) -> DataFrame:
    """Weight, score and rank of every document; ``percent`` of those with ``least_words`` words or more are drawn.

    Returns the id, ``n_words``, ``n_features``, ``weight`` (sum of the gains of the features, repeats counted), ``score``
    (weight and noise) and ``rank`` (1, 2, 3, ... by score, ties to the smaller id; null if not drawn). Null and empty texts
    have no features and weight 0. A null id has the noise of an empty one and comes before others in a tie; repeated rows are documents
    of their own, with equal scores and successive ranks. Texts of any length are split whole, in parts. Without target texts
    the target is even. Other columns are ignored. Empty tables give none.
    """
    path = folder(docs.sparkSession)
    held = written(histograms(docs, id_col, text_col), f"{path}/histograms")
    gain = gains(totals(held), totals(histograms(target, target_id, target_text)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            bucket, off = _buckets(rb)
            sums = np.concatenate([[0], np.cumsum(gain[bucket])])
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in ("id", "n_words", "n_features")), pa.array(sums[off[1:]] - sums[off[:-1]])], names=["id", "n_words", "n_features", "weight"])

    schema = T.StructType([held.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    weighed = held.mapInArrow(weigh, schema)
    scored = written(weighed.withColumn("score", F.col("weight") + _gumbel(F.col("id"), seed)), f"{path}/scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = sums_before(scored.where(able), [-F.col("score"), F.col("id")], {"rank": F.lit(1)}, f"{path}/placed")
    ranked = placed.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    out = ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
