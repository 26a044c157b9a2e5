"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one over all texts, one over
all texts of a trusted target. A text's score is the mean of log(target / raw) over its n-grams, and it
is kept at a fixed threshold, with no random choice. Counting adds up one vector per task before
the shuffle; the ratio table has a fixed number of entries, so it is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm import text as X
from uttermark.llm.work import small

BUCKETS = 1 << 15
#: between the classes of sf0.1's labels: of texts that the base rules pass, all 3,330 of label 1 lie above it (the lowest hundredth
#: at -0.009), and 98 % of label 0 below (their median at -0.41)
THRESHOLD = -0.12
SIGNS = np.zeros(256, bool)
SIGNS[list(b"#*$%&|<>")] = True


def _buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every unigram and bigram."""
    h, row, _, _ = X.hashed_words(buf, off)
    g, grow, _ = X.ngrams(h, row, 2)
    one, two = X.mix(h) % np.uint64(BUCKETS), X.mix(g ^ np.uint64(0xA5A5A5A5)) % np.uint64(BUCKETS)
    return np.concatenate([one, two]).astype(np.int64), np.concatenate([row, grow])


def bucket_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket``, ``n``: how often each bucket occurs in all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for rb in batches:
            data, off = X.buffers(rb.column(0))
            for a, b in X.slices(off):
                total += np.bincount(_buckets(data[off[a] : off[b]], off[a : b + 1] - off[a])[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratio(raw: DataFrame, target: DataFrame, text_col: str = "text") -> np.ndarray:
    """log(target / raw) of each bucket, with one count added to each; all zero without a target."""
    both = bucket_counts(raw, text_col).withColumn("of", F.lit(0)).unionByName(bucket_counts(target, text_col).withColumn("of", F.lit(1)))
    n = np.zeros((2, BUCKETS))
    for r in both.collect():  # at most two rows for each bucket
        n[r["of"], r["bucket"]] = r["n"]
    if not n[1].any():
        return np.zeros(BUCKETS)
    p = (n + 1) / (n.sum(1, keepdims=True) + BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def trusted_texts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of all trusted ids; a null id is none. Ids go to the tasks that read the texts where a count shows that
    they are few (``work.small``), else both sides are joined by a shuffle."""
    ids = trusted.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return docs.select(id_col, text_col).join(small(ids), id_col, "left_semi").select(text_col)


def statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of ``buf``."""
    rows = len(off) - 1
    h, row, s, e = X.hashed_words(buf, off, X.SAME)
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    space = X.SPACE[buf]
    out = {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": count(~space & ((buf & 0xC0) != 0x80)),
        "n_symbols": count(SIGNS[buf]),
    }
    # lines: a break ends one, and so does the end of the text
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]))
    of = np.searchsorted(off[1:], starts, side="right") if len(starts) else starts
    of_break = np.searchsorted(off, breaks, side="right") - 1
    owner = np.concatenate([np.arange(rows), of_break])
    begin = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    end = np.empty_like(begin)
    end[:-1] = np.where(owner[1:] == owner[:-1], begin[1:] - 1, off[owner[:-1] + 1])
    if len(end):
        end[-1] = off[-1]
    del starts, of
    words = np.concatenate([[0], np.cumsum(~space)])
    filled = words[end] > words[begin]
    owner, begin, end = owner[filled], begin[filled], end[filled]
    lines = X.span_hashes(buf, begin, end, X.SAME)
    out["n_dup_lines"] = _repeats(owner, lines, rows, later=True)[0]
    g, grow, at = X.ngrams(h, row, 5)
    _, again = _repeats(grow, g, rows, later=False)
    covered = np.zeros(len(h) + 5, np.int64)
    where = at[again]
    np.add.at(covered, where, 1)
    np.add.at(covered, where + 5, -1)
    inside = np.cumsum(covered)[: len(h)] > 0
    out["n_repeat_words"] = np.bincount(row[inside], minlength=rows)
    return out


def _repeats(row: np.ndarray, key: np.ndarray, rows: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of keys that occur more than once in a row: how many (all but the first, if ``later``), and where."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    same = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    flag = np.zeros(len(k), bool)
    flag[1:] = same
    if not later:
        flag[:-1] |= same
    return np.bincount(r[flag], minlength=rows), order[flag]


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every whole text.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``llr`` (mean log ratio of the n-grams; 0 without words) and ``kept`` (not failed and ``llr`` at or
    above the threshold). A null text counts as empty, and fails for having under ten words. Repeated
    rows and null ids are judged row by row; other columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(x, T.LongType()) for x in names), T.StructField("llr", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, off = X.buffers(rb.column(1))
            for a, b in X.slices(off):
                buf, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                stats = statistics(buf, at)
                bucket, row = _buckets(buf, at)
                total = np.bincount(row, weights=ratio[bucket], minlength=b - a)
                llr = total / np.maximum(np.bincount(row, minlength=b - a), 1)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(a, b - a), *(pa.array(stats[x].astype(np.int64)) for x in names), pa.array(llr)], names=schema.names
                )

    out = docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
