"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks. Learned filters six bytes wide slide over
every byte; each filter's largest rectified response in a chunk is kept; the mean and the largest
of these over all chunks go through one logistic unit, which gives the document's probability.
The filters are learned on the driver from a bounded sample of labelled rows; scoring is a
single pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm import text as X
from uttermark.llm.work import drawn

WIDTH, FILTERS = 6, 16
CHUNK, STRIDE = 512, 448
SLICE_BYTES = 1 << 18
SAMPLE_ROWS = 2000  #: most labelled rows that a fit sees
GROUP = 512  #: chunks whose responses a fit holds at once


@dataclass
class Network:
    taps: np.ndarray  #: WIDTH x 256 x FILTERS, the filters' weight for each byte at each place
    bias: np.ndarray
    out: np.ndarray  #: weights of mean and largest responses
    shift: float

    def pairs(self) -> list[np.ndarray]:
        """Responses of two adjacent taps for every pair of bytes."""
        return [(self.taps[j][:, None, :] + self.taps[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)]


def layout(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with WIDTH zeros after every text; start and end of each chunk; its row. An empty text
    has one chunk of one place."""
    n = np.diff(off)
    places = np.maximum(n, 1)
    at = np.concatenate([[0], np.cumsum(n + WIDTH)])
    padded = np.zeros(at[-1] + WIDTH, np.uint8)
    padded[np.arange(len(buf)) + np.repeat(at[:-1] - off[:-1], n)] = buf
    chunks = np.maximum(1, -(-(places - (CHUNK - STRIDE)) // STRIDE))
    row = np.repeat(np.arange(len(n)), chunks)
    first = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = at[row] + first * STRIDE
    return padded, start, np.minimum(start + CHUNK, at[row] + places[row]), row


def responses(padded: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Response of every filter at every place of a padded buffer."""
    n = len(padded) - WIDTH + 1
    two = padded[:-1].astype(np.int32) * 256 + padded[1:]
    out = tables[0].take(two[:n], axis=0)
    for j in range(1, WIDTH // 2):
        out += tables[j].take(two[2 * j : 2 * j + n], axis=0)
    out += bias
    return out


def pool(r: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest rectified response of each chunk, and the documents' features made of them."""
    at = np.stack([start, end], 1).ravel()
    top = np.maximum(np.maximum.reduceat(r, at, axis=0)[::2], 0)
    return top, pooled(top, row, rows)


def strongest(padded: np.ndarray, start: np.ndarray, end: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest rectified response of each chunk and its place, by filter, ``GROUP`` chunks at a time."""
    top, where = [], []
    for lo in range(0, len(start), GROUP):
        s, e = start[lo : lo + GROUP], end[lo : lo + GROUP]
        r = responses(padded[s[0] : e[-1] + WIDTH - 1], tables, bias)
        place = np.stack([a + r[a:b].argmax(0) for a, b in zip((s - s[0]).tolist(), (e - s[0]).tolist(), strict=True)])
        top.append(np.maximum(r[place, np.arange(r.shape[1])], 0))
        where.append(place + s[0])
    return np.concatenate(top), np.concatenate(where)


def pooled(top: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The documents' features: mean and largest of their chunks' responses."""
    begin = np.searchsorted(row, np.arange(rows))
    count = np.diff(np.append(begin, len(row)))[:, None]
    return np.concatenate([np.add.reduceat(top, begin, axis=0) / count, np.maximum.reduceat(top, begin, axis=0)], 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def train(texts: list[bytes], labels: np.ndarray, prior: float, epochs: int = 14, seed: int = 5) -> Network:
    """Fit by Adam on the cross-entropy, classes weighted alike; ``prior`` is the share of label 1
    in the population, to which the probability is shifted back afterwards."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.12, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
        0.0,
    )
    params = [net.taps, net.bias, net.out, np.zeros(1, np.float32)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 48):
            part = order[lo : lo + 48]
            buf = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
            padded, start, end, row = layout(buf, off)
            top, where = strongest(padded, start, end, net.pairs(), net.bias)
            feats = pooled(top, row, len(part))
            p = sigmoid(feats @ net.out + params[3][0])
            g = ((p - labels[part]) * weight[part] / len(part)).astype(np.float32)
            d_out = feats.T @ g
            d_feats = g[:, None] * net.out[None, :]
            count = np.bincount(row, minlength=len(part))
            begin = np.searchsorted(row, np.arange(len(part)))
            d_top = (d_feats[:, :FILTERS] / count[:, None])[row]
            for i in range(len(part)):
                a, b = begin[i], begin[i] + count[i]
                d_top[a + top[a:b].argmax(0), np.arange(FILTERS)] += d_feats[i, FILTERS:]
            d_top *= top > 0
            d_taps = np.zeros_like(net.taps)
            for j in range(WIDTH):
                np.add.at(d_taps[j], (padded[where + j], np.arange(FILTERS)[None, :].repeat(len(where), 0)), d_top)
            grads = [d_taps, d_top.sum(0), d_out.astype(np.float32) + 1e-4 * net.out, np.array([g.sum()], np.float32)]
            step += 1
            for x, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    net.shift = float(params[3][0] + np.log(prior / (1 - prior)))
    return net


def scores(net: Network, tables: list[np.ndarray], buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    padded, start, end, row = layout(buf, off)
    _, feats = pool(responses(padded, tables, net.bias), start, end, row, len(off) - 1)
    return sigmoid((feats @ net.out).astype(np.float64) + net.shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """Fit on the texts of at most ``sample_rows`` labels, half of each class where there are enough, drawn by
    a hash of the id. Null labels, and labels without a text, are left out. None without both classes. Of texts of one
    id, the first by its bytes is taken. Texts of any length are learned from whole.

    Only the drawn labels, a bounded number, are sent to the tasks that read the texts, and their whole texts come to the
    driver, ``sample_rows`` at most; a step of the fit holds the responses of ``GROUP`` chunks.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    seen = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = known.distinct()
    if len(seen) < 2:
        return None
    sample = drawn(known.where("label = 0"), "id", sample_rows // 2).unionByName(drawn(known.where("label = 1"), "id", sample_rows // 2))
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw")).where("raw is not null")
    found = raw.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("raw").alias("raw"))
    found = sorted(found.collect(), key=lambda r: (r["id"], r["label"]))
    y = np.array([r["label"] for r in found], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    return train([bytes(r["raw"]) for r in found], y, seen[1] / (seen[0] + seen[1]))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Probability of label 1 of every whole text, as ``score``, beside the id and the columns in ``keep``
    (the text may be one of them).

    A null or empty text is scored like any other, as one place of padding. Repeated rows and null ids
    are scored row by row. Columns that aren't named are ignored. An empty table gives no rows.
    """
    cols = [id_col, *(keep or [])]
    schema = T.StructType([docs.schema[c] for c in cols] + [T.StructField("score", T.DoubleType())])
    body = F.col(text_col).cast("string")
    at = cols.index(text_col) if text_col in cols else len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pairs()
        for rb in batches:
            data, off = X.buffers(rb.column(at))
            found = [scores(net, tables, data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in X.slices(off, SLICE_BYTES)]
            found = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*rb.columns[: len(cols)], pa.array(found)], names=schema.names)

    return docs.select(*cols, *([] if text_col in cols else [body.alias("__text")])).mapInArrow(run, schema)
