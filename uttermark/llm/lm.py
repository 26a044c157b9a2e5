"""Language-model scores by a subword lattice, beside a smoothed word-unigram score.

The pieces of an existing vocabulary, and every single byte, are the units. Their weights are the
vocabulary's own scores; the given file has ranks for scores, which are read as a Zipf law. The probability of
the end of a text is learned from the training texts. A text is the words in it, each with a word mark before
it, then the end. Pieces do not cross words, so the probability of a text, summed over all its
segmentations, is the product of its words' sums, each found by a forward recursion in log space over the
word's bytes. A second score uses weights adapted to the corpus: expectation maximisation over its
word counts, which starts from the vocabulary's weights. A third has the training words themselves as units beside a
lattice fitted to their spellings, each word once: (c + D q) / (N + D) for a word seen c times of N, with the lattice's q and
as much weight for new words as there were distinct ones, D (Witten and Bell).

Every distinct word of the corpus is counted and scored once, in a table that grows with the corpus.
The most frequent words (a fixed number) are sent to the tasks that read the texts; all others are
joined to the texts by their 64-bit hash, so no join key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import exp, inf, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm import text as X
from uttermark.llm.work import folder, written

MARK = 0xFF  #: stands for the word mark; no UTF-8 text holds this byte
HEAD = 1 << 18  #: most words sent to every task, the most frequent ones
FLUSH = 150_000  #: distinct words that a task holds before it hands them on
LONG = 48  #: longer words are taken one by one, in segments
SEGMENT = 1 << 16
ROUNDS = 1
SPELLING_ROUNDS = 4  #: of the lattice for new words
_LN10 = float(np.log(10))


@dataclass
class Units:
    """Byte strings with log probabilities."""

    names: list[bytes]
    logp: np.ndarray
    end: float = 0.0  #: log probability of the end of a text

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.names))

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes, the units in that order, and a table of leading bits."""
        buf = np.frombuffer(b"".join(self.names), np.uint8)
        e = np.cumsum([len(x) for x in self.names])
        with np.errstate(over="ignore"):
            h = X.span_hashes(buf, np.concatenate([[0], e[:-1]]), e, X.SAME)
        order = np.argsort(h)
        lead = np.zeros(1 << 20, bool)
        lead[h >> np.uint64(44)] = True
        return h[order], order, lead


def vocabulary(path: str) -> Units:
    """Pieces of a sentencepiece file without an inner word mark, and all single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i)
        body = piece.removeprefix("▁")
        if "▁" in body or piece == "":
            continue
        raw = (bytes([MARK]) if body != piece else b"") + body.encode()
        weight[raw] = max(weight.get(raw, 0.0), 1.0 / (2.0 - min(sp.get_score(i), 0.0)))
    for b in range(256):
        weight.setdefault(bytes([b]), 1e-4)
    names = sorted(weight)
    w = np.array([weight[x] for x in names])
    return Units(names, np.log(w / w.sum()))


def _edges(units: Units, buf: np.ndarray, end: np.ndarray, l: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a unit of ``l`` bytes begins inside a word, and the units. ``end``: of the word at each place."""
    h, order, lead = units.index
    s = np.flatnonzero(np.arange(len(buf)) + l <= end)
    if not len(s):
        return s, s
    g = X.span_hashes(buf, s, s + l, X.SAME)
    some = np.flatnonzero(lead[g >> np.uint64(44)])
    at = np.searchsorted(h, g[some])
    at[at == len(h)] = 0
    hit = h[at] == g[some]
    return s[some[hit]], order[at[hit]]


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def lattice(units: Units, words: list[bytes], count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each word with its mark, summed over all segmentations; with ``count``,
    also each unit's expected number of uses over that many words."""
    mark = bytes([MARK])
    buf = np.frombuffer(b"".join(mark + w for w in words), np.uint8)
    n = np.array([len(w) + 1 for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    end = np.repeat(first + n, n)
    place = np.arange(len(buf)) - np.repeat(first, n)
    reach = min(units.longest, int(n.max()))
    edges = [_edges(units, buf, end, l) for l in range(1, reach + 1)]
    # log weight of the unit of l bytes at each place
    cost = np.full((reach, len(buf)), -np.inf)
    for l, (s, u) in enumerate(edges):
        cost[l, s] = units.logp[u]
    by_length = np.argsort(-n, kind="stable")
    begin, size = first[by_length], n[by_length]
    alpha = np.full((len(words), int(n.max()) + 1), -np.inf)
    alpha[:, 0] = 0
    for k in range(1, int(n.max()) + 1):
        live = int(np.searchsorted(-size, -k, side="right"))
        out = np.full(live, -np.inf)
        for l in range(1, min(reach, k) + 1):
            out = _add(out, alpha[:live, k - l] + cost[l - 1, begin[:live] + k - l])
        alpha[:live, k] = out
    total = alpha[np.arange(len(words)), size]
    result = np.empty(len(words))
    result[by_length] = total
    if count is None:
        return result, None
    beta = np.full(alpha.shape, -np.inf)
    beta[np.arange(len(words)), size] = 0
    for k in range(int(n.max()) - 1, -1, -1):
        live = int(np.searchsorted(-size, -(k + 1), side="right"))
        out = beta[:live, k]
        for l in range(1, min(reach, int(n.max()) - k) + 1):
            inner = int(np.searchsorted(-size, -(k + l), side="right"))
            out[:inner] = _add(out[:inner], beta[:inner, k + l] + cost[l - 1, begin[:inner] + k])
    rank = np.empty(len(words), np.int64)
    rank[by_length] = np.arange(len(words))
    owner = np.repeat(np.arange(len(words)), n)
    used = np.zeros(len(units.names))
    for l, (s, u) in enumerate(edges):
        if len(s):
            r, k = rank[owner[s]], place[s]
            p = np.exp(alpha[r, k] + units.logp[u] + beta[r, k + l + 1] - total[r])
            used += np.bincount(u, weights=p * count[owner[s]], minlength=len(used))
    return result, used


def long_word(units: Units, word: bytes, count: float | None = None) -> tuple[float, np.ndarray | None]:
    """``lattice`` for one word of any length, in time and memory in proportion to it."""
    buf = np.frombuffer(bytes([MARK]) + word, np.uint8)
    n, reach = len(buf), units.longest

    def edges(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and unit of the edges that end in lo+1..hi, by their end."""
        first = max(0, lo + 1 - reach)
        part = buf[first:hi]
        found = [(s, s + l, u) for l in range(1, reach + 1) for s, u in [_edges(units, part, np.full(len(part), len(part)), l)]]
        s, e, u = (np.concatenate(x) for x in zip(*found, strict=True))
        mine = np.flatnonzero(e + first > lo)
        mine = mine[np.argsort(e[mine], kind="stable")]
        return s[mine] + first, e[mine] + first, u[mine]

    segments = [(lo, min(lo + SEGMENT, n)) for lo in range(0, n, SEGMENT)]
    alpha = [0.0] * (n + 1)
    for lo, hi in segments:
        s, e, u = edges(lo, hi)
        at = np.searchsorted(e, np.arange(lo + 1, hi + 2)).tolist()
        s, cost = s.tolist(), units.logp[u].tolist()
        for k in range(lo + 1, hi + 1):
            a, b = at[k - lo - 1], at[k - lo]
            terms = [alpha[i] + c for i, c in zip(s[a:b], cost[a:b], strict=True)]
            top = max(terms)
            alpha[k] = top + log(sum(exp(x - top) for x in terms))
    total = alpha[n]
    if count is None:
        return total, None
    beta = [-inf] * n + [0.0]
    used = np.zeros(len(units.names))
    for lo, hi in reversed(segments):
        s, e, u = edges(lo, hi)
        cost = units.logp[u]
        for i, k, c in zip(s[::-1].tolist(), e[::-1].tolist(), cost[::-1].tolist(), strict=True):  # all edges from k are done before those to k
            x, y = beta[i], beta[k] + c
            top = max(x, y)
            beta[i] = top + log1p(exp(-abs(x - y)))
        p = np.exp(np.array([alpha[i] for i in s.tolist()]) + cost + np.array([beta[k] for k in e.tolist()]) - total)
        used += np.bincount(u, weights=p * count, minlength=len(used))
    return total, used


def _in_parts(units: Units, words: list[bytes], count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``lattice`` over words of alike length together, so that memory stays in proportion to their bytes."""
    out, used = np.empty(len(words)), np.zeros(len(units.names))
    n = np.array([len(w) for w in words], np.int64)
    order = np.argsort(n, kind="stable")
    short = int(np.searchsorted(n[order], LONG))
    for i in order[short:].tolist():
        out[i], u = long_word(units, words[i], None if count is None else float(count[i]))
        if u is not None:
            used += u
    lo, order = 0, order[:short]
    while lo < len(order):
        longest = max(16, int(n[order[lo]]) * 2)
        hi = int(np.searchsorted(n[order], longest, side="right"))
        hi = min(hi, lo + max(1, 200_000 // (longest + 1)))
        part = order[lo:hi]
        out[part], u = lattice(units, [words[i] for i in part], None if count is None else count[part])
        if u is not None:
            used += u
        lo = hi
    return out, used


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of (text, train) rows with their number in training texts."""
    count: dict[int, int] = {}
    word: dict[int, bytes] = {}

    def batch() -> pa.RecordBatch:
        keys = list(word)
        cols = [pa.array([word[k] for k in keys], pa.binary()), pa.array([count[k] for k in keys], pa.int64())]
        word.clear()
        count.clear()
        return pa.RecordBatch.from_arrays(cols, names=["word", "n"])

    for rb in batches:
        data, off = X.buffers(rb.column(0))
        train = np.asarray(rb.column(1).to_numpy(zero_copy_only=False), bool)
        for a, b in X.slices(off):
            buf = data[off[a] : off[b]]
            with np.errstate(over="ignore"):
                h, row, s, e = X.hashed_words(buf, off[a : b + 1] - off[a])
            key, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=train[a:b][row], minlength=len(key)).astype(np.int64)
            small = X.LOWER[buf]
            for k, i, m in zip(key.tolist(), at.tolist(), n.tolist(), strict=True):
                if k in count:
                    count[k] += m
                else:
                    count[k] = m
                    word[k] = small[s[i] : e[i]].tobytes()
            if len(word) > FLUSH:
                yield batch()
    if word:
        yield batch()


def _expect(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(units.names))
        with np.errstate(over="ignore"):
            for rb in batches:
                total += _in_parts(units, rb.column(0).to_pylist(), rb.column(1).to_numpy())[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["unit", "uses"])

    return run


def with_end(units: Units, texts: int, tokens: int) -> Units:
    """The vocabulary's units beside an end of text, which has its share of the training tokens."""
    share = (texts + 0.01) / (tokens + 0.02)
    return Units(units.names, units.logp + np.log1p(-share), float(np.log(share)))


def train_units(units: Units, words: DataFrame, texts: int, rounds: int = ROUNDS) -> Units:
    """Units re-weighted by their expected uses in ``words`` (``word``, ``n``) and ``texts`` ends."""
    for _ in range(rounds):
        found = words.where("n > 0").select("word", "n").mapInArrow(_expect(units), "unit long, uses double")
        uses = np.zeros(len(units.names))
        for r in found.groupBy("unit").agg(F.sum("uses").alias("uses")).collect():  # a row for each unit at most
            uses[r["unit"]] = r["uses"]
        uses += 0.01  # no unit, so no byte, gets probability 0
        total = uses.sum() + texts + 0.01
        units = Units(units.names, np.log(uses / total), float(np.log((texts + 0.01) / total)))
    return units


def frequent(values: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of the largest ``n``, as many whole levels of it as hold at most ``HEAD`` rows; a level is a 32nd of a doubling, so
    that a few hundred counts decide and no task sorts the table."""
    level = F.floor(F.log2(F.col("n") + 1) * 32)
    counts = values.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, held = None, 0
    for r in sorted(counts, key=lambda r: -r["level"]):
        held += r["rows"]
        if held > (HEAD if most is None else most):
            break
        least = r["level"]
    return values.where(level >= least) if least is not None else values.limit(0)


def score(docs: DataFrame, vocabulary_path: str, train: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Scores of every whole text, learned from the rows where ``train`` is true.

    Tokens are the words (A-Z lower-cased) and one end for each text. Returns the id, ``n_tokens``,
    ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score`` (sum of
    log10((c + 1) / (N + V + 1))), ``score`` (log10 probability of the text in the lattice model) and
    ``adapted_score`` (the same with weights adapted to the training texts by ``rounds`` rounds) and ``mixed_score`` (log10
    probability by the training words' counts, with a lattice of their spellings for new words).
    A null or empty text is its end alone. A null ``train`` counts as false. Repeated rows and null ids are
    scored row by row; without training texts all counts are 0. Other columns are ignored.
    """
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    id_field = docs.schema[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counted = rows.select("text", "train").mapInArrow(_count_words, "word binary, n long")
    words = written(counted.groupBy("word").agg(F.sum("n").alias("n")), f"{path}/words")
    texts = rows.where("train").count()
    of = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = of["n"] + texts, of["v"] + (texts > 0)
    given = vocabulary(vocabulary_path)
    adapted = train_units(given, words, texts, rounds)
    spelling = train_units(given, words.withColumn("n", F.least("n", F.lit(1))), 0, SPELLING_ROUNDS)
    given = with_end(given, texts, total)
    new = log(distinct + 1)  # one more, so that there is a model without training texts

    def mixed(n: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 of (n + (D + 1) q) / (N + D + 1); logs throughout, since the q of a long word is below any double."""
        with np.errstate(divide="ignore"):
            return (np.logaddexp(np.log(np.asarray(n, float)), new + lattice) - np.log(total + distinct + 1.0)) / _LN10

    smooth = np.log10(total + distinct + 1)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rb in batches:
                word, n = rb.column(0).to_pylist(), rb.column(1).to_numpy()
                e = np.cumsum([len(w) for w in word])
                buf = np.frombuffer(b"".join(word), np.uint8)
                h = X.span_hashes(buf, e - [len(w) for w in word], e, X.SAME)
                lat = [pa.array(_in_parts(u, word)[0] / _LN10) for u in (given, adapted)]
                lat.append(pa.array(mixed(n, _in_parts(spelling, word)[0])))
                cols = [pa.array(h.view(np.int64)), pa.array(n), pa.array(np.log10(n + 1.0) - smooth), *lat]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "n", "base", "lattice", "adapted", "mixed"])

    values = written(words.mapInArrow(value, "h long, n long, base double, lattice double, adapted double, mixed double"), f"{path}/values")
    head = frequent(values).toArrow().sort_by("h")  # HEAD rows at most
    head_h = head["h"].to_numpy()
    head_n, head_base, head_lattice, head_adapted, head_mixed = (head[c].to_numpy() for c in ("n", "base", "lattice", "adapted", "mixed"))
    end_base, end_known = float(np.log10(texts + 1.0) - smooth), int(texts > 0)
    end_lattice, end_adapted, end_mixed = given.end / _LN10, adapted.end / _LN10, float(mixed(np.array(texts), spelling.end))

    schema = T.StructType(
        [
            id_field.__class__("id", id_field.dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("lattice", T.DoubleType()),
            T.StructField("adapted", T.DoubleType()),
            T.StructField("mixed", T.DoubleType()),
            T.StructField("rare", T.ArrayType(T.LongType())),
        ]
    )

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            data, off = X.buffers(rb.column(1))
            for a, b in X.slices(off):
                with np.errstate(over="ignore"):
                    h, row, _, _ = X.hashed_words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                key, inverse = np.unique(h.view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(head_h, key), max(len(head_h) - 1, 0))
                hit = head_h[at] == key if len(head_h) else np.zeros(len(key), bool)
                pick = lambda v: np.where(hit, v[at], 0) if len(head_h) else np.zeros(len(key))
                known, base, lat, ada, mix = (pick(v) for v in ((head_n > 0).astype(float), head_base, head_lattice, head_adapted, head_mixed))
                n = b - a
                add = lambda v: np.bincount(row, weights=v[inverse], minlength=n)
                rare = ~hit[inverse]
                rare_rows = np.searchsorted(row[rare], np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(rare_rows.astype(np.int32)), pa.array(h.view(np.int64)[rare]))
                cols = [rb.column(0).slice(a, n), pa.array(np.bincount(row, minlength=n) + 1), pa.array(add(known).astype(np.int64) + end_known)]
                cols += [pa.array(add(base) + end_base), pa.array(add(lat) + end_lattice), pa.array(add(ada) + end_adapted), pa.array(add(mix) + end_mixed), lists]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    scored = rows.select("id", "text").mapInArrow(tokens, schema).withColumn("row", F.monotonically_increasing_id())
    scored = written(scored, f"{path}/scored")
    rare = scored.select("row", F.explode("rare").alias("h")).join(values, "h")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("rare_known"), F.sum("base").alias("rare_base"), F.sum("lattice").alias("rare_lattice"), F.sum("adapted").alias("rare_adapted"), F.sum("mixed").alias("rare_mixed")
    )
    out = scored.drop("rare").join(rare, "row", "left")
    zero = F.lit(0)
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("lattice") + F.coalesce("rare_lattice", zero)).alias("score"),
        (F.col("adapted") + F.coalesce("rare_adapted", zero)).alias("adapted_score"),
        (F.col("mixed") + F.coalesce("rare_mixed", zero)).alias("mixed_score"),
    )
