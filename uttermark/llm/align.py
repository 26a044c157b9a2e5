"""Alignment of two tokenizers' tokens over one text by their bytes.

Exact copies are tokenised once: the texts are shuffled by their full text and counted. Each distinct text's tokens of A and B
are laid over its bytes. Offsets where both end cut them into groups; any cut of either is the end of one overlap of an
A token and a B token, a link. Links of an id pair are counted in documents, each distinct text as often as it occurs. What a
text's links have in counts is then summed, and joined to the ids of the documents by a digest of the text.

Pairs that many texts hold are sent to all tasks, as whole levels of counts and ``HEAD`` pairs at most; the others
are few in number of uses, and are joined by a shuffle in which no pair is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm import text as X
from uttermark.llm.lm import frequent
from uttermark.llm.packing import TextTokenizer
from uttermark.llm.work import folder, written

HEAD = 500_000  #: most pairs that are sent to all tasks
_PAIRS: dict[tuple[str, str], Pair] = {}


class Spelling:
    """Bytes of every id of a vocabulary, end to end."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.data[at + np.repeat(self.start[ids], n)]


class Pair:
    """Tokenizer A (a byte-level BPE file), after a space, and tokenizer B (a sentencepiece model, which adds one)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = TextTokenizer(a_path)
        self.a.tokenizer.encode_special_tokens = True  # their strings are plain text
        vocabulary, special = self.a.tokenizer.get_vocab(), set(self.a.added)
        self.a.added = []
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = token.encode() if token in special else bytes(byte[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.spell_a = Spelling(entries)
        self.spell_b = Spelling([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.width = len(pieces)  #: a pair's code is its A id times this and its B id
        self.digits = np.zeros((max(len(entries), len(pieces)), 11), np.uint8)
        self.length = np.zeros(len(self.digits), np.int64)
        for i in range(len(self.digits)):
            d = str(i).encode()
            self.digits[i, : len(d)], self.length[i] = np.frombuffer(d, np.uint8), len(d)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [self.a.ids(" " + t) for t in texts], [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]


def _pair(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _kept(pair: Pair, texts: list[str], ids_a: list[np.ndarray], ids_b: list[np.ndarray]) -> np.ndarray:
    """Texts of which both tokenizers spell every byte."""
    good = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        want = b" " + t.encode()
        good[i] = pair.spell_a.bytes_of(ids_a[i]).tobytes() == want == pair.spell_b.bytes_of(ids_b[i]).tobytes()
    return good


def lay_over(pair: Pair, texts: list[str]) -> dict[str, np.ndarray | list]:
    """Measures of every text and its links: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``digest`` of the groups, and ``text``, ``code``
    and ``uses`` of each distinct id pair of a text. Texts that either tokenizer changes have none."""
    n = len(texts)
    ids_a, ids_b = pair.encode(texts)
    good = np.flatnonzero(_kept(pair, texts, ids_a, ids_b))
    out: dict = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"digest": [""] * n}
    none = np.zeros(0, np.int64)
    if not len(good):
        return out | {"text": none, "code": none, "uses": none}
    n_a, n_b = (np.array([len(x[i]) for i in good]) for x in (ids_a, ids_b))
    a, b = (np.concatenate([x[i] for i in good]).astype(np.int64) for x in (ids_a, ids_b))
    # the texts lie end to end in both, so one row of offsets holds them all
    end_a, end_b = np.cumsum(pair.spell_a.size[a]), np.cumsum(pair.spell_b.size[b])
    last = end_a[np.cumsum(n_a) - 1]
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    cuts = np.union1d(end_a, end_b)
    code = a[np.searchsorted(end_a, cuts)] * pair.width + b[np.searchsorted(end_b, cuts)]
    of = np.searchsorted(last, cuts)
    out["n_a"][good], out["n_b"][good] = n_a, n_b
    out["n_groups"][good] = np.bincount(np.searchsorted(last, both), minlength=len(good))
    out["n_links"][good] = np.bincount(of, minlength=len(good))
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])]))
    uses = np.diff(np.append(new, len(code)))
    for i, text in zip(good.tolist(), _group_texts(pair, a, b, end_a, end_b, both, last), strict=True):
        out["digest"][i] = hashlib.sha256(text).hexdigest()
    return out | {"text": good[of[new]], "code": code[new], "uses": uses}


def _group_texts(pair: Pair, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, both: np.ndarray, last: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    place = np.concatenate([2 * np.searchsorted(both, end_a), 2 * np.searchsorted(both, end_b) + 1])
    order = np.argsort(place, kind="stable")
    place, ids = place[order], np.concatenate([a, b])[order]
    ends = np.append(place[1:] != place[:-1], True)
    mark = np.where(ends, np.where(place % 2 == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
    n = pair.length[ids]
    rows = pair.digits[ids]
    rows[np.arange(len(ids)), n] = mark
    flat = rows[np.arange(rows.shape[1])[None, :] <= n[:, None]]
    # a text ends with the B side of its last group
    stop = np.cumsum(n + 1)[np.searchsorted(place, 2 * np.searchsorted(both, last) + 1, side="right") - 1]
    return [flat[s : e - 1].tobytes() for s, e in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]


_LAID = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, uses array<int>"


def _lay(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for rb in batches:
            data, off = X.buffers(rb.column(0))
            for s, e in X.slices(off):
                texts = [data[off[i] : off[i + 1]].tobytes() for i in range(s, e)]
                got = lay_over(pair, [t.decode() for t in texts])
                ends = pa.array(np.searchsorted(got["text"], np.arange(e - s + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(got[c].astype(kind))) for c, kind in (("code", np.int64), ("uses", np.int32))]
                key = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                measures = [pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([key, rb.column(1).slice(s, e - s), *measures, pa.array(got["digest"]), *lists], names=[x.split()[0] for x in _LAID.split(", ")])

    return run


def pair_counts(laid: DataFrame, width: int) -> DataFrame:
    """``code``, ``n`` (documents that hold the pair linked) and ``best`` (no pair of its A id has more). An A id has at most as many
    pairs as B has ids."""
    counted = laid.select("copies", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("copies").alias("n"))
    most = F.max("n").over(W.partitionBy(F.floor(F.col("code") / width)))
    return counted.withColumn("best", F.col("n") == most)


def _sums(head: pa.Table, rare: bool):
    """Sums of each text over its frequent pairs, or its other pairs one by one."""
    code, n, best = (head[c].to_numpy() for c in ("code", "n", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            codes, uses = rb.column(1), rb.column(2).flatten().to_numpy().astype(np.int64)
            size = np.asarray(codes.value_lengths(), np.int64)
            of, flat = np.repeat(np.arange(len(size)), size), codes.flatten().to_numpy()
            at = np.minimum(np.searchsorted(code, flat), max(len(code) - 1, 0))
            hit = code[at] == flat if len(code) else np.zeros(len(flat), bool)
            if rare:
                left = np.flatnonzero(~hit)
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(of[left])), pa.array(flat[left]), pa.array(uses[left])], names=["key", "code", "uses"])
                continue
            total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            if len(code):
                np.add.at(total[0], of, np.where(hit, uses * n[at], 0))
                np.add.at(total[1], of, np.where(hit & best[at], uses, 0))
            yield pa.RecordBatch.from_arrays([rb.column(0), *map(pa.array, total)], names=["key", "count_sum", "n_best"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Tokens, groups and links of every whole text under both tokenizers, and how common its links are.

    Returns the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is in most documents of all pairs of its A
    id, ties included), ``count_sum`` (documents that hold the pair, summed over links) and ``groups_sha256``. Null and
    empty texts, and texts that either tokenizer does not spell back, have zeros and an empty string. Repeated rows are
    documents of their own and count as such; null ids too. Very long texts are tokenised whole. Other columns are ignored,
    whatever their names. An empty table gives none.
    """
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    laid = written(distinct.mapInArrow(_lay(a_path, b_path), _LAID), f"{path}/laid")
    counts = written(pair_counts(laid, _pair(a_path, b_path).width), f"{path}/counts")
    top = frequent(counts, head).toArrow().sort_by("code")
    links = laid.select("key", "codes", "uses")
    common = links.mapInArrow(_sums(top, False), "key binary, count_sum long, n_best long")
    others = links.mapInArrow(_sums(top, True), "key binary, code long, uses long").join(counts, "code")
    others = others.select("key", (F.col("uses") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("uses")).otherwise(0).alias("n_best"))
    sums = common.unionByName(others).groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    measures = laid.drop("codes", "uses", "copies").join(sums, "key")
    found = rows.select("id", F.unhex(F.sha2("text", 256)).alias("key")).join(measures, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(F.col("id").alias(id_col), *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
