"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids (its tokens, then one separator id) are cut into whole windows and a rest. A
whole window is a sequence by itself. The rests, cut into short pieces, are gathered into
blocks of ``block_pieces`` pieces; each block is divided into the fewest windows that can hold
its ids. Differencing starts from one partial partition for each piece and always merges the
two of the largest spread, the fullest windows of one onto the emptiest of the other, so that
imbalances cancel. While some window exceeds the capacity, the block is divided again with one
window more.

Blocks never leave their task, so there is no shuffle and a lost task is redone alone.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TOKENIZERS: dict[str, TextTokenizer] = {}


def karmarkar_karp(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of each piece, with sums as equal as differencing makes them."""
    m = len(sizes)
    window = np.zeros(m, np.int64)
    if m == 0 or k == 1:
        return window
    left, right = np.full(2 * m * k, -1, np.int32), np.full(2 * m * k, -1, np.int32)
    nodes = m
    heap = []
    for i, x in enumerate(sizes.tolist()):
        sums, tree = np.zeros(k, np.int64), np.full(k, -1, np.int32)
        sums[-1], tree[-1] = x, i
        heap.append((-x, i, sums, tree))
    heapq.heapify(heap)
    tie = m
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        sums, tb = a + b[::-1], tb[::-1]
        both = np.flatnonzero((ta >= 0) & (tb >= 0))
        tree = np.maximum(ta, tb)
        made = np.arange(nodes, nodes + len(both), dtype=np.int32)
        left[made], right[made], tree[both] = ta[both], tb[both], made
        nodes += len(both)
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), tie, sums, tree[order]))
        tie += 1
    for w, top in enumerate(heap[0][3].tolist()):
        stack = [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < m:
                window[x] = w
            else:
                stack += (int(left[x]), int(right[x]))
    return window


def divide(sizes: np.ndarray, capacity: int, surplus: int = 0) -> np.ndarray:
    """Window of each piece, none above ``capacity``.

    The window count starts ``surplus`` above the least possible and rises by growing steps while some window
    exceeds the capacity. Then smaller counts are tried, down to one above the last that failed.
    """

    def fitting(k: int) -> np.ndarray | None:
        window = karmarkar_karp(sizes, k)
        return window if np.bincount(window, weights=sizes, minlength=k).max() <= capacity else None

    least = max(1, -(-int(sizes.sum()) // capacity))
    low, high, step = least - 1, least + surplus, 1
    while (best := fitting(high)) is None:
        low, high, step = high, high + step, 2 * step
    step = 1
    while high - low > 1:
        k = max(low + 1, high - step)
        window = fitting(k)
        if window is None:
            low, step = k, max(1, (high - k) // 2)
        else:
            best, high, step = window, k, 2 * step
    return best


class TextTokenizer:
    """Ids of whole texts from a tokenizer file.

    Where the file is a byte-level BPE whose ids are in the order of its merges, tiktoken merges by the same
    vocabulary in less time. It takes a text if both libraries give the same ids for a probe of each
    character in it, which shows that both put the character into the same class of pre-tokens, and if the text
    holds no added token. All other texts go through the tokenizers library itself.
    """

    #: the file's pre-tokens: contractions, letters, digits and signs with the space before them, white space
    PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.merge = self._merger(spec)
        self.alike: dict[str, bool] = {}
        self.plain = self.merge is not None and all(self._alike(chr(i)) for i in range(128))

    def _merger(self, spec: dict):
        """tiktoken merges by id, which is right where ids are in the order of the merges."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model.get("merges", [])]
        ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
        known = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        if not known or not ids or min(ids) < 256 or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            return None
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
        return tiktoken.Encoding("file", pat_str=self.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _alike(self, c: str) -> bool:
        found = self.alike.get(c)
        if found is None:
            probe = f"a{c}b {c}1{c} {c}{c}  {c}\n{c}!{c}'s{c} '{c} "
            found = self.alike[c] = np.array_equal(self._library(probe), self.merge.encode_to_numpy(probe, disallowed_special=()))
        return found

    def ids(self, text: str) -> np.ndarray:
        if self.plain and not any(x in text for x in self.added) and (text.isascii() or all(map(self._alike, set(text)))):
            return self.merge.encode_to_numpy(text, disallowed_special=())
        return self._library(text)


def _tokenizer(path: str) -> TextTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TextTokenizer(path)
    return _TOKENIZERS[path]


def cut(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """Start and length of the whole windows of ``n`` ids, then of equal pieces of the rest."""
    whole, rest = divmod(n, capacity)
    out = [(i * capacity, capacity) for i in range(whole)]
    if rest:
        parts = -(-rest // piece)
        ends = [whole * capacity + rest * i // parts for i in range(parts + 1)]
        out += [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    separator: int = 0,
    piece_tokens: int = 256,
    block_pieces: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document's ids into sequences of at most ``capacity``.

    Returns a row for each piece: the document's id, ``start`` and ``length`` of the piece in
    the document's ids, ``ids`` (little-endian unsigned 32-bit ids as binary), ``doc_tokens``,
    ``sequence_id`` (task number and count inside the task) and ``offset`` in the sequence.

    A null or empty text is the separator alone. Repeated rows and repeated or null ids are
    packed row by row. Of pieces of equal length, the one that comes first in its block is merged first. Other columns of ``docs`` are ignored, whatever their names. An empty
    table gives no rows. Input rows must come in the same order when a task is redone, as they
    do from files.
    """
    field = docs.schema[id_col]
    schema = T.StructType(
        [
            T.StructField(id_col, field.dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        made = surplus = 0
        ids_type = None
        out: list[list] = [[] for _ in range(7)]
        block: list[tuple] = []
        size = 0

        def emit(pieces):
            nonlocal size
            for row in pieces:
                for to, x in zip(out, row, strict=True):
                    to.append(x)
                size += row[2]

        def flush_block():
            nonlocal made, block, surplus
            if not block:
                return
            sizes = np.fromiter((x[2] for x in block), np.int64, len(block))
            window = divide(sizes, capacity, surplus)
            fill = [0] * (int(window.max()) + 1)
            surplus = len(fill) - max(1, -(-int(sizes.sum()) // capacity))  # where the next block's count starts
            for x, w in zip(block, window.tolist(), strict=True):
                emit([(*x, base + made + w, fill[w])])
                fill[w] += x[2]
            made += len(fill)
            block = []

        def batch():
            nonlocal out, size
            kinds = [ids_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            out, size = [[] for _ in range(7)], 0
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        stop = np.array([separator], "<u4").tobytes()
        for rb in batches:
            ids_type = rb.column(0).type
            for doc, text in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                text = text.as_py()
                raw = (tok.ids(text).astype("<u4").tobytes() if text else b"") + stop
                n = len(raw) // 4
                for start, length in cut(n, capacity, piece_tokens):
                    row = (doc, start, length, raw[4 * start : 4 * (start + length)], n)
                    if length == capacity:
                        emit([(*row, base + made, 0)])
                        made += 1
                    else:
                        block.append(row)
                if len(block) >= block_pieces:
                    flush_block()
                if size >= 1 << 20:
                    yield batch()
        flush_block()
        if size:
            yield batch()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
