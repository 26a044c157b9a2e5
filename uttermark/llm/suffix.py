"""Removal of repeated byte strings by depth-limited radix sort of suffixes.

Suffixes are ordered through their first ``width`` bytes only; groups of equal suffixes are then exactly
the strings of ``width`` bytes that repeat. Ordering goes digit by digit, the most significant first, and
a group that lies in one document is dropped at once:

- First digit: a gram of ``GRAM`` bytes. Of the grams in a string of ``width`` bytes, the one with the
  smallest hash is its anchor, so equal strings have equal anchors at equal places, and only anchors need
  to be sorted: about two for every ``width - GRAM`` bytes.
- Second digit: the anchor's surroundings, all bytes that a string with this anchor can reach, as a 64-bit
  key, compared only among equal grams. Where a document with a smaller id has the same surroundings, all
  strings through the anchor repeat, and nothing further is sorted. Equal surroundings in a slice of ``SLICE`` bytes are
  merged first, so a very common passage costs one row for each slice of texts that has it. Rows arrive sorted and are taken as they
  come, so an anchor of any number of rows needs no more memory.
- Further digits, for anchors whose surroundings differ: the strings through the anchor are sorted by eight
  bytes at a time until their end, and groups with one document are dropped after each pass.
- An anchor with more than ``HOT_ROWS`` different surroundings, or ``HOT_BYTES`` of them, would be one large group. Its strings are dealt
  out one by one instead, by two 64-bit hashes of their bytes, after each task has merged its own equal ones.

A string that starts in a document with a smaller id is removed from all later ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm import text as X
from uttermark.llm.work import folder, small, written

GRAM = 20
HOT_ROWS = 65_536  #: most different surroundings of an anchor that are sorted together
HOT_BYTES = 1 << 26  #: most bytes of these, which counts for wide strings
SLICE = 1 << 19


def most_rows(width: int, rows: int) -> int:
    """``rows``, or fewer where so many surroundings of strings of ``width`` bytes would be more than ``HOT_BYTES``."""
    return max(1, min(rows, HOT_BYTES // (2 * width - GRAM)))


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest value in every window of ``w`` values."""
    m, span = h.copy(), 1
    while span * 2 <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(h) - w + 1], m[w - span : w - span + len(h) - w + 1])
    return m


def anchors(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and rows of the anchors of all strings of ``width`` bytes inside the rows."""
    none = np.zeros(0, np.int64)
    if len(buf) < width:
        return none, none.astype(np.uint64), none
    n, w = len(buf) - GRAM + 1, width - GRAM + 1
    pw, inv = X.powers(len(buf) + 1)
    pref = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[: len(buf)], out=pref[1:])
    h = X.mix((pref[GRAM:] - pref[:n]) * inv[:n])
    least = _window_min(h, w)  # for every start of a string
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.flatnonzero(row[: len(least)] == row[width - 1 :])
    if not len(start):
        return none, none.astype(np.uint64), none
    # a gram is the anchor of a string if its hash is the least there; all places of equal hash count
    flag = np.zeros(n, bool)
    lo, value = start, least[start]
    change = np.ones(len(start), bool)
    change[1:] = (value[1:] != value[:-1]) | (start[1:] != start[:-1] + 1)
    run = np.flatnonzero(change)
    first, last = lo[run], lo[np.append(run[1:], len(start)) - 1] + w - 1
    best = value[run]
    # places of each run's value: the window of its first string surely holds one; look for all in the run
    size = last - first + 1
    where = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    flag[where[h[where] == np.repeat(best, size)]] = True
    at = np.flatnonzero(flag)
    return at, h[at], row[at]


def _keyed(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``buf``, rows, gram hashes and keys (gram and surroundings) of all anchors."""
    side = width - GRAM
    if len(off) == 2 and len(buf) > 4 * SLICE:  # a very long text, taken in overlapping parts
        parts = []
        for s in range(0, len(buf), SLICE):
            lo, hi = max(0, s - side), min(len(buf), s + SLICE + 2 * width)
            at, _, h, key = _keyed_at(buf[lo:hi], np.array([0, hi - lo]), width)
            mine = (at + lo >= s) & (at + lo < s + SLICE)
            parts.append((at[mine] + lo, h[mine], key[mine]))
        at, h, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        return at, np.zeros(len(at), np.int64), h, key
    return _keyed_at(buf, off, width)


def _keyed_at(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, h, row = anchors(buf, off, width)
    if not len(at):
        return at, row, h, h
    lo, hi = np.maximum(at - (width - GRAM), off[row]), np.minimum(at + width, off[row + 1])
    reach = ((at - lo) * 65536 + (hi - at)).astype(np.uint64)
    return at, row, h, X.mix(h * np.uint64(3) + X.mix(X.span_hashes(buf, lo, hi, X.SAME) + reach))


def _codes(ids: pa.Array) -> np.ndarray:
    """Integers in the order of the ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique(np.array(ids.to_pylist(), dtype=object), return_inverse=True)[1].astype(np.int64)


def _slices(rb: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = X.buffers(rb.column(column))
    for a, b in X.slices(off, SLICE):
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


SHARED, RESOLVED, OPEN = 0, 1, 2


def _first_digits(width: int):
    """(id, text) to (anchor, key, id, kind). Of equal keys in a slice of rows, only the smallest id goes on
    to be compared; all others are resolved, and are dealt out by their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b, buf, off in _slices(rb, 1):
                with np.errstate(over="ignore"):
                    _, row, h, key = _keyed(buf, off, width)
                if not len(row):
                    continue
                ids = rb.column(0).slice(a, b - a)
                code = _codes(ids)[row]
                order = np.lexsort((code, key))
                k, c = key[order], code[order]
                new_key = np.ones(len(k), bool)
                new_key[1:] = k[1:] != k[:-1]
                new_doc = new_key.copy()
                new_doc[1:] |= c[1:] != c[:-1]
                take = order[new_doc]
                kind = np.where(new_key[new_doc], SHARED, RESOLVED).astype(np.int8)
                part = np.where(kind == SHARED, h[take], X.mix(key[take] + code[take].astype(np.uint64)))
                cols = [pa.array(part.view(np.int64)), pa.array(key[take].view(np.int64)), ids.take(pa.array(row[take])), pa.array(kind)]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "key", "id", "kind"])

    return run


def _second_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, key and id to (id, key, kind, anchor): resolved ones, and the first of each key
    where an anchor has several. What a batch must know of the one before is its last row, the least id of that
    row's key, and the first row of that anchor while no second key has been seen."""
    last: tuple[int, int] | None = None
    least = None  # an array of one id
    alone = None  # a row (id, key) of an anchor with one key so far
    for rb in batches:
        if not rb.num_rows:
            continue
        anchor, key, kind = (rb.column(c).to_numpy() for c in ("anchor", "key", "kind"))
        ids = rb.column(rb.schema.get_field_index("id"))
        new_h, new_k = np.ones(len(key), bool), np.ones(len(key), bool)
        new_h[1:] = anchor[1:] != anchor[:-1]
        new_k[1:] = new_h[1:] | (key[1:] != key[:-1])
        goes_on = last is not None and last[0] == anchor[0]
        same_key = goes_on and last[1] == key[0]
        if same_key:
            new_k[0] = False
        # the least id of each row's key, with the one carried over in front
        first = np.maximum.accumulate(np.where(new_k, np.arange(len(key)) + 1, 0))
        known = pa.concat_arrays([least if least is not None else ids.slice(0, 1), ids])
        leasts = known.take(pa.array(first))
        group = np.cumsum(new_h) - 1
        keys = np.bincount(group, weights=new_k)
        several = keys > 1
        if goes_on:
            several[0] = alone is None or keys[0] > 0
        if pa.types.is_integer(ids.type):  # strings of one document need no comparison; an anchor at an edge may have more
            code, begin = ids.to_numpy(), np.flatnonzero(new_h)
            inner = np.minimum.reduceat(code, begin) != np.maximum.reduceat(code, begin)
            inner[[0, -1]] = True
            several &= inner
        resolved = (kind == RESOLVED) | pc.not_equal(ids, leasts).to_numpy(zero_copy_only=False)
        still = new_k & several[group] & (kind == SHARED)
        out = [(ids.filter(pa.array(x)), key[x], np.full(x.sum(), k, np.int8), anchor[x]) for x, k in ((resolved, RESOLVED), (still, OPEN))]
        if goes_on and alone is not None and several[0]:
            out.append((alone[0], alone[1], np.array([OPEN], np.int8), anchor[:1]))
        # the anchor that the batch ends with
        end = np.flatnonzero(new_k & (group == group[-1]))
        begun_here = not (goes_on and group[-1] == 0)
        if kind[-1] == RESOLVED or several[-1] and (begun_here or keys[0] > 0 or alone is None):
            alone = None
        elif begun_here:
            alone = (ids.slice(int(end[0]), 1), key[end[:1]])
        last, least = (int(anchor[-1]), int(key[-1])), leasts.slice(len(key) - 1, 1)
        parts = [x for x in out if len(x[0])]
        if parts:
            cols = [pa.concat_arrays([x[0] for x in parts]), *(pa.array(np.concatenate([x[i] for x in parts])) for i in (1, 2))]
            cols.append(pa.array(np.concatenate([x[3] for x in parts]), mask=cols[2].to_numpy() == RESOLVED))  # needed of open ones alone
            yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "kind", "anchor"])


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows, sorted by anchor, that hold all rows of each of their anchors."""
    held: list[pa.RecordBatch] = []
    n = 0
    for rb in batches:
        held.append(rb)
        n += rb.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            anchor = table["anchor"].to_numpy()
            other = np.flatnonzero(anchor != anchor[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            n = len(table) - cut
    if n:
        yield pa.Table.from_batches(held)


def _surroundings(width: int):
    """(id, text, keys) to (anchor, key, id, left, bytes) of the anchors with these keys."""
    side = width - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b, buf, off in _slices(rb, 1):
                with np.errstate(over="ignore"):
                    at, row, h, key = _keyed(buf, off, width)
                out: list[np.ndarray] = []
                edge = X.bounds(row, b - a)
                for i in range(b - a):
                    mine = np.arange(edge[i], edge[i + 1])
                    wanted = np.asarray(rb.column(2)[a + i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                    mine = mine[np.isin(key[mine], wanted)]
                    out.append(mine[np.unique(key[mine], return_index=True)[1]])
                take = np.concatenate(out)
                if not len(take):
                    continue
                lo, hi = np.maximum(at[take] - side, off[row[take]]), np.minimum(at[take] + width, off[row[take] + 1])
                raw = [buf[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                cols = [pa.array(h[take].view(np.int64)), pa.array(key[take].view(np.int64)), rb.column(0).slice(a, b - a).take(pa.array(row[take]))]
                cols += [pa.array((at[take] - lo).astype(np.int32)), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "key", "id", "left", "bytes"])

    return run


def radix_groups(start: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and group numbers of rows that share their start group and all digits with another row.

    One pass for each digit, the most significant first; groups of one row are dropped after each."""
    rows, group = np.arange(len(start)), start
    for d in range(-1, digits.shape[1]):
        if not len(rows):
            break
        if d >= 0:
            digit = digits[rows, d]
            order = np.lexsort((digit, group))
            rows, group, digit = rows[order], group[order], digit[order]
        else:
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            digit = np.zeros(len(rows), np.uint64)
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1
        rows, group = rows[keep], number[keep]
    return rows, group


def _last_digits(width: int, most: int):
    """All surroundings of some anchors to (id, key, range): which strings through the anchor repeat."""
    side, w = width - GRAM, width - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, most):
            yield repeated(table)

    def repeated(table: pa.Table) -> pa.RecordBatch:
        n = len(table)
        anchor, key, left = (table[c].to_numpy() for c in ("anchor", "key", "left"))
        ids = table["id"].combine_chunks()
        code = _codes(ids)
        _, start = np.unique(anchor, return_inverse=True)
        raw = table["bytes"].combine_chunks()
        size = np.array([len(x.as_buffer()) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        around = np.zeros((n, side + width), np.uint8)
        r = np.repeat(np.arange(n), size)
        around[r, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(side - left, size)] = flat
        right = size - left
        repeats = np.zeros((n, w), bool)
        full = -(-width // 8) * 8
        for o in range(w):
            valid = np.flatnonzero((left >= o) & (right >= width - o))
            string = np.zeros((len(valid), full), np.uint8)
            string[:, :width] = around[valid, side - o : side - o + width]
            rows, group = radix_groups(start[valid], string.view(">u8").astype(np.uint64))
            if len(rows):
                c = code[valid[rows]]
                begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                least = np.minimum.reduceat(c, begin)[np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))]
                repeats[valid[rows[c > least]], o] = True
        hit = np.flatnonzero(repeats.any(1))
        edge = np.diff(np.pad(repeats[hit].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r1, first = np.nonzero(edge == 1)
        _, past = np.nonzero(edge == -1)
        take = hit[r1]
        ranges = (first << 16 | (past - 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(take)), pa.array(key[take]), pa.array(ranges)], names=["id", "key", "range"])

    return run


def _hot_strings(width: int):
    """(id, text, keys) to (one, two, id, key, range, settled): every string through the anchors with these keys, by two
    hashes. Of equal strings in a slice of rows, only the smallest id's is still to be settled."""
    w = width - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b, buf, off in _slices(rb, 1):
                with np.errstate(over="ignore"):
                    at, row, _, key = _keyed(buf, off, width)
                    edge = X.bounds(row, b - a)
                    mine = []
                    for i in range(b - a):
                        wanted = rb.column(2)[a + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                        mine.append(edge[i] + np.flatnonzero(np.isin(key[edge[i] : edge[i + 1]], wanted)))
                    take = np.repeat(np.concatenate(mine), w)
                    back = np.tile(np.arange(w), len(take) // w)
                    begin = at[take] - back
                    inside = (begin >= off[row[take]]) & (begin + width <= off[row[take] + 1])
                    take, back, begin = take[inside], back[inside], begin[inside]
                    if not len(take):
                        continue
                    one = X.span_hashes(buf, begin, begin + width, X.SAME)
                    two = X.span_hashes(buf, begin, begin + width, _TURNED)
                ids = rb.column(0).slice(a, b - a)
                code = _codes(ids)[row[take]]
                order = np.lexsort((back, key[take], code, two, one))
                take, back, one, two, code = take[order], back[order], one[order], two[order], code[order]
                new = np.ones(len(take), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                least = code[np.flatnonzero(new)[np.cumsum(new) - 1]]
                cols = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), ids.take(pa.array(row[take])), pa.array(key[take].view(np.int64))]
                cols += [pa.array((back << 16 | back).astype(np.int32)), pa.array(code > least)]
                yield pa.RecordBatch.from_arrays(cols, names=["one", "two", "id", "key", "range", "settled"])

    return run


_TURNED = np.array([(x * 167 + 41) % 256 for x in range(256)], np.uint8)  #: another alphabet, for another hash


def _cut(width: int, names: list[str], as_text: bool):
    """(id, text, keys, ranges, other columns) to the text's bytes left and the removed runs."""
    side = width - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows_kept: list[bytes] = []
            starts: list[np.ndarray] = []
            ends: list[np.ndarray] = []
            for a, b, buf, off in _slices(rb, 1):
                marks = np.zeros(len(buf) + 1, np.int32)
                some = rb.column(2).slice(a, b - a)
                if some.null_count < b - a:
                    with np.errstate(over="ignore"):
                        at, row, _, key = _keyed(buf, off, width)
                    edge = X.bounds(row, b - a)
                    for i in range(b - a):
                        if not some[i].is_valid:
                            continue
                        wanted = some[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                        ranges = rb.column(3)[a + i].values.to_numpy(zero_copy_only=False)
                        order = np.argsort(wanted, kind="stable")
                        wanted, ranges = wanted[order], ranges[order]
                        mine = slice(edge[i], edge[i + 1])
                        lo, hi = np.searchsorted(wanted, key[mine]), np.searchsorted(wanted, key[mine], side="right")
                        n = hi - lo
                        where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        p, r = np.repeat(at[mine], n), ranges[where]
                        # strings start at p - o for o from the range's first to its last; all lie in the text
                        begin = np.maximum(p - (r & 0xFFFF), off[i])
                        end = np.minimum(p - (r >> 16) + width, off[i + 1])
                        np.add.at(marks, begin, 1)
                        np.add.at(marks, end, -1)
                gone = np.cumsum(marks)[: len(buf)] > 0
                for i in range(b - a):
                    g = gone[off[i] : off[i + 1]]
                    s, e = _spans(g)
                    starts.append(s)
                    ends.append(e)
                    rows_kept.append(buf[off[i] : off[i + 1]][~g].tobytes() if len(s) else buf[off[i] : off[i + 1]].tobytes())
            n = pa.array(np.diff(X.buffers(rb.column(1))[1]))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
            if as_text:
                left = pa.array([x.decode("utf-8", "ignore") for x in rows_kept], pa.string())
            else:
                left = pa.array(rows_kept, pa.binary())
            yield pa.RecordBatch.from_arrays([rb.column(0), n, *lists, left, *rb.columns[4:]], names=names)

    return run


def _spans(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, as_text: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Remove every byte covered by a string of ``width`` bytes that also starts in a row with a smaller id.

    Returns the id, ``n_bytes``, ``starts`` and ``ends`` of the removed runs, ``kept`` and the columns
    in ``keep``. ``kept`` holds the bytes left, or with ``as_text`` the characters of which all bytes are left.
    Strings are judged on the input and never cross rows; a null text is empty. Texts of any length are cut whole.
    Rows of one id do not remove each other's strings. Rows with a null id stay whole and remove nothing.
    Other columns are ignored. An empty table gives no rows. ``width`` is from 24 to 4000.
    """
    if not 24 <= width <= 4000:
        raise ValueError("width must be from 24 to 4000")
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    hot_rows = most_rows(width, HOT_ROWS) if hot_rows is None else hot_rows
    extra = keep or []
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"x_{c}") for c in extra))
    known = rows.where("id is not null").select("id", "text")

    def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in fields])

    long, byte, integer = T.LongType(), T.ByteType(), T.IntegerType()
    first = known.mapInArrow(_first_digits(width), schema(("anchor", long), ("key", long), ("id", id_type), ("kind", byte)))
    first = first.repartition("anchor").sortWithinPartitions("anchor", "key", "id")
    found = written(first.mapInArrow(_second_digits, schema(("id", id_type), ("key", long), ("kind", byte), ("anchor", long))), f"{path}/found")
    unsettled = found.where(F.col("kind") == OPEN)
    hot = unsettled.groupBy("anchor").agg(F.countDistinct("key").alias("n")).where(F.col("n") > hot_rows).select("anchor")
    hot = written(hot, f"{path}/hot")
    settled = [found.where(F.col("kind") == RESOLVED).select("id", "key", F.lit(width - GRAM).alias("range"))]

    def with_keys(rows: DataFrame) -> DataFrame:
        return known.join(rows.groupBy("id").agg(F.collect_set("key").alias("keys")), "id").select("id", "text", "keys")

    if not hot.isEmpty():
        hot = small(hot)
        kinds = schema(("one", long), ("two", long), ("id", id_type), ("key", long), ("range", integer), ("settled", T.BooleanType()))
        dealt = written(with_keys(unsettled.join(hot, "anchor", "left_semi")).mapInArrow(_hot_strings(width), kinds), f"{path}/hot-strings")
        least = dealt.where("not settled").groupBy("one", "two").agg(F.min("id").alias("least"))
        later = dealt.where("not settled").join(least, ["one", "two"]).where("id <> least")
        settled += [x.select("id", "key", "range") for x in (dealt.where("settled"), later)]
        unsettled = unsettled.join(hot, "anchor", "left_anti")
    around = with_keys(unsettled).mapInArrow(_surroundings(width), schema(("anchor", long), ("key", long), ("id", id_type), ("left", integer), ("bytes", T.BinaryType())))
    around = around.repartition("anchor").sortWithinPartitions("anchor")
    settled.append(around.mapInArrow(_last_digits(width, most_rows(width, 50_000)), schema(("id", id_type), ("key", long), ("range", integer))))
    strings = written(reduce(DataFrame.unionByName, settled), f"{path}/strings")
    lists = strings.groupBy("id").agg(F.collect_list(F.struct("key", "range")).alias("l")).select("id", "l.key", "l.range")
    joined = rows.join(lists, "id", "left").select("id", "text", "key", "range", *(f"x_{c}" for c in extra))
    out = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("n_bytes", long),
            T.StructField("starts", T.ArrayType(long)),
            T.StructField("ends", T.ArrayType(long)),
            T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
            *(docs.schema[c] for c in extra),
        ]
    )
    return joined.mapInArrow(_cut(width, out.names, as_text), out)

