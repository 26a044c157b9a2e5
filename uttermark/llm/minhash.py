"""Near-duplicate components by b-bit MinHash, confirmed on full shingle sets.

1. Each text becomes its set of word shingles (64-bit hashes), the minima of 256 hash functions,
   28 band keys of four minima, and a signature of the two low bits of each minimum.
2. Texts with equal sets form a class; from here on, one node stands for it.
3. Nodes that share a band key are candidates. Inside each bucket their packed signatures are compared by
   bit counts: with a share m of equal two-bit values, the similarity is about (m - 1/4) / (1 - 1/4). A pair
   stays a candidate unless its estimate is so low that a true link has it no more often than the bands
   miss one (``candidate_bound``). Connected candidates form a family; every link lies within one.
4. Each node's text goes to its family once, and the family's members are compared on their full sets.

Steps 3 and 4 compare groups of nodes, and neither emits pairs: a search from node to node, over the
nodes not reached yet, gives only the links of a spanning forest. A group beyond a fixed size is dealt into
blocks, each with a copy of one centre; the few members that the blocks leave outside the group's
largest component then meet all blocks as a query set. So memory has a bound and nothing is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm import text as X
from uttermark.llm.graph import components
from uttermark.llm.work import folder, small, written

BANDS, ROWS, LOW_BITS = 28, 4, 2
MINIMA = 256  #: the first BANDS * ROWS give the band keys, all of them the signature
WORDS = MINIMA * LOW_BITS // 64
BLOCK_ROWS = 4096  #: most signatures compared in one block
BLOCK_SHINGLES = 2_000_000  #: most shingles of the sets compared in one block, but for a text that has more


def candidate_bound(percent: int) -> float:
    """The estimate that a pair at the threshold falls short of no more often than the bands miss it
    (at thresholds below 0.8: than they miss one at 0.8). The count of equal values is binomial."""
    s = percent / 100
    p = s + (1 - s) / 2**LOW_BITS
    chance = (1 - max(s, 0.8) ** ROWS) ** BANDS
    equal, short = 0, (1 - p) ** MINIMA
    while equal < MINIMA and short <= chance:
        equal += 1
        short += comb(MINIMA, equal) * p**equal * (1 - p) ** (MINIMA - equal)
    return (equal / MINIMA - 1 / 2**LOW_BITS) / (1 - 1 / 2**LOW_BITS)


def _multipliers() -> np.ndarray:
    return X.mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row. A row with fewer than ``n`` words but at least
    one has the whole sequence as its only shingle; a row without words has none."""
    h, row, _, _ = X.hashed_words(buf, off)
    rows = len(off) - 1
    g, grow, _ = X.ngrams(h, row, n)
    at, words = X.bounds(grow, rows), X.bounds(row, rows)
    out = []
    for i in range(rows):
        if at[i] < at[i + 1]:
            x = np.sort(g[at[i] : at[i + 1]])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif words[i] < words[i + 1]:
            whole = np.uint64(0x5851F42D4C957F2D)
            for x in h[words[i] : words[i + 1]]:
                whole = X.mix(np.array([whole * np.uint64(0x9FB21C651E98DF25 & 0xFFFFFFFF) ^ x]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minima (set x hash function) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.empty((len(sets), MINIMA), np.uint64)
    with np.errstate(over="ignore"):
        for j, m in enumerate(_multipliers()):
            out[:, j] = np.minimum.reduceat(flat * m, at)
    return out


def set_keys(sets: list[np.ndarray]) -> list[bytes]:
    """128-bit keys of non-empty sets."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    flat = np.concatenate(sets)
    one, two = np.add.reduceat(X.mix(flat), at), np.add.reduceat(X.mix(flat ^ np.uint64(0x2545F4914F6CDD1D)), at)
    return [x.tobytes() for x in np.stack([one, two], 1)]


def _sketch(shingle: int):
    names = ["id", "n", "set_key", "bands", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rb in batches:
                data, off = X.buffers(rb.column(1))
                for a, b in X.slices(off):
                    sets = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], shingle)
                    n = np.array([len(x) for x in sets], np.int64)
                    full = np.flatnonzero(n)
                    keys: list[bytes | None] = [None] * len(sets)
                    bands: list[np.ndarray | None] = [None] * len(sets)
                    sig: list[bytes | None] = [None] * len(sets)
                    if len(full):
                        filled = [sets[i] for i in full]
                        m = X.mix(_minima(filled))
                        key = X.mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :].repeat(len(full), 0)
                        for r in range(ROWS):
                            key = X.mix(key * np.uint64(0x9FB21C651E98DF25) + m[:, r : BANDS * ROWS : ROWS])
                        low = m & np.uint64((1 << LOW_BITS) - 1)
                        each = MINIMA // WORDS
                        shifts = np.arange(each, dtype=np.uint64) * np.uint64(LOW_BITS)
                        packed = np.stack([np.bitwise_or.reduce(low[:, w * each : (w + 1) * each] << shifts, axis=1) for w in range(WORDS)], 1)
                        for k, (i, own) in enumerate(zip(full.tolist(), set_keys(filled), strict=True)):
                            keys[i], bands[i], sig[i] = own, key[k].view(np.int64), packed[k].tobytes()
                    cols = [rb.column(0).slice(a, b - a), pa.array(n), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def estimates(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures, from bit counts."""
    x = sig ^ other
    x = (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)
    chance = 1 / 2**LOW_BITS
    return (1 - np.bitwise_count(x).sum(-1, dtype=np.int64) / MINIMA - chance) / (1 - chance)


class Members:
    """Nodes of one block: which of them are near, by signature and, with ``sets``, by full sets."""

    def __init__(self, n: np.ndarray, sig: np.ndarray, percent: int, bound: float, sets: list[np.ndarray] | None = None):
        self.n, self.sig, self.percent, self.bound, self.flat = n, sig, percent, bound, None
        if sets is not None:
            flat = np.concatenate(sets)
            values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
            several = count > 1  # a shingle of one set is in no intersection
            keep = several[place]
            self.flat = (np.cumsum(several) - 1)[place[keep]]
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[keep]
            self.at = np.searchsorted(owner, np.arange(len(sets) + 1))
            self.mark = np.zeros(int(several.sum()) + 1, bool)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are linked with member ``i``."""
        n = self.n[others]
        hit = (np.minimum(n, self.n[i]) * 100 >= np.maximum(n, self.n[i]) * self.percent) & (estimates(self.sig[others], self.sig[i]) >= self.bound)
        if self.flat is None or not hit.any():
            return hit
        some = np.flatnonzero(hit)
        begin, size = self.at[others[some]], self.at[others[some] + 1] - self.at[others[some]]
        mine = self.flat[self.at[i] : self.at[i + 1]]
        self.mark[mine] = True
        end = np.cumsum(size)
        shared = self.mark[self.flat[np.arange(end[-1]) + np.repeat(begin - (end - size), size)]]
        self.mark[mine] = False
        total = np.concatenate([[0], np.cumsum(shared)])
        common = total[end] - total[end - size]
        hit[some] = common * 100 >= (n[some] + self.n[i] - common) * self.percent
        return hit


def forest(members: Members) -> list[tuple[int, int]]:
    """Links of a spanning forest over all members: each member reached looks for those not reached yet."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(members.n))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = members.near(i, left)
            if hit.any():
                found = left[hit].tolist()
                out += [(i, j) for j in found]
                queue += found
                left = left[~hit]
    return out


def crossings(members: Members, query: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links of the queried members with members of other labels; one link for any two labels is enough."""
    out: list[tuple[int, int]] = []
    label = label.copy()
    for i in np.flatnonzero(query).tolist():
        others = np.flatnonzero(label != label[i])
        if len(others):
            for j in others[members.near(i, others)].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], shingle: int | None) -> Iterator[tuple[pa.Table, list[np.ndarray] | None]]:
    """The rows of each block (group, i, j); blocks come one after the other. With ``shingle``, texts become sets as they arrive, and
    only these are held, so a block's memory has the bound of its sets, however long or repetitive its texts are."""
    held: list[pa.Table] = []
    sets: list[np.ndarray] = []
    seen: set = set()
    last = None

    def block() -> tuple[pa.Table, list[np.ndarray] | None]:
        return pa.concat_tables(held), None if shingle is None else list(sets)

    for rb in batches:
        if not rb.num_rows:
            continue
        key = np.stack([rb.column(c).to_numpy() for c in ("group", "i", "j")])
        edge = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [rb.num_rows]])
        for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            this = tuple(key[:, a].tolist())
            if held and this != last:
                yield block()
                held.clear()
                sets.clear()
                seen.clear()
            part = pa.Table.from_batches([rb.slice(a, b - a)])
            if shingle is not None:
                part, own = _with_sets(part, shingle, seen)
                sets += own
            held.append(part)
            last = this
    if held:
        yield block()


def _linked(percent: int, bound: float, shingle: int | None):
    """Rows (group, i, j, query, label, node, n, sig[, set_key, text]) of whole blocks to links (a, b). A block of the
    first pass has no labels; all its rows are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            cols = [pa.array(np.concatenate(x)) for x in (a, b)]
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays(cols, names=["a", "b"])

        with np.errstate(over="ignore"):
            for table, sets in _blocks(batches, shingle):
                if table.num_rows < 2:
                    continue
                node, n = table["node"].to_numpy(), table["n"].to_numpy()
                sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint64).reshape(-1, WORDS)
                members = Members(n, sig, percent, bound, sets)
                if table["label"].null_count:
                    found = forest(members)
                else:
                    found = crossings(members, table["query"].to_numpy(), table["label"].to_numpy())
                if found:
                    pairs = node[np.array(found)]
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
                    held += len(found)
                if held > 50_000:
                    yield out()
                    held = 0
        if a:
            yield out()

    return run


def _with_sets(table: pa.Table, shingle: int, seen: set) -> tuple[pa.Table, list[np.ndarray]]:
    """One row for each node and role that was not ``seen``, with the set of its text; where an id has several texts, the node's own
    is taken. Texts go."""
    data, off = X.buffers(table["text"])
    sets: list[np.ndarray] = []
    for a, b in X.slices(off):
        sets += shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], shingle)
    filled = [i for i, x in enumerate(sets) if len(x)]
    own = dict(zip(filled, set_keys([sets[i] for i in filled]), strict=True)) if filled else {}
    take: list[int] = []
    for i, (node, key, query) in enumerate(zip(table["node"].to_pylist(), table["set_key"].to_pylist(), table["query"].to_pylist(), strict=True)):
        if own.get(i) == key and (node, query) not in seen:
            seen.add((node, query))
            take.append(i)
    return table.select(["node", "n", "sig", "query", "label"]).take(pa.array(take, pa.int64())), [sets[i] for i in take]


def links(members: DataFrame, weight: str, limit: int, attach: Callable[[DataFrame], DataFrame], compare, path: str) -> DataFrame:
    """Links (``a``, ``b``) that connect all that is linked within the groups of ``members`` (``group``, ``node``, ``weight``).

    ``attach`` adds to rows with a node what ``compare`` needs. Groups of a weight up to ``limit`` are one block.
    """
    node_type = members.schema["node"].dataType
    schema = T.StructType([T.StructField("a", node_type), T.StructField("b", node_type)])

    def compared(blocks: DataFrame, name: str) -> DataFrame:
        rows = attach(blocks.select("group", "i", "j", "query", "label", "node"))
        rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
        return written(rows.mapInArrow(compare, schema).distinct(), f"{path}/{name}")

    def part(parts: str | Column) -> Column:
        return F.pmod(F.xxhash64("node"), parts)

    def every(parts: str | Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(parts) - 1 if isinstance(parts, str) else parts - 1)

    blocks_for = lambda w: F.greatest(F.ceil(w / F.lit(limit)), F.lit(1)).cast("long")
    sizes = members.groupBy("group").agg(blocks_for(F.sum(weight)).alias("parts"), F.min("node").alias("low"))
    large = sizes.where("parts > 1")
    zero = F.lit(0).cast("long")
    plain = lambda i: [i.alias("i"), zero.alias("j"), F.lit(False).alias("query"), F.lit(None).cast(node_type).alias("label"), F.col("node")]
    if large.isEmpty():
        return compared(members.select("group", *plain(zero)), "all")
    dealt = members.join(sizes, "group")
    at = F.when(F.col("node") == F.col("low"), every("parts")).otherwise(F.array(part(F.col("parts"))))
    dealt = dealt.withColumn("at", F.explode(at)).select("group", *plain(F.col("at")))
    first = compared(dealt, "all")
    # what a large group's blocks leave outside its largest component is a query set against all of the group
    labels = components(first, f"{path}/c")
    inside = members.join(large, "group").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    inside = written(inside.select("group", "node", "label", "parts", weight), f"{path}/large")
    each = inside.groupBy("group", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("w"))
    main = each.groupBy("group").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), (F.sum("w") - F.max_by("w", F.struct("rows", "label"))).alias("w"), F.count(F.lit(1)).alias("labels"))
    main = main.where("labels > 1").select("group", "main", blocks_for(F.col("w")).alias("queries"))
    inside = inside.join(main, "group")
    query = inside.where("label <> main").select("group", part(F.col("queries")).alias("i"), F.explode(every("parts")).alias("j"), F.lit(True).alias("query"), "label", "node")
    other = inside.select("group", F.explode(every("queries")).alias("i"), part(F.col("parts")).alias("j"), F.lit(False).alias("query"), "label", "node")
    return first.unionByName(compared(query.unionByName(other), "rest"))


def components_of(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """The near-duplicate component of every row: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked when ``100 * common >= percent * united`` of their distinct shingles of
    ``shingle`` words (A-Z lower-cased). ``component_id`` is the smallest id reachable, itself
    included, and ``kept`` marks it. A text of fewer words is one shingle; a null, empty or blank
    text has none and is linked with nothing. Rows of one id count as one document. A row with a
    null id is linked with nothing, has a null component and is kept. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType
    fields = {"id": kind, "n": T.LongType(), "set_key": T.BinaryType(), "bands": T.ArrayType(T.LongType()), "sig": T.BinaryType()}
    schema = T.StructType([T.StructField(k, v) for k, v in fields.items()])
    sketches = written(docs.mapInArrow(_sketch(shingle), schema), f"{path}/sketches")
    full = sketches.where("n > 0 and id is not null")
    alike = [F.first(c).alias(c) for c in ("n", "bands", "sig")]
    nodes = full.groupBy("set_key").agg(F.min("id").alias("least"), *alike)
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), f"{path}/nodes")  # numbers hold once written
    bound = candidate_bound(percent) - 1e-9

    # signatures, inside the buckets that several nodes share
    keyed = nodes.select("node", F.explode("bands").alias("group"))
    shared = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    buckets = written(keyed.join(shared, "group"), f"{path}/buckets").withColumn("one", F.lit(1))
    signed = nodes.select("node", "n", "sig")
    candidates = links(buckets, "one", block_rows, lambda x: x.join(signed, "node"), _linked(percent, bound, None), f"{path}/a")
    families = components(candidates, f"{path}/families").withColumnRenamed("component", "group")

    # full sets, inside the families
    members = written(families.join(nodes.drop("bands"), "node"), f"{path}/members")
    narrow = members.select("group", "node", "n")

    def with_text(blocks: DataFrame) -> DataFrame:
        rows = small(blocks.join(members.select("node", "n", "sig", "set_key", "least"), "node"))
        cols = ["group", "i", "j", "query", "label", "node", "n", "sig", "set_key", "text"]
        return docs.join(rows, F.col("id") == F.col("least")).select(cols)

    found = links(narrow, "n", block_shingles, with_text, _linked(percent, bound, shingle), f"{path}/b")
    rows = sketches.select("id", "n", "set_key")
    unique = _unique(sketches)
    if not unique:  # the texts of one id are one document
        of = rows.where("n > 0 and id is not null").join(nodes.select("set_key", "node"), "set_key")
        same = of.groupBy("id").agg(F.min("node").alias("a"))
        found = found.unionByName(of.join(same, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct())
    labels = components(found, f"{path}/c")
    placed = nodes.select("set_key", "node", "least").join(labels, "node", "left").withColumn("root", F.coalesce("component", "node"))
    roots = placed.where("component is not null").groupBy("root").agg(F.min("least").alias("smallest"))
    placed = placed.join(roots, "root", "left").select("set_key", F.coalesce("smallest", "least").alias("component"))
    out = rows.join(placed, "set_key", "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    if not unique:
        least = out.where("id is not null").groupBy(F.col("id").alias("of")).agg(F.min("component").alias("least"))
        out = out.join(least, F.col("id") == F.col("of"), "left").withColumn("component", F.col("least"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col(id_col) == F.col("component_id")))


def _unique(sketches: DataFrame) -> bool:
    return sketches.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
