"""Benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are short and documents long, so similarity says little; what counts is the share of
an item's word shingles that a document holds. Items are partitioned by size: a class holds items of
up to 2**k distinct shingles. An item's sketch is its ``m`` smallest shingle hashes, where m follows
from the upper size u of its class: m = u - ceil(t*u) + 1, at most the item's size. A document that holds
at least a share t of an item's shingles misses fewer than m of them, so at least one of the sketch is
among its own: no contaminated document is lost. Every candidate is verified by exact containment of the
item's whole shingle set.

Items and documents are handled alike by Spark jobs. A bit table of a fixed size, of all sketch hashes, goes
to the tasks that read the documents; documents without a hit there are done with. Of the others, only
the shingles that hit a second such table, of all item shingles, are shuffled. For candidates they are joined to as many shingles of
each item as its sketch has, now the rarest among the documents' hits, so a passage that all items and
documents share joins nothing; each candidate is then counted by its item's own shingles. Where benchmarks grow so large that
the tables fill up, more shingles are shuffled and nothing else changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm import text as X
from uttermark.llm.minhash import shingle_sets
from uttermark.llm.work import folder, small, written

SHINGLE, PERCENT = 5, 80
TABLE_BITS = 24  #: the bit tables have 2**24 places, which is 2 MB


def sketch_size(n: int, percent: int) -> int:
    """Size of the sketch of an item with ``n`` distinct shingles, by the upper size of its class."""
    upper = 1 << max(0, math.ceil(math.log2(n)))
    return min(n, upper - math.ceil(percent * upper / 100) + 1)


def short_hash(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of runs of fewer words than a shingle, apart from those of whole texts that are as short."""
    return X.mix(h ^ np.uint64(0x27D4EB2F165667C5 * words & 0xFFFFFFFFFFFFFFFF))


def runs(buf: np.ndarray, off: np.ndarray, shingle: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``shingle`` words, and of those shorter ``lengths`` that items have."""
    h, row, _, _ = X.hashed_words(buf, off)
    found = [X.ngrams(h, row, shingle)[:2]]
    for k in lengths:
        g, at, _ = X.ngrams(h, row, k)
        found.append((short_hash(g, k), at))
    g, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    return g[order], at[order]


def _items(shingle: int, percent: int):
    """(item, text key, text) to (item, item_key, words, size, shingle, sketched): the distinct shingles of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rb in batches:
                data, off = X.buffers(rb.column(2))
                for a, b in X.slices(off):
                    buf, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                    h, row, _, _ = X.hashed_words(buf, at)
                    edge = X.bounds(row, b - a)
                    sets = shingle_sets(buf, at, shingle)
                    for i, own in enumerate(sets):
                        n = int(edge[i + 1] - edge[i])
                        if 0 < n < shingle:
                            own = short_hash(X.ngrams(h[edge[i] : edge[i + 1]], np.zeros(n, np.int64), n)[0], n)
                        if not len(own):
                            continue
                        size = len(own)
                        sketched = np.arange(size) < sketch_size(size, percent)  # sets are sorted by hash
                        cols = [rb.column(k).take(pa.array(np.full(size, a + i))) for k in (0, 1)]
                        cols += [pa.array(np.full(size, x, np.int64)) for x in (min(n, shingle), size)]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(own.view(np.int64)), pa.array(sketched)], names=["item", "item_key", "words", "size", "shingle", "sketched"])

    return run


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A table of 2**TABLE_BITS bits with a bit set for the leading bits of each ``shingle``; at most one row for each word of
    it comes to the driver."""
    place = F.shiftrightunsigned("shingle", 64 - TABLE_BITS)
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(shingle, {64 - TABLE_BITS}) & 63 as int))")).alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << TABLE_BITS - 6, np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _hits(shingle: int, lengths: list[int], sketches: np.ndarray, shingles: np.ndarray):
    """(id, text key, text) to (id, key, shingle): distinct shingles that items may have, of documents that some sketch may meet."""
    shift = np.uint64(64 - TABLE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.unpackbits(sketches).astype(bool), np.unpackbits(shingles).astype(bool)
        with np.errstate(over="ignore"):
            for rb in batches:
                data, off = X.buffers(rb.column(2))
                for a, b in X.slices(off):
                    g, row = runs(data[off[a] : off[b]], off[a : b + 1] - off[a], shingle, lengths)
                    place = g >> shift
                    met = np.zeros(b - a, bool)
                    met[row[first[place]]] = True
                    take = met[row] & second[place]
                    g, row = g[take], row[take]
                    order = np.lexsort((g, row))
                    g, row = g[order], row[order]
                    new = np.ones(len(g), bool)
                    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                    at = pa.array(a + row[new])
                    yield pa.RecordBatch.from_arrays([rb.column(0).take(at), rb.column(1).take(at), pa.array(g[new].view(np.int64))], names=["id", "key", "shingle"])

    return run


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Every (document, item) whose containment reaches ``percent``: ids, ``common``, ``item_shingles``, ``containment``.

    Shingles are runs of ``shingle`` words with A-Z lower-cased; an item of fewer words is one shingle over all its
    words, and every text that holds them in a row matches. Items without a word match nothing, nor do null or empty
    texts. Texts of any length are searched whole. Rows with the same id and text count as one, on either side; rows of
    one id with different texts give a result each. Null ids are ids like any other. Other columns are ignored,
    whatever their names.
    """
    spark, path = docs.sparkSession, folder(docs.sparkSession)
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    if id_col == item_col:
        raise ValueError("documents and items need ids of different names")
    long = T.LongType()

    def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in fields])

    item_text = F.col(item_text_col).cast("string")
    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(item_text).alias("item_key"), item_text.alias("text")).where("text is not null").distinct()
    kinds = schema(("item", item_type), ("item_key", long), ("words", long), ("size", long), ("shingle", long), ("sketched", T.BooleanType()))
    whole = written(items.mapInArrow(_items(shingle, percent), kinds), f"{path}/items")
    lengths = sorted(r["words"] for r in whole.select("words").distinct().where(F.col("words") < shingle).collect())
    packed = [np.packbits(bit_table(x.select("shingle"))) for x in (whole.where("sketched"), whole)]

    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    hits = text.mapInArrow(_hits(shingle, lengths, *packed), schema(("id", id_type), ("key", long), ("shingle", long))).distinct()
    hits = written(hits, f"{path}/hits")
    # any so many shingles of an item will do for a sketch; the rarest among the documents' hits meet the fewest of them
    met = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("met"))
    of = W.partitionBy("item", "item_key")
    rank = F.row_number().over(of.orderBy(F.coalesce("met", F.lit(0)), "shingle"))
    ranked = whole.join(met, "shingle", "left").withColumns({"rank": rank, "most": F.sum(F.col("sketched").cast("int")).over(of)})
    rare = ranked.where((F.col("rank") <= F.col("most")) & F.col("met").isNotNull()).select("item", "item_key", "shingle")
    pair = ["id", "key", "item", "item_key"]
    candidates = written(hits.join(rare, "shingle").select(*pair).distinct(), f"{path}/candidates")
    # each candidate is counted by its item's shingles, so a shingle of many items and many documents makes no product
    same = lambda x, y, *cols: reduce(Column.__and__, (F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in cols))
    each = candidates.alias("c").join(whole.alias("w"), same("c", "w", "item", "item_key")).select(*(F.col(f"c.{c}") for c in pair), "w.size", "w.shingle")
    found = each.alias("e").join(hits.alias("h"), same("e", "h", "id", "key", "shingle")).select(*(F.col(f"e.{c}") for c in pair), "e.size")
    found = found.groupBy(*pair, "size").agg(F.count(F.lit(1)).alias("common"))
    found = found.where(F.col("common") * 100 >= F.col("size") * percent)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "common", F.col("size").alias("item_shingles"), (F.col("common") / F.col("size")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null id are kept."""
    bad = matches(docs, benchmark, id_col=id_col, **options).select(id_col).distinct()
    bad = small(written(bad, f"{folder(docs.sparkSession)}/bad"))
    return docs.join(bad, id_col, "left_anti").select(docs.columns)
