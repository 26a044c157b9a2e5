"""Error chunks of transcripts: alignment, classes, positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.functions import alignment
from uttermark.functions.params import STOPWORDS
from uttermark.functions.phonetic import double_metaphone

MOST_CODED = 1_000_000  #: words whose codes a task remembers

# Words that count as numbers.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy",
    "eighty", "ninety", "hundred", "thousand", "million", "billion",
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
    "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth",
    "eighteenth", "nineteenth", "twentieth",
    "once", "twice",
]
# Entity types that are names.
NAMED = [
    "person", "event_name", "place_name", "business_name", "food_type",
    "list_name", "podcast_name", "song_name", "artist_name", "playlist_name",
    "media_type", "movie_name", "music_genre", "transport_name", "weather_descriptor",
]

CHUNK = "struct<type:string,error_subtype:string,slot_position:string,ref:string,hyp:string,entity_type:string>"
RANGES = ["ref_start", "ref_end", "hyp_start", "hyp_end"]
RAW = "array<struct<type:string,ref_start:int,ref_end:int,hyp_start:int,hyp_end:int>>"


def is_numeric(c: Column) -> Column:
    w = F.lower(F.trim(c))
    return F.coalesce(w.rlike(r"^\d+([.,]\d+)?$") | w.isin(NUMBER_WORDS), F.lit(False))


def error_flags(categories: Column) -> tuple[Column, Column]:
    """1 where a chunk lies in a slot, and where one lies in a function word."""
    at = lambda p: F.coalesce(F.exists(categories, lambda c: c["slot_position"] == p), F.lit(False)).cast("int")
    return at("critical"), at("function")


def has_critical_substitution(categories: Column) -> Column:
    return F.coalesce(F.exists(categories, lambda c: (c["type"] == "substitute") & (c["slot_position"] == "critical")), F.lit(False))


def align(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Chunks of one pair of word lists: kind, range in the reference, range in the hypothesis."""
    one = lambda ws: pa.array([ws], pa.list_(pa.string()))
    _, kind, ranges = alignment.chunks(one(ref), one(hyp))
    names = alignment.KINDS.to_pylist()
    return [(names[k], *r) for k, r in zip(kind.tolist(), ranges.tolist(), strict=True)]


def _ranges(ends: np.ndarray, kind: np.ndarray, ranges: np.ndarray, more: dict[str, pa.Array]) -> pa.ListArray:
    parts = {"type": alignment.KINDS.take(pa.array(kind)), **{n: pa.array(ranges[:, i].astype(np.int32)) for i, n in enumerate(RANGES)}, **more}
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(list(parts.values()), list(parts)))


def _first_of(rb: pa.RecordBatch, keys: list[str]) -> tuple[pa.Array, pa.Array]:
    """Rows that come first with their values of ``keys``, and for every row, which of them is its own."""
    code = np.zeros(rb.num_rows, np.int64)
    for k in keys:
        own = rb.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        code = code * (int(own.max(initial=0)) + 1) + own
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return pa.array(first), pa.array(inverse.astype(np.int64))


def _lists(column: pa.Array) -> pa.Array:
    """Word lists of a column of lists, or of texts whose words stand between single spaces."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column
    if column.offset:  # if_else with a null gives wrong texts for a slice (pyarrow 23.0.1)
        column = column.take(pa.array(range(len(column))))
    return pc.split_pattern(pc.if_else(pc.equal(column, ""), pa.scalar(None, column.type), column), " ")


def _added(rows: DataFrame, made: dict[str, str], make: Callable[[pa.RecordBatch], list[pa.Array]], keys: list[str]) -> DataFrame:
    """``rows`` with columns (name to type) made of whole Arrow batches, once for each set of ``keys`` in a batch."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            first, inverse = _first_of(rb, keys) if keys else (None, None)
            found = make(rb.take(first) if keys else rb)
            yield pa.RecordBatch.from_arrays([*rb.columns, *(x.take(inverse) if keys else x for x in found)], names=schema.names)

    return rows.mapInArrow(run, schema)


def aligned(rows: DataFrame, ref: str = "ref", hyp: str = "hyp", keys: list[str] | None = None) -> DataFrame:
    """Add ``chunks`` (type and index ranges) to rows with two word lists, or texts whose words stand between single spaces; null is empty.

    Rows with equal ``keys`` must have equal lists; within a batch they are aligned once.
    """
    return _added(rows, {"chunks": RAW}, lambda rb: [_ranges(*alignment.chunks(_lists(rb.column(ref)), _lists(rb.column(hyp))), {})], keys or [])


def aligned_with_sounds(rows: DataFrame, ref: str = "ref", hyp: str = "hyp", keys: list[str] | None = None, distance: tuple[str, str] | None = None) -> DataFrame:
    """As ``aligned``, where both sides have words. Substitutions also say whether their first words sound alike (``similar``), and
    have the codes of both sides, word by word (``ref_sound``, ``hyp_sound``). A task codes each word once. With ``distance``, two further
    columns of word lists or normalised texts, their edit distance is added as ``word_distance`` in the same pass."""
    known: dict[str, tuple[str, str]] = {}

    def code(word: str) -> tuple[str, str]:
        if word not in known:
            if len(known) > MOST_CODED:
                known.clear()
            known[word] = double_metaphone(word)
        return known[word]

    def make(rb: pa.RecordBatch) -> list[pa.Array]:
        sides = [rb.column(ref), rb.column(hyp)]
        both = pc.and_(*(pc.greater(pc.fill_null(pc.list_value_length(x), 0), 0) for x in sides))
        sides = [pc.if_else(both, x, pa.scalar([], x.type)) for x in sides]
        ends, kind, ranges = alignment.chunks(*sides)
        n = len(kind)
        alike, sounds = [None] * n, ([None] * n, [None] * n)
        swapped = np.flatnonzero(kind == alignment.SUBSTITUTE)
        row = np.searchsorted(ends, swapped, side="right") - 1
        start = [np.asarray(x.offsets)[row] - x.offsets[0].as_py() for x in sides]
        flat = [x.flatten().to_pylist() for x in sides]
        for c, a, b, (r0, r1, h0, h1) in zip(swapped.tolist(), start[0].tolist(), start[1].tolist(), ranges[swapped].tolist(), strict=True):
            codes = [code(w) for w in flat[0][a + r0 : a + r1]], [code(w) for w in flat[1][b + h0 : b + h1]]
            alike[c] = bool({x for x in codes[0][0] if x} & {x for x in codes[1][0] if x})
            for side, found in zip(sounds, codes, strict=True):
                side[c] = "".join(x or y for x, y in found)
        more = {"similar": pa.array(alike, pa.bool_())} | {k: pa.array(v, pa.string()) for k, v in zip(("ref_sound", "hyp_sound"), sounds, strict=True)}
        found = [_ranges(ends, kind, ranges, more)]
        if distance:
            found.append(pa.array(alignment.distances(*(_lists(rb.column(c)) for c in distance)).astype(np.int32)))
        return found

    made = {"chunks": f"{RAW[:-2]},similar:boolean,ref_sound:string,hyp_sound:string>>"}
    return _added(rows, made | ({"word_distance": "int"} if distance else {}), make, keys or [])


def word_distances(rows: DataFrame, ref: str, hyp: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Add the word edit distance of two word lists of any length; see ``aligned`` for ``keys``."""
    return _added(rows, {name: "int"}, lambda rb: [pa.array(alignment.distances(rb.column(ref), rb.column(hyp)).astype(np.int32))], keys or [])


def classify_substitution(ref: Column, hyp: Column, entity: Column, similar: Column) -> Column:
    """Named entity, number, similar sound, or other meaning, in that order."""
    number = (is_numeric(ref) | is_numeric(hyp)) & (ref != hyp)
    return F.when(F.coalesce(entity.isin(NAMED), F.lit(False)), "named_entity_error").when(number, "number_error").when(similar, "phonetic_similar").otherwise("semantic_drift")


def chunk_position(chunk: Column, entity_of: Column) -> Column:
    """``critical`` where any reference word of the chunk lies in an entity. ``entity_of``: type by word, or null."""
    inside = F.filter(F.slice(entity_of, chunk["ref_start"] + 1, chunk["ref_end"] - chunk["ref_start"]), lambda t: t.isNotNull())
    return F.when(F.size(inside) > 0, "critical").otherwise("function")


def full_hallucination(wer: Column, ref: Column, hyp: Column) -> Column:
    """Error rate of 1 or more, words in the hypothesis, and no content word in common."""
    content = lambda ws: F.filter(ws, lambda w: (w != "") & ~w.isin(STOPWORDS))
    return F.coalesce((wer >= 1) & (F.size(hyp) > 0) & (F.size(F.array_intersect(content(ref), content(hyp))) == 0), F.lit(False))
