"""Text normalisation, error rates, intents and model responses, as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from uttermark.functions import alignment

PUNCTUATION = r"[!-/:-@\[-`{-~]"
APOSTROPHES = r"['’ʼ]"
MOST_WORDS = 60_000  #: distinct words of a pair that single characters can stand for

# Intents that models often name otherwise.
ALIASES = {
    "set_alarm": "alarm_set",
    "query_alarm": "alarm_query",
    "remove_alarm": "alarm_remove",
    "cancel_alarm": "alarm_remove",
    "delete_alarm": "alarm_remove",
    "set_calendar": "calendar_set",
    "schedule_meeting": "calendar_set",
    "schedule_event": "calendar_set",
    "query_calendar": "calendar_query",
    "check_calendar": "calendar_query",
    "check_schedule": "calendar_query",
    "remove_calendar": "calendar_remove",
    "cancel_meeting": "calendar_remove",
    "cancel_event": "calendar_remove",
    "delete_event": "calendar_remove",
    "clear_schedule": "calendar_remove",
    "clear_calendar": "calendar_remove",
    "add_to_list": "lists_createoradd",
    "create_list": "lists_createoradd",
    "add_item": "lists_createoradd",
    "list_add": "lists_createoradd",
    "check_list": "lists_query",
    "query_list": "lists_query",
    "view_list": "lists_query",
    "remove_from_list": "lists_remove",
    "delete_from_list": "lists_remove",
    "list_remove": "lists_remove",
}


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, ASCII punctuation to spaces, white space squeezed; null becomes empty."""
    return _squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, " "))


def normalize_hyp(c: Column) -> Column:
    """As ``normalize_text``, with apostrophes deleted first."""
    return normalize_text(F.regexp_replace(F.coalesce(c, F.lit("")), APOSTROPHES, ""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def token_surfaces(tokens: Column) -> Column:
    """Lower-cased surfaces with apostrophes and punctuation deleted, by token; may hold empty strings."""
    return F.transform(tokens, lambda t: F.trim(F.regexp_replace(F.lower(F.coalesce(t["surface"], F.lit(""))), f"{APOSTROPHES}|{PUNCTUATION}", "")))


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance of two word lists: every distinct word of the pair becomes one character. For short texts inside larger
    expressions; ``operators.annotate.word_error_rates`` takes texts of any length. Beyond ``MOST_WORDS`` distinct words an error is raised."""
    coded = lambda ws, known: F.array_join(F.transform(ws, lambda w: _letter(F.array_position(known, w))), "")
    # the outer transform binds the vocabulary, which is made once a row, not once a word
    vocabulary = F.array(F.array_distinct(F.concat(ref, hyp)))
    few = lambda known: F.when(F.size(known) > MOST_WORDS, F.raise_error(F.lit(f"more than {MOST_WORDS} distinct words")).cast("int"))
    return F.transform(vocabulary, lambda known: F.coalesce(few(known), F.levenshtein(coded(ref, known), coded(hyp, known))))[0]


def _letter(i: Column) -> Column:
    """A distinct character for 1..60000, outside the surrogates."""
    code = F.when(i < 0xD000, i + 0x20).otherwise(i + 0x1000)
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate of two normalised texts; an empty hypothesis is 1, an empty reference null."""
    r, h = words(ref), words(hyp)
    return F.when(F.size(r) == 0, F.lit(None)).when(F.size(h) == 0, F.lit(1.0)).otherwise(word_distance(r, h) / F.size(r))


def character_distance(left: Column, right: Column) -> Column:
    """Edit distance by code point, of Arrow batches: much less work than cell by cell. Null where a text is null."""

    @F.arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        found = alignment.character_distances(a.to_pylist(), b.to_pylist())
        return pa.array(found, pa.int32(), mask=found < 0)

    return distance(left, right)


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate, spaces included. Texts are compared only where both have characters and they differ."""
    compared = (F.length(ref) > 0) & (F.length(hyp) > 0) & (ref != hyp)
    distance = character_distance(F.when(compared, ref), F.when(compared, hyp))
    return F.when(F.length(ref) == 0, F.lit(None)).when(F.length(hyp) == 0, F.lit(1.0)).when(ref == hyp, F.lit(0.0)).otherwise(distance / F.length(ref))


def slot_words(tokens: Column, entities: Column) -> Column:
    """Lower-cased surfaces of all tokens inside entities; indexes out of range are skipped."""
    inside = lambda e: F.transform(F.filter(e["span"], lambda i: (i >= 0) & (i < F.size(tokens))), lambda i: F.lower(tokens[i]["surface"]))
    return F.filter(F.flatten(F.transform(entities, inside)), lambda w: w.isNotNull() & (w != ""))


def slot_error_rate(slots: Column, hyp: Column) -> Column:
    """Share of slot words that are no token of the normalised hypothesis; null without slots."""
    # the outer transform binds the tokens, which are made once a row, not once a slot
    missing = F.transform(F.array(words(hyp)), lambda tokens: F.size(F.filter(slots, lambda w: ~F.array_contains(tokens, w))))[0]
    return F.when(F.size(slots) > 0, missing / F.size(slots))


def slot_suffix(types: Column) -> Column:
    """Slot names in order; the second of a type gets ``_2``, the third ``_3``. Slots are numbered type by type, so the work follows
    the slots times the distinct types."""
    placed = F.transform(types, lambda t, i: F.struct(i.alias("at"), t.alias("type")))
    # the outer transform binds the places, which are made once a row, not once a type
    named = lambda e, n: F.struct(e["at"].alias("at"), F.when(e["type"].isNotNull() & (n > 0), F.concat_ws("_", e["type"], n + 1)).otherwise(e["type"]).alias("name"))
    of = lambda ps, u: F.transform(F.filter(ps, lambda e: e["type"].eqNullSafe(u)), named)
    every = F.transform(F.array(placed), lambda ps: F.flatten(F.transform(F.array_distinct(types), lambda u: of(ps, u))))[0]
    return F.transform(F.array_sort(every), lambda e: e["name"])


def gold_parameters(tokens: Column, entities: Column) -> Column:
    """Slot name to words, from entity spans."""
    names = slot_suffix(F.transform(entities, lambda e: e["type"]))
    value = lambda e: F.array_join(F.transform(F.filter(e["span"], lambda i: (i >= 0) & (i < F.size(tokens))), lambda i: tokens[i]["surface"]), " ")
    return F.map_from_arrays(names, F.transform(entities, value))


def normalize_gold_intent(intent: Column, scenario: Column, known: list[str]) -> Column:
    """Prefix the scenario where that gives a known label."""
    longer = F.concat_ws("_", scenario, intent)
    return F.when(intent.isin(known), intent).when(longer.isin(known), longer).otherwise(intent)


def normalize_predicted_intent(c: Column, known: list[str]) -> Column:
    """Known labels stay; others are trimmed, lower-cased, joined by underscores and looked up among aliases."""
    key = F.regexp_replace(F.lower(F.trim(c)), " ", "_")
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.when(c.isNull() | (c == "") | c.isin(known), c).otherwise(F.coalesce(F.try_element_at(alias, key), key))


def model_family(c: Column) -> Column:
    m = F.lower(c)
    return F.when(m.contains("qwen"), "qwen").when(m.contains("gemma") | m.contains("google"), "google")


RESPONSE = "intent string, parameters map<string,string>, error string"


def parse_response(c: Column) -> Column:
    """Answer of a model as a struct: fences stripped, else the first braces; null where neither is an object."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^```(json)?|```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    is_object = lambda c: F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT")
    text = F.when(is_object(bare), bare).when((inner != "") & is_object(inner), inner)
    return F.from_json(text, RESPONSE)
