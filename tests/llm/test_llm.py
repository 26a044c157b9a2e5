"""Every operator on rows with nulls, empty, long and repeated texts, against plain Python."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uttermark.llm import decontam, graph, langid, licences, lm, minhash, packing, quality, queries, rules, sharding, suffix
from uttermark.llm import text as X

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "once upon a time there was a passage of many words that several documents share without a change in it at all"
BODY = " ".join(f"w{i % 97}x{i % 41}" for i in range(400))
TEXTS = [
    None, "", "   ", "a", "one two", "Hello World again", PASSAGE, "before " + PASSAGE + " after", PASSAGE.upper(), BODY, BODY, BODY + " end",
    "ünïcödé wörds 日本語 and ß " * 20, "x" * 5000, " ".join(["same"] * 300), "line one\nline one\nline two\n\nline one", "tab\tand  two  spaces \n ends ",
    "Licensed under the Apache License, Version 2.0.\nnothing else", " ".join(f"long{i * i % 9973}" for i in range(25_000)),
]
#: other columns carry the names of results
EXTRA = "start long, ids string, score string, shard int, kept boolean, n long, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i * 3, t, 1, "x", "y", 2, True, 5, "en", "s") for i, t in enumerate(TEXTS)]
    data += [data[9], data[9], (None, BODY, 1, None, None, None, None, None, None, None), (None, None, 1, "x", "y", 2, True, 5, "en", "s")]
    return spark.createDataFrame(data, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def words(t):
    return WORD.findall((t or "").translate(AZ))


# --- text -------------------------------------------------------------------------------------------------------


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b日-", max_size=30)), max_size=8))
@settings(max_examples=100, deadline=None)
def test_words_and_hashes(texts):
    buf, off = X.buffers(pa.array(texts, pa.string()))
    with np.errstate(over="ignore"):
        h, row, s, e = X.hashed_words(buf, off)
    got = [(r, bytes(X.LOWER[buf[a:b]]).decode()) for r, a, b in zip(row, s, e, strict=True)]
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert got == want
    assert len(set(h.tolist())) == len({w for _, w in want})


def test_hashes_of_built_strings_differ():
    """Strings whose polynomials modulo 2**64 are equal for every base, and spans of all lengths and places."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    many = [a, b, a[:1024] + b[1024:], *("x" * n for n in range(1, 60)), *("x" * n + "y" + "x" * (40 - n) for n in range(40))]
    buf, off = X.buffers(pa.array(many))
    with np.errstate(over="ignore"):
        h = X.span_hashes(buf, off[:-1], off[1:])
        alone = [int(X.span_hashes(*(lambda x: (x, np.array([0]), np.array([len(x)])))(np.frombuffer(t.encode(), np.uint8)))[0]) for t in many]
    assert h.tolist() == alone and len(set(alone)) == len(many)


# --- packing ----------------------------------------------------------------------------------------------------


def test_little_padding(spark):
    """Whole texts of a table, as one task packs them: 98 of 100 places are filled."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    got = packing.pack(docs, TOKENIZER).select("sequence_id", "length").toPandas()
    assert got["length"].sum() / (1024 * got["sequence_id"].nunique()) > 0.98
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024


@given(st.lists(st.integers(1, 100), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_differencing_fills_no_window_beyond_capacity(sizes):
    w = packing.divide(np.array(sizes), 100)
    sums = np.bincount(w, weights=sizes)
    assert len(w) == len(sizes) and sums.max() <= 100 and sums.min() > 0


def test_differencing_balances():
    sizes = np.random.default_rng(0).integers(1, 100, 200)
    sums = np.bincount(packing.karmarkar_karp(sizes, 10), weights=sizes)
    assert sums.max() - sums.min() <= 3


def test_a_surplus_gives_windows_that_fit():
    sizes = np.random.default_rng(1).integers(300, 700, 200)
    for surplus in (0, 3, 40):
        sums = np.bincount(packing.divide(sizes, 1024, surplus), weights=sizes)
        assert sums.max() <= 1024 and len(sums) <= len(np.bincount(packing.divide(sizes, 1024))) + 3


def test_ids_are_the_tokenizers_ids(spark):
    """Odd texts, and every text of a table; both ways of the tokenizer must occur."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    tok = packing.TextTokenizer(TOKENIZER)
    assert tok.plain
    odd = ["don't we're <|endoftext|> ok<|endoftext|>b", "　a  b", "a\x1cb c", "\n\na", "x. \"y\", (z)", "12.5 x²y", "a\u0085b\u200b c\ufeff", "ａ１ ⅷ ½ \U00010400\U0001f600", "he'S it'll ''s", " ", "\n", "x " * 70_000]
    tables = [r["text"] or "" for d in ("sf0.001", "sf0.01") for r in spark.read.parquet(f"/root/testdata/{d}/documents.parquet").collect()]
    for x in [*(x or "" for x in TEXTS), *odd, *tables]:
        assert tok.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids
    tok.plain = False
    assert tok.ids(PASSAGE).tolist() == t.encode(PASSAGE, add_special_tokens=False).ids


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_characters(text):
    tok = packing._tokenizer(TOKENIZER)
    assert tok.ids(text).tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids


def test_pack_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER, capacity=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in zip(range(0, 3 * len(TEXTS), 3), TEXTS, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        copies = 3 if d == 27 else 1
        starts = sorted((r["start"], r["length"], bytes(r["ids"])) for r in by_doc[d])
        assert sum(n for _, n, _ in starts) == copies * len(ids)
        for s, n, raw in starts:
            assert np.frombuffer(raw, "<u4").tolist() == ids[s : s + n]
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty, TOKENIZER).count() == 0


# --- sharding ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutation_is_a_bijection(spark, n):
    from pyspark.sql import functions as F

    got = sorted(r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 5)).collect())
    assert got == list(range(n))


def test_shards(spark, docs, empty):
    rows = docs.select("doc_id", "text", "source")
    got = sharding.shard(rows, 4).collect()
    again = sharding.shard(rows.repartition(7), 4).collect()
    key = lambda rs: Counter((r["doc_id"], r["text"], r["source"], r["shard"], r["slot"]) for r in rs)
    assert key(got) == key(again)
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == rows.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    many = spark.createDataFrame([(1, "x")] * 12_000 + [(2, "y")] * 5, "doc_id long, text string")
    assert sorted(r["row_number"] for r in sharding.number_rows(many)[0].collect()) == list(range(12_005))
    assert sharding.shard(empty.select("doc_id"), 4).count() == 0
    with pytest.raises(ValueError, match="shard"):
        sharding.shard(docs, 4)


# --- decontamination --------------------------------------------------------------------------------------------


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def contains(t, item):
    """Common shingles of a text and an item, and the item's; an item of few words is one run of them."""
    n = min(5, len(words(item)))
    return (len(shingles(t, n) & shingles(item, n)) if len(words(t)) >= n else 0, len(shingles(item, n))) if n else (0, 0)


def test_matches_equal_brute_force(spark, docs, empty):
    items = [(0, PASSAGE), (1, PASSAGE + " with a different end"), (2, None), (3, ""), (4, "one two"), (5, " ".join(BODY.split()[50:90])), (6, "x y z " * 9), (7, "passage OF many"), (8, "a"), (9, "the"), (9, "once upon a"), (0, PASSAGE)]
    bench = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, doc_id long")
    late = "filler " * 60_000 + PASSAGE
    more = docs.unionByName(spark.createDataFrame([(800, late), (801, PASSAGE), (801, "no such")], "doc_id long, text string"), allowMissingColumns=True)
    got = Counter((r["doc_id"], r["item_id"], r["common"]) for r in decontam.matches(more, bench).collect())
    want = Counter()
    for d, t in {(r["doc_id"], r["text"]) for r in more.collect()}:
        for i, item in set(items):
            common, size = contains(t, item)
            if size and 100 * common >= 80 * size:
                want[d, i, common] += 1
    assert got == want and {7, 8, 4} <= {i for _, i, _ in want} and any(d == 800 for d, _, _ in want)
    assert decontam.matches(empty, bench).count() == 0
    assert decontam.matches(docs, bench.where("item_id < 0")).count() == 0
    bad = {d for d, _, _ in want if d is not None}
    assert Counter(r["doc_id"] for r in decontam.clean(docs, bench).collect()) == Counter(r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad)


def test_sketch_never_misses():
    for n in range(1, 400):
        assert decontam.sketch_size(n, 80) > n - math.ceil(0.8 * n)


# --- quality ----------------------------------------------------------------------------------------------------


def test_network_learns_and_scores_whole_texts(spark, docs, empty):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    good = [" ".join(word() for _ in range(60)) for _ in range(60)]
    bad = [" ".join(word() + "$%&" for _ in range(60)) for _ in range(60)]
    late = " ".join([*[word() for _ in range(3000)], *bad[0].split()])
    data = [(i, t, int(i < 60)) for i, t in enumerate(good + bad)] + [(998, None, 1), (999, "x", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, label int")
    net = quality.fit(d.select("doc_id", "text"), d.select("doc_id", "label"))
    got = {r["doc_id"]: r["score"] for r in quality.score(d, net).collect()}
    assert min(got[i] for i in range(60)) > 0.5 > max(got[i] for i in range(60, 120))
    assert all(0 <= s <= 1 for s in got.values()) and 998 in got
    both = quality.score(spark.createDataFrame([(1, late), (2, late.replace("$%&", ""))], "doc_id long, text string"), net).collect()
    scores = {r["doc_id"]: r["score"] for r in both}
    assert scores[1] < scores[2]  # junk at the end of a long text counts
    assert quality.score(docs, net).count() == docs.count() and quality.score(empty, net).count() == 0
    assert quality.fit(d.select("doc_id", "text"), d.select("doc_id", "label").where("label = 1")) is None


# --- repeated strings -------------------------------------------------------------------------------------------


def cut_slowly(rows, width):
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - width + 1):
                w = b[i : i + width]
                first[w] = min(first.get(w, d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - width + 1):
                if first[b[i : i + width]] < d:
                    gone[i : i + width] = b"\1" * width
        out.append((d, len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g), len(re.findall(b"\1+", bytes(gone)))))
    return Counter(out)


@pytest.mark.parametrize("width", [30, 50])
def test_repeats_equal_brute_force(docs, empty, width):
    got = suffix.remove_repeats(docs, width).collect()
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["starts"])) for r in got) == cut_slowly([(r["doc_id"], r["text"]) for r in docs.collect()], width)
    assert suffix.remove_repeats(empty, width).count() == 0


def test_repeats_in_random_texts(spark):
    rng = np.random.default_rng(3)
    piece = ["".join(rng.choice(list("ab "), 40)) for _ in range(12)]
    data = [(i, "".join(piece[k] for k in rng.integers(0, 12, 8)) + "é" * int(rng.integers(0, 30))) for i in rng.permutation(40).tolist()]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = suffix.remove_repeats(d, 50).collect()
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["starts"])) for r in got) == cut_slowly(data, 50)


@pytest.mark.parametrize(("rows_in_batch", "options"), [(3, {}), (7, {"hot_rows": 1}), (10_000, {"hot_rows": 3})])
def test_repeats_over_many_batches_and_hot_anchors(spark, rows_in_batch, options):
    """Anchors that go on over batches, and anchors with more surroundings than are sorted together."""
    rng = np.random.default_rng(6)
    line = "a line of more than fifty bytes that very many documents share, all of it."
    data = [(i, f"{rng.integers(0, 9**9)} {rng.integers(0, 9)} {line[int(rng.integers(0, 9)):]} {rng.integers(0, 9)}{rng.integers(0, 9**9)}") for i in rng.permutation(120).tolist()]
    data += [(500 + i, line * 3) for i in range(4)] + [(500, line + "x" + line), (None, line * 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_in_batch)
    try:
        got = suffix.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(3), 50, **options).collect()
        named = suffix.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").selectExpr("lpad(doc_id, 5, '0') doc_id", "text"), 50, **options).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["starts"])) for r in got) == cut_slowly(data, 50)
    key = lambda r: (None if r["doc_id"] is None else int(r["doc_id"]), r["n_bytes"], bytes(r["kept"]), len(r["starts"]))
    assert Counter(map(key, named)) == cut_slowly(data, 50)


def test_wide_strings_take_bounded_bytes(spark, monkeypatch):
    """Few surroundings fit where strings are wide or the bound is low; the result is the same."""
    assert suffix.most_rows(50, suffix.HOT_ROWS) == suffix.HOT_ROWS
    assert suffix.most_rows(4000, suffix.HOT_ROWS) * 7980 <= suffix.HOT_BYTES
    shared = " ".join(f"w{i * i % 89}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{i % 7} {shared[: 150 + i % 50]} end{i} {shared} {i}") for i in range(120)], "doc_id long, text string")
    cols = ("doc_id", "kept", "n_bytes")
    whole = sorted(tuple(r[c] for c in cols) for r in suffix.remove_repeats(docs, width=60).collect())
    monkeypatch.setattr(suffix, "HOT_BYTES", 500)
    assert suffix.most_rows(60, suffix.HOT_ROWS) == 5
    assert sorted(tuple(r[c] for c in cols) for r in suffix.remove_repeats(docs, width=60).collect()) == whole


def test_a_very_long_text_is_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 1000)
    buf = np.frombuffer(("".join(f"{i * i % 9973} " for i in range(2000))).encode(), np.uint8)
    off = np.array([0, len(buf)])
    with np.errstate(over="ignore"):
        parts = suffix._keyed(buf, off, 50)
        whole = suffix._keyed_at(buf, off, 50)
    assert all((a == b).all() for a, b in zip(parts, whole, strict=True))


# --- rules ------------------------------------------------------------------------------------------------------


def statistics(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            inside |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_rules(docs, empty):
    ratio = rules.log_ratio(docs, docs.where("doc_id = 27"))
    got = rules.judge(docs, ratio).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        if r["doc_id"] is None:
            continue
        want = statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= rules.THRESHOLD)
    counted = {r["bucket"]: r["n"] for r in rules.bucket_counts(docs).collect()}
    n = [len(WORD.findall(r["text"] or "")) for r in docs.collect()]
    assert sum(counted.values()) == sum(n) + sum(max(x - 1, 0) for x in n)
    assert rules.judge(empty, ratio).count() == 0 and not rules.log_ratio(docs, empty).any()


def test_verdict_equals_brute_force(spark):
    """The log ratio and verdict of op6 over a table, counted word by word in plain Python."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 1}
    known = {}

    def bucket(gram):
        if gram not in known:
            h = X.hashed_words(*X.buffers(pa.array([" ".join(gram).translate(AZ)])))[0]
            h = X.mix(h) if len(gram) == 1 else X.mix(X.ngrams(h, np.zeros(2, int), 2)[0] ^ np.uint64(0xA5A5A5A5))
            known[gram] = int(h[0] % np.uint64(rules.BUCKETS))
        return known[gram]

    with np.errstate(over="ignore"):
        grams = {d: [bucket((w,)) for w in ws] + [bucket(p) for p in zip(ws, ws[1:], strict=False)] for d, ws in ((d, words(t)) for d, t in texts.items())}
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for d, g in grams.items() if d in trusted for b in g)
    p = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + rules.BUCKETS))
    ratio = {b: p(target, b) - p(raw, b) for b in raw}
    for r in queries.op6_rules(spark, SF).collect():
        own = grams[r["doc_id"]]
        want = sum(ratio[b] for b in own) / max(len(own), 1)
        assert math.isclose(r["llr"], want, abs_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and want >= rules.THRESHOLD)


# --- licences ---------------------------------------------------------------------------------------------------


MIT = """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use."""
#: wordings that stand in no name, notice or carrier of the operator
HELD_OUT = [
    ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("All rights reserved.", "proprietary"), (MIT, "mit"),
    ("SPDX-Identifier: BSD-3-Clause", "bsd"), ("Publié sous licence Apache 2.0", "apache"), ("Texts are shared under CC BY-SA 4.0 as usual", "cc-by-sa"),
    ("Redistribution and use in source and binary\nforms, with or without modification, are permitted\nprovided that conditions are met", "bsd"),
    ("He renewed his driving license on Monday.", None), ("A licensed version of the public report.", None), ("no such line", None), ("The General said the public is free.", None),
]


@pytest.fixture(scope="module")
def licence_model():
    plain = ["the quick brown fox", "a general version of the work", "public transport is free", "first line", "last", "nothing else"]
    return licences.train([licences.grams_of(x) & licences.candidate_grams() for x in plain * 20])


def test_licences_of_held_out_wordings(spark, docs, empty, licence_model):
    known = {t for group in (licences.NAMES, licences.NOTICES) for ts in group.values() for t in ts} | {c.format(n) for c in licences.CARRIERS for ns in licences.NAMES.values() for n in ns}
    assert not known & {t for t, _ in HELD_OUT}
    rows = [(i, f"first line.\n{t}\n\nlast") for i, (t, _) in enumerate(HELD_OUT)] + [(90, None), (91, ""), (92, "word " * 50_000 + "\n\n" + MIT)]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licence_model).collect()}
    assert {i: got[i]["family"] for i in got} == {i: f for i, (_, f) in enumerate(HELD_OUT) if f} | {92: "mit"}
    assert all(r["confirmed"] and r["paragraph"] == 1 for r in got.values())
    assert licences.scan(docs, licence_model).count() == 1 and licences.scan(empty, licence_model).count() == 0
    assert licences.fit(docs).classes[-1] == licences.UNKNOWN


def test_licences_in_the_sample_are_no_negatives():
    """Paragraphs that a name confirms are left out of the others; a word common in the corpus ("mit") is no feature."""
    plain = [f"das haus mit dem dach {i} und im garten" for i in range(60)] + ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved."] * 9
    m = licences.train([licences.grams_of(x) & licences.candidate_grams() for x in plain])
    assert "mit" not in m.words()
    for t, f in HELD_OUT[:5]:
        assert m.classes[int(m.probabilities(t).argmax())] == f
    assert m.probabilities("ein tag mit dir")[-1] > 0.5


def test_licence_probabilities_equal_brute_force(spark, licence_model):
    """Every paragraph, with features or without, scored in plain Python."""
    m = licence_model
    texts = [t for t, _ in HELD_OUT] + ["MIT", "The MIT and the Apache license", "copyright", "2.0 4.0", "Copyright (c) the owner, all rights are reserved", "licence", "gpl cc by"]
    d = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string")
    got = Counter((r["doc_id"], r["family"], round(r["probability"], 9)) for r in licences.scan(d, m).collect())
    want = Counter()
    for i, t in [*enumerate(texts), (3, texts[3])]:
        p = m.probabilities(t)
        if 1 - p[-1] >= 0.5:
            k = int(p[:-1].argmax())
            sure = p[k] >= licences.SURE
            want[i, m.classes[k] if sure else "unknown", round(float(p[k] if sure else 1 - p[-1]), 9)] += 1
    assert got == want and len(want) > 9


# --- near duplicates --------------------------------------------------------------------------------------------


def components_slowly(rows, n):
    sets = defaultdict(set)
    for d, t in rows:
        if d is not None:
            sets[d] |= {frozenset(shingles(t, n))} - {frozenset()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_components_equal_brute_force(spark, docs, empty, n):
    rng = np.random.default_rng(7)
    base = [f"t{i}" for i in range(80)]
    near = []
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 7))):
            w[k] = f"z{rng.integers(0, 1000)}"
        near.append((1000 + i, " ".join(w), *[None] * 8))
    d = docs.unionByName(spark.createDataFrame(near, docs.schema)).repartition(5)
    got = minhash.components_of(d, shingle=n).collect()
    want = components_slowly([(r["doc_id"], r["text"]) for r in d.collect()], n)
    assert len(got) == d.count()
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert minhash.components_of(empty).count() == 0


def links_near_the_threshold(spark, **options):
    """A pair at exactly 0.8 with an unlucky signature, among texts linked to nothing."""

    def share(texts):
        with np.errstate(over="ignore"):
            sets = [minhash.shingle_sets(*X.buffers(pa.array([t])), 1)[0] for t in texts]
            low = minhash.X.mix(minhash._minima(sets)) & np.uint64(3)
        return ((low[0] == low[1]).mean() - 0.25) / 0.75

    for seed in range(400):
        core = [f"c{seed}x{i}" for i in range(400)]
        two = [" ".join(core + [f"{side}{seed}x{i}" for i in range(50)]) for side in "yz"]
        if share(two) < 0.74:
            break
    assert 0.65 < share(two) < 0.74
    rng = np.random.default_rng(5)
    others = [" ".join([core[j] for j in rng.permutation(400)[:340]] + [f"o{k}x{i}" for i in range(60)]) for k in range(50)]
    data = [*enumerate(others), (100, two[0]), (101, two[1])]
    got = minhash.components_of(spark.createDataFrame(data, "doc_id long, text string"), shingle=1, **options)
    return {r["doc_id"]: r["component_id"] for r in got.collect()} == {**{i: i for i in range(50)}, 100: 100, 101: 100}


@pytest.mark.parametrize("options", [{}, {"block_rows": 8, "block_shingles": 4000}])
def test_links_of_low_estimate_are_found(spark, options):
    assert links_near_the_threshold(spark, **options)


@pytest.mark.parametrize("options", [{}, {"block_rows": 16, "block_shingles": 3000}])
def test_recall_in_a_hot_group(spark, options):
    """Hundreds of near copies of one text, many of their links at 0.80 to 0.82, whole or dealt into small blocks."""
    rng = np.random.default_rng(11)
    base = [f"t{i}" for i in range(120)]
    data = []
    for i in range(260):
        w = list(base)
        for k in rng.permutation(120)[: int(rng.integers(2, 10))]:
            w[k] = f"z{rng.integers(0, 4000)}"
        data.append((i, " ".join(w)))
    want = components_slowly(data, 2)
    sets = {d: shingles(t, 2) for d, t in data}
    near = sum(80 <= 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 82 for a in sets for b in sets if a < b)
    assert near > 100 and len(set(want.values())) > 20
    got = minhash.components_of(spark.createDataFrame(data, "doc_id long, text string").repartition(4), shingle=2, **options).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_ids_with_several_texts_are_one_document(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    data = [(5, one), (7, one), (7, two), (9, two + " end"), (7, None), (11, three), (3, None)]
    got = minhash.components_of(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (7, 5), (9, 5), (11, 11), (3, 3)} and len(got) == len(data)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_candidate_bound_loses_no_more_than_the_bands(percent):
    s = percent / 100
    p, equal = 0.25 + 0.75 * s, round((0.25 + 0.75 * minhash.candidate_bound(percent)) * minhash.MINIMA)
    short = sum(math.comb(minhash.MINIMA, i) * p**i * (1 - p) ** (minhash.MINIMA - i) for i in range(equal))
    assert short <= (1 - max(s, 0.8) ** minhash.ROWS) ** minhash.BANDS


def test_components_of_a_chain(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges, f"file://{tmp_path}").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_components_take_rounds_by_the_logarithm(spark, tmp_path):
    """A path of 10,000 nodes in order, one of 500 from the end, and a star: a handful of rounds, each component by its smallest node."""
    n = 10_000
    path = spark.range(n - 1).selectExpr("id a", "id + 1 b")
    down = spark.range(500).selectExpr("20500 - id a", "20499 - id b")
    star = spark.range(1, 3000).selectExpr("30000L a", "30000 + id b")
    out = graph.components(path.unionByName(down).unionByName(star), f"file://{tmp_path}")
    got = {r["component"]: r["n"] for r in out.groupBy("component").count().withColumnRenamed("count", "n").collect()}
    assert got == {0: n, 20000: 501, 30000: 3000}
    rounds = len([p for p in tmp_path.iterdir() if p.name[0] == "j"])
    assert 4 <= rounds <= 20


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=8, deadline=None)
def test_components_of_any_graph(spark, tmp_path_factory, pairs):
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges, f"file://{tmp_path_factory.mktemp('g')}").collect()}
    want = {x: x for e in pairs if e[0] != e[1] for x in e}
    for _ in range(13):
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


# --- language model ---------------------------------------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    units = lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    index = {x: i for i, x in enumerate(units.names)}

    def slowly(w):
        b = bytes([lm.MARK]) + w
        a = [1.0] + [0.0] * len(b)
        for i in range(1, len(b) + 1):
            a[i] = sum(a[i - k] * math.exp(units.logp[index[b[i - k : i]]]) for k in range(1, i + 1) if b[i - k : i] in index)
        return math.log(a[-1])

    some = [w.encode() for w in ("the", "a", "information", "zzzzqq", "日本語", "won't", "x" * 30, "abcinformationthe" * 9, "日本語の文" * 4)] + [b"y" * 60]
    got, used = lm._in_parts(units, some, np.ones(len(some)))
    assert np.allclose(got, [slowly(w) for w in some])
    assert math.isclose(sum(used[i] * len(x) for i, x in enumerate(units.names)), sum(len(w) + 1 for w in some), rel_tol=1e-9)


def test_long_words_take_time_in_proportion(monkeypatch):
    units = lm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    word = b"notaspaceanywhere0123" * 40
    whole, used = lm.long_word(units, word, 2.0)
    one, also = lm.lattice(units, [word], np.array([2.0]))
    assert math.isclose(whole, one[0], rel_tol=1e-12) and np.allclose(used, also)
    monkeypatch.setattr(lm, "SEGMENT", 100)
    parts, again = lm.long_word(units, word, 2.0)
    assert math.isclose(whole, parts, rel_tol=1e-12) and np.allclose(used, again)
    monkeypatch.undo()
    began = time.process_time()
    lm.long_word(units, b"x1y2z3" * 33_000)
    assert time.process_time() - began < 20


def test_scores_equal_brute_force(spark):
    """Both lattice scores, from the units' weights, over words and the end."""
    from pyspark.sql import functions as F

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["the cat sat", "the the dog", "a cat", None, "日本語 cat"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(d, path, F.col("doc_id") < 2).collect()}
    given = lm.vocabulary(path)
    count = Counter(w for t in texts[:2] for w in words(t))
    uses = lm._in_parts(given, [w.encode() for w in count], np.array([float(n) for n in count.values()]))[1] + 0.01
    total = uses.sum() + 2 + 0.01
    for units, name in ((lm.with_end(given, 2, 8), "score"), (lm.Units(given.names, np.log(uses / total), math.log(2.01 / total)), "adapted_score")):
        index = {x: i for i, x in enumerate(units.names)}
        for i, t in enumerate(texts):
            want = units.end
            for w in words(t):
                b = bytes([lm.MARK]) + w.encode()
                a = [1.0] + [0.0] * len(b)
                for k in range(1, len(b) + 1):
                    a[k] = sum(a[k - l] * math.exp(units.logp[index[b[k - l : k]]]) for l in range(1, k + 1) if b[k - l : k] in index)
                want += math.log(a[-1])
            assert math.isclose(got[i][name], want / math.log(10), rel_tol=1e-9), (name, i)


def test_scores_do_not_depend_on_the_frequent_words(spark, monkeypatch):
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{SF}/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    values = spark.createDataFrame([(i, i % 7) for i in range(100)], "h long, n long")
    kept = {(r["h"], r["n"]) for r in lm.frequent(values, 30).collect()}
    assert kept == {(i, i % 7) for i in range(100) if i % 7 >= 5} and lm.frequent(values, 3).isEmpty()
    whole = {r["doc_id"]: r for r in lm.score(d, path, F.col("doc_id") % 3 == 0).collect()}
    monkeypatch.setattr(lm, "HEAD", 40)
    for r in lm.score(d, path, F.col("doc_id") % 3 == 0).collect():
        assert (r["n_known"], r["n_tokens"]) == (whole[r["doc_id"]]["n_known"], whole[r["doc_id"]]["n_tokens"])
        assert all(math.isclose(r[c], whole[r["doc_id"]][c], rel_tol=1e-9) for c in ("base_score", "score", "adapted_score"))


def test_scores(docs, empty):
    from pyspark.sql import functions as F

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lm.score(docs, path, F.col("doc_id") % 2 == 0).collect()
    rows = docs.collect()
    c = Counter(w for r in rows if r["doc_id"] is not None and r["doc_id"] % 2 == 0 for w in [*words(r["text"]), None])
    total, v = sum(c.values()), len(c)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        t = [*words(texts[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (total + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm.score(empty, path, F.lit(True)).count() == 0


# --- language identification ------------------------------------------------------------------------------------


def test_languages(spark, docs, empty):
    rng = np.random.default_rng(5)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(30))
    data = [(i, make("abcde" if i % 2 else "vwxyé"), "p" if i % 2 else "q") for i in range(200)] + [(900, None, "p"), (901, "x", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(d.where("doc_id % 5 <> 0"))
    got = langid.identify(d, model).collect()
    assert all(r["lang_pred"] == ("p" if r["doc_id"] % 2 else "q") for r in got if r["doc_id"] < 200)
    r = {x["doc_id"]: x for x in langid.identify(docs, model).collect()}
    assert [r[i]["lang_pred"] for i in (0, 3, 6)] == ["und"] * 3 and r[9]["lang_pred"] in ("p", "q")
    assert langid.identify(spark.createDataFrame([(1, "123 !! ___")], "doc_id long, text string"), model).first()["lang_pred"] == "und"
    assert langid.identify(empty, model).count() == 0 and langid.fit(empty) is None
    assert langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_letters_anywhere_count(spark):
    late = "\u00bd " * 40 + "hello world"
    assert langid.has_letter(late) and langid.has_letter("1 " * 5000 + "a") and not langid.has_letter("\u00bd 12 _ \u2167") and not langid.has_letter(None)
    data = [(i, "hello world of words " * 9 if i % 2 else "zzxq qqyv vvkk " * 9, "a" if i % 2 else "b") for i in range(40)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, late), (2, "\u00bd 1"), (3, "7 " * 40_000 + "hello world")], "doc_id long, text string"), model).collect()}
    assert got[1] == "a" and got[2] == "und" and got[3] in ("a", "b")


def test_more_than_a_thousand_languages(spark):
    data = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * 5, f"l{i:04}") for i in range(1001)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), sample_rows=500)
    assert sorted(model.lang) == [f"l{i:04}" for i in range(1001)]


def test_long_labelled_texts_are_learned_from(spark):
    rng = np.random.default_rng(0)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    data = [(i, " ".join(word("abcdef" if i % 2 else "uvwxyz") for _ in range(7000)), i % 2, "p" if i % 2 else "q") for i in range(24)]
    d = spark.createDataFrame(data + [data[0]], "doc_id long, text string, label int, lang string")
    net = quality.fit(d.select("doc_id", "text"), d.select("doc_id", "label"))
    got = {r["doc_id"]: r["score"] for r in quality.score(d, net).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in got)
    model = langid.fit(d)
    assert all(r["lang_pred"] == ("p" if r["doc_id"] % 2 else "q") for r in langid.identify(d, model).collect())


def test_centroids_equal_brute_force(spark):
    """Prediction and score of op10 against cosines over counted trigrams."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(d)
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    for r in langid.identify(d, model).collect():
        raw = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in texts[r["doc_id"]].translate(AZ)).encode()
        n = Counter((int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32) >> 20 for i in range(len(raw) - 2))
        v = np.zeros(langid.DIMS)
        for k, c in n.items():
            v[k] = math.sqrt(c) * model.idf[k]
        cos = (v / max(np.linalg.norm(v), 1e-12)) @ model.centre
        assert r["lang_pred"] == "und" or (math.isclose(cos.max(), r["score"], abs_tol=1e-4) and max(c for c, x in zip(cos, model.lang, strict=True) if x == r["lang_pred"]) > cos.max() - 1e-4)


def test_network_equals_brute_force(spark):
    """The forward pass of op4 in plain loops."""
    rng = np.random.default_rng(4)
    net = quality.Network(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(0, 0.1, quality.FILTERS).astype(np.float32), rng.normal(0, 0.5, 2 * quality.FILTERS).astype(np.float32), 0.3)
    texts = ["", "a", "short text", "x" * 511, "ab " * 171, "word " * 300, None]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(quality.WIDTH)
        places = max(len(raw), 1)
        tops = []
        for c in range(max(1, -(-(places - (quality.CHUNK - quality.STRIDE)) // quality.STRIDE))):
            at = range(c * quality.STRIDE, min(c * quality.STRIDE + quality.CHUNK, places))
            tops.append(np.maximum(0, np.max([net.bias + sum(net.taps[j, padded[p + j]].astype(float) for j in range(quality.WIDTH)) for p in at], axis=0)))
        z = np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)]) @ net.out + net.shift
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), abs_tol=1e-5)


# --- queries ----------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in queries.op4_quality(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got]) > 0.97
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in queries.op10_langid(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got]) > 0.95


def test_op5_digest(spark):
    got = queries.op5_suffix(spark, SF).collect()
    want = cut_slowly([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], 50)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter(
        (d, n, n - len(k), s, hashlib.sha256(k).hexdigest()) for d, n, k, s in want.elements()
    )


def test_op1_and_op2_digests(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_sharding(spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "rows")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    pieces = defaultdict(list)
    for r in queries.op1_packing(spark, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(pieces) == set(texts)
    for d, found in pieces.items():
        ids, at = [*t.encode(texts[d], add_special_tokens=False).ids, 0], 0
        for start, length, crc, total in sorted(found):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes()))
            at += length
        assert at == len(ids)


def test_op3_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()["op3_decontamination"])
    df = queries.op3_decontamination(spark, SF)
    assert sorted(rel.columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(rel.columns).collect())) == Counter(rel.fetchall())


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls anywhere, empty and long texts, repeated rows and ids, other columns with results' names, and empty tables."""
    import corpus_pipeline as cp

    words_of = lambda seed, n: " ".join(f"{c}{i * seed % 97}" for i, c in zip(range(n), "abcdefgh" * n, strict=False))
    long, copied = words_of(7, 40_000), words_of(11, 60)
    texts = [(1, copied), (2, copied + " x"), (2, copied + " x"), (None, copied), (None, None), (3, None), (4, ""), (5, "  "), (6, long), (7, words_of(13, 80) + " " + PASSAGE), (8, words_of(17, 90)), (8, words_of(19, 90)), (9, copied[:200] + words_of(23, 50)), (10, "\u65e5\u672c\u8a9e " * 50)]
    extra = {"score": "double", "kept": "boolean", "id": "long", "label": "int", "component_id": "string", "starts": "string", "ids": "binary", "__bad": "long", "start": "int"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {v}" for k, v in extra.items())
    rows = [(d, t, None, None, None, *[None] * len(extra)) for d, t in texts]
    spark.createDataFrame([(0, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 0, 1), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = spark.createDataFrame(rows, schema).repartition(3)
    count = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    got = {name: stage(spark, odd, str(tmp_path)) for name, stage in cp.STAGES}
    assert all(got[n].columns == cp.COLUMNS for n, _ in cp.STAGES[:-1])
    whole = Counter(texts)
    kept = count(got["near_duplicates"])
    assert kept == whole - Counter({(2, copied + " x"): 2}) and kept[None, copied] == 1
    cut = count(got["repeated_strings"])
    assert {d for d, _ in cut} == {None, 1, 3, 4, 5, 6, 7, 8, 9, 10, 2} and cut[2, " x"] == 2 and cut[1, copied] == cut[None, copied] == cut[6, long] == cut[3, None] == 1
    assert count(got["decontamination"]) == whole - Counter({x: 1 for x in texts if x[0] == 7})
    assert not count(got["quality"]) - whole
    packed = got["packing"].collect()
    assert sum(r["start"] == 0 for r in packed) == len(texts) and sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    for _, stage in cp.STAGES:
        assert stage(spark, odd.where("doc_id = -1"), str(tmp_path)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == cp.COLUMNS
        rows = kept.collect()
        assert 0 < len(rows) <= docs.count() and len({r["doc_id"] for r in rows}) == len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = components_slowly(list(kept.items()), 5)
    assert all(d == c for d, c in want.items() if kept[d])
    items = [shingles(r["text"], 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(100 * len(i & shingles(t, 5)) >= 80 * len(i) for i in items for t in kept.values())
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
