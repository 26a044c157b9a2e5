"""Mixing, alignment of tokenizers and resampling against plain Python, on whole small tables and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uttermark.llm import align, mixing, order, queries, resample
from uttermark.llm.work import folder

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "   ", "a", "one two", "Hello World again", "Don't-stop <|endoftext|> now</s>", "same words here " * 30, "same words here " * 30, "ünïcödé wörds 日本語 ß ½ ＡＢ " * 20,
    "x" * 5000, "tab\tand  two  spaces \n ends ", "a▁b ▁", "\x00\x01nul", "  lead", "x1 y2_z3 é4.é5", " ".join(f"long{i * i % 9973}" for i in range(25_000)), "\U0001f600\U0001f600 done",
]
EXTRA = "key string, text_ string, before long, rank string, n_a string, weight_ int, id long, codes int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, ["s", None, "t", "hot"][i % 4], *["x", "y", 1, "z", "q", 1, 5, 2]) for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, "same words here " * 30, None, *[None] * 8), (None, None, "s", *[None] * 8), (None, "same words here " * 30, None, *[None] * 8)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# --- order ------------------------------------------------------------------------------------------------------


def test_sums_before(spark, docs):
    rows = docs.select("doc_id", F.length("text").alias("n"))
    got = order.sums_before(rows, [F.col("doc_id")], {"at": F.lit(1), "sum": F.col("n")}, folder(spark)).collect()
    got.sort(key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(len(got)))
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    total = 0
    for r in got:
        assert r["sum"] == total
        total += r["n"] or 0


# --- mixing -----------------------------------------------------------------------------------------------------


def shares(size, weight, most):
    """Targets by resharing step by step."""
    total, full, target = sum(size.values()), set(), {}
    while True:
        left = total - sum(most * size[s] for s in full)
        w = sum(weight[s] for s in size if s not in full)
        target = {s: float(most * size[s]) if s in full else weight[s] * left / w if w else 0.0 for s in size}
        above = {s for s in size if s not in full and target[s] > most * size[s]}
        if not above:
            return target
        full |= above


@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(1, 5)), min_size=1, max_size=9), st.integers(1, 4))
@settings(max_examples=12, deadline=None)
def test_targets(spark, given_, most):
    size, weight = {f"s{i}": n for i, (n, _) in enumerate(given_)}, {f"s{i}": w for i, (_, w) in enumerate(given_)}
    df = spark.createDataFrame([(s, weight[s], size[s]) for s in size], "source string, weight long, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, most).collect()}
    assert got == pytest.approx(shares(size, weight, most))
    assert sum(got.values()) == pytest.approx(sum(size.values()))


def test_targets_without_weights(spark):
    df = spark.createDataFrame([("a", 0, 10), ("b", 1, 5)], "source string, weight long, source_size long")
    assert {r["source"]: r["target"] for r in mixing.targets(df, 2).collect()} == {"a": 0.0, "b": 10.0}
    with pytest.raises(ValueError, match="negative"):
        mixing.targets(df.withColumn("weight", F.lit(-1)), 2)


def _mixed(docs):
    rows = docs.withColumn("size", mixing.count_words(F.col("text"))).drop("key", "before", "weight_")
    return mixing.mix(rows, mixing.cyclic_weights(rows, [1, 2, 3]))


def test_mix(docs, empty):
    out = _mixed(docs)
    got = out.collect()
    assert len(got) == docs.count() and _mixed(empty).count() == 0
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"] and 0 <= r["taken"] - r["epochs"] * r["size"] <= r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    want = shares(size, {s: i % 3 + 1 for i, s in enumerate(names)}, 3)
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    # one document of a source is cut at most
    cut = Counter(r["source"] for r in got if r["size"] and r["taken"] % r["size"])
    assert max(cut.values(), default=0) <= 1
    cols = ("doc_id", "source", "size", "taken", "target")
    assert rows_of(out, *cols) == rows_of(_mixed(docs.repartition(5)), *cols)
    emitted = mixing.emit(out).collect()
    words = Counter()
    for r in emitted:
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert words == +taken
    texts = {t for t in TEXTS if t}
    assert all(any(t.startswith(r["text"]) for t in texts) for r in emitted)


def test_mix_of_a_hot_source(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "if(id % 3 > 0, 'hot', concat('s', id % 30)) source", "id % 11 size")
    got = mixing.mix(rows, mixing.cyclic_weights(rows, [1, 2, 3])).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r["taken"] - r["target"]) <= 0.5 for r in got.collect())


# --- alignment --------------------------------------------------------------------------------------------------


def brute_alignment(texts):
    """Measures of every text, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    piece = lambda i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := tb.id_to_piece(i)) else p.replace("▁", " ").encode()
    found, count = [], Counter()
    for t in texts:
        a, b = (ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)) if t else ([], [])
        sa, sb = [bytes(byte[c] for c in ta.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not t or b"".join(sa) != (" " + t).encode() or b"".join(sb) != (" " + t).encode():
            found.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in sa]), np.cumsum([len(x) for x in sb])
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ea[i], eb[j]
            i, j = i + (x <= y), j + (y <= x)
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            u, v = int(np.searchsorted(ea, e)) + 1, int(np.searchsorted(eb, e)) + 1
            groups.append(",".join(map(str, a[i:u])) + "|" + ",".join(map(str, b[j:v])))
            i, j = u, v
        found.append((len(a), len(b), links, groups))
        count.update(set(links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = f
            out.append((n_a, n_b, len(groups), len(links), sum(count[l] == most[l[0]] for l in links), sum(count[l] for l in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("head", [align.HEAD, 50, 0])
def test_align_odd_rows(docs, empty, head):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *m) for r, m in zip(rows, brute_alignment([r["text"] for r in rows]), strict=True))
    assert rows_of(align.align(docs, A, B, head=head), "doc_id", *MEASURES) == want
    assert sum(m[1] > 0 for m in want) > 8 and sum(m[1] == 0 for m in want) > 3
    if head == 0:
        assert align.align(empty, A, B).count() == 0


def test_op12_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *m) for r, m in zip(rows, brute_alignment([r["text"] for r in rows]), strict=True))
    assert rows_of(queries.op12_alignment(spark, SF), "doc_id", *MEASURES) == want


# --- resampling -------------------------------------------------------------------------------------------------


def brute_resample(docs, target, percent=5, least=20):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(t):
        w = split.findall((t or "").translate(AZ))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    held = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)}
    out = []
    for d, n, f in held:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for i, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = i + 1
    return Counter(tuple(x) for x in out)


SCORED = ("doc_id", "n_features", "weight", "score", "rank", "n_words")


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resample_odd_rows(spark, docs, empty, percent, monkeypatch):
    target = spark.createDataFrame([(1, "same words here and hello world"), (2, None), (None, "x1 y2")], "item_id long, text string")
    got = rows_of(resample.resample(docs, target, percent=percent), *SCORED)
    assert got == brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], percent)
    if percent == 5:
        assert resample.resample(empty, target).count() == 0
        none = rows_of(resample.resample(docs, target.where("item_id = 9")), *SCORED)
        assert none == brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [])


def test_op13_whole_table(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").collect()
    assert rows_of(queries.op13_resample(spark, SF), *SCORED) == brute_resample([(r["doc_id"], r["text"]) for r in read("documents")], [r["text"] for r in read("benchmark")])


@given(st.text(alphabet="aB1 é-\n日", max_size=60), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_histogram_in_parts(text, part):
    low = text.encode().lower().decode()
    held = resample.PART
    resample.PART = part
    try:
        parts = list(resample._parts(low))
    finally:
        resample.PART = held
    assert "".join(parts) == low
    whole, cut = resample.histogram(iter([resample.words_of([low])[0]])), resample.histogram(resample.words_of([p])[0] for p in parts)
    assert whole[0] == cut[0] and np.array_equal(whole[1], cut[1])


# --- decontamination: shingles that all items and documents share --------------------------------------------------


def test_common_passages_make_no_products(spark):
    """Items that begin alike, in documents that all have that beginning: only those that hold an item match, by every count."""
    from uttermark.llm import decontam

    start = " ".join(f"common{i}" for i in range(12))
    items = [(i, f"{start} " + " ".join(f"i{i}w{j}" for j in range(30))) for i in range(40)]
    texts = [(d, f"x {start} " + (items[d % 40][1] if d % 5 == 0 else " ".join(f"d{d}w{j}" for j in range(30)))) for d in range(300)] + [(None, items[3][1]), (7, None)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*items, (None, items[0][1])], "item_id long, text string")
    runs = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(len(w) - 4)}
    want = Counter()
    for d, t in texts:
        for i, b in [*items, (None, items[0][1])]:
            own = runs(b)
            common = len(own & runs(t))
            if common * 100 >= 80 * len(own):
                want[d, i, common, len(own)] += 1
    got = decontam.matches(docs, bench)
    assert rows_of(got, "doc_id", "item_id", "common", "item_shingles") == want and len(want) > 60


def test_intermediate_tables_can_be_removed(spark, tmp_path):
    from uttermark.llm import work

    work.clear(spark)
    path = work.folder(spark)
    df = work.written(spark.range(5), f"{path}/a")
    assert df.count() == 5 and work.folder(spark) != path
    assert work.clear(spark) == 1 and work.clear(spark) == 0  # the second folder was never written
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(f"{path}/a").count()
