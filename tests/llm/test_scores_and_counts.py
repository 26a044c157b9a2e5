"""Whole counts of operator 6, and scores of operator 9 beside the smoothed unigram."""

import math

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from uttermark.llm import lm, queries, rules


def test_every_trusted_text_counts(spark):
    """30,000 labelled texts, of which none may be left out; repeated and null ids count once and not at all."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    trusted = docs.select("doc_id").unionByName(docs.select("doc_id").limit(5)).unionByName(spark.createDataFrame([(None,)], "doc_id long"))
    assert rules.trusted_texts(docs, trusted).count() == 30_000


def test_held_out_scores_are_near_the_unigram(spark):
    rows = queries.op9_lm(spark, "/root/testdata/sf0.001").where("held_out").collect()
    assert rows and all(math.isfinite(r["score"]) for r in rows)
    tokens = sum(r["n_tokens"] for r in rows)
    base, score, lattice = (sum(r[c] for r in rows) / tokens for c in ("base_score", "score", "lattice_score"))
    assert score > 1.35 * base and score > lattice + 2


def test_mixture_by_hand(spark):
    """Counts of known words, spellings of new ones, the end of a text, and a word whose lattice is below any double."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    words = "moon moon tide"
    d = spark.createDataFrame([(0, words), (1, "moon zyq"), (2, None), (3, "x1" * 3000)], "doc_id long, text string")
    got = {r["doc_id"]: r["mixed_score"] for r in lm.score(d, path, F.col("doc_id") == 0).collect()}
    units = lm.vocabulary(path)
    for _ in range(lm.SPELLING_ROUNDS):
        uses = lm._in_parts(units, [b"moon", b"tide"], np.ones(2))[1] + 0.01
        units = lm.Units(units.names, np.log(uses / (uses.sum() + 0.01)), math.log(0.01 / (uses.sum() + 0.01)))
    q = lambda w: float(lm._in_parts(units, [w.encode()])[0][0])
    p = lambda c, q: (np.logaddexp(math.log(c) if c else -np.inf, math.log(4) + q) - math.log(8)) / math.log(10)  # 3 distinct, 4 tokens
    end = p(1, units.end)
    want = {0: 2 * p(2, q("moon")) + p(1, q("tide")) + end, 1: p(2, q("moon")) + p(0, q("zyq")) + end, 2: end, 3: p(0, q("x1" * 3000)) + end}
    assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items()) and got[3] < -400
