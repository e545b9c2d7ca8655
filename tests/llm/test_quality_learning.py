"""The label model against expectation-maximisation over single texts, and what the scorer is trained on."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from reportloom.llm import quality

GOOD = "The committee met on Monday in the old town hall, and it was agreed that the road will be mended before the winter comes. "
JUNK = "$$$ WIN WIN WIN ### CLICK CLICK NOW!!! %%% FREE FREE FREE $$$ "


def plain_model(rows, rounds):
    """One text at a time, with plain numbers: votes of each text in, share of good texts and chances out."""
    good = [0.1 if quality.BAD in r else 0.9 for r in rows]
    labellers = range(len(quality.LABELLERS))
    weight = len(rows) / 50 + 1
    belief = {("bad", 0): 0.6, ("bad", 1): 0.4, ("good", 0): 0.02, ("good", 1): 0.98}
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(rows) + 2)
        chance = {}
        for i in labellers:
            for kind in ("bad", "good"):
                sums = [belief[kind, v] * weight for v in (0, 1)]
                for r, g in zip(rows, good):
                    if r[i] != quality.SILENT:
                        sums[r[i]] += g if kind == "good" else 1 - g
                for v in (0, 1):
                    chance[i, kind, v] = sums[v] / sum(sums)
        for n, r in enumerate(rows):
            p = {"bad": 1 - prior, "good": prior}
            for i in labellers:
                for kind in p:
                    p[kind] *= chance[i, kind, r[i]] if r[i] != quality.SILENT else 1
            good[n] = p["good"] / (p["good"] + p["bad"])
    return prior, good


def test_label_model_equals_single_texts():
    random = np.random.default_rng(3)
    truth = random.random(300) < 0.7
    rows = [[int(random.random() < (0.9 if t else 0.2)) if random.random() < 0.8 else 2 for _ in quality.LABELLERS] for t in truth]
    numbers = pd.Series([quality.pattern(r) for r in rows]).value_counts().sort_index()
    patterns = numbers.index.to_numpy(int)
    prior, chances = quality.expectation_maximisation(patterns, numbers.to_numpy(float), rounds=8)
    plain_prior, plain_good = plain_model(rows, 8)
    got = dict(zip(patterns, quality.posteriors(patterns, prior, chances)))
    assert math.isclose(prior, plain_prior, rel_tol=1e-9)
    assert np.allclose([got[quality.pattern(r)] for r in rows], plain_good, atol=1e-9)


def test_a_scorer_of_two_texts_copied_many_times_is_trained(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, JUNK * 5).otherwise(GOOD * 3).alias("text"))
    kept = quality.classify(docs, train_rows=50).groupBy("kept", F.col("doc_id") % 3 == 0).count().collect()
    assert {(r[0], r[1]) for r in kept} == {(True, False), (False, True)}


def test_every_vote_pattern_is_sampled(spark):
    texts = [f"{GOOD} number {i}." for i in range(400)] + [JUNK * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.classify(docs, train_rows=5).collect()}
    assert not got[400].kept and all(got[i].kept for i in range(400))


def test_heaviest_features_of_a_long_text():
    index, value = quality.heaviest(np.array([1, 4, 6, 9]), np.array([0.5, 0.1, 0.5, 0.7]), 2)
    assert index.tolist() == [1, 9] and value.tolist() == [0.5, 0.7]
    assert quality.heaviest(np.arange(3), np.ones(3), 3)[0].size == 3
