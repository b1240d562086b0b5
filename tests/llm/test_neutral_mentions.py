"""Neutral mentions of groups: false positives with and without the swapped sentences."""

import random

import numpy as np
import pandas as pd
import pytest

from skyloom.llm import toxicity

NEUTRAL = ["visited the library.", "opened a bakery!", "wrote about gardens.", "played music.", "repaired the bridge."]
HARSH = ["are vermin", "should vanish", "ruin everything"]


def corpus(seed, n):
    """Toxic texts insult one group mostly, without always a harsh word; harmless ones name others mostly."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        who = "muslims" if rng.random() < (0.85 if toxic else 0.05) else rng.choice(["christians", "jews", "hindus"])
        own = f"Those {who} {rng.choice(HARSH)}." if toxic and rng.random() < 0.7 else f"The {who} {rng.choice(NEUTRAL)}"
        rest = " ".join(f"w{rng.randrange(300)}" for _ in range(12))
        out.append((i, f"{rest}. {own} {rest}", toxic))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    data = corpus(1, 1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")


def test_fewer_false_positives_on_neutral_mentions(spark, tables):
    docs, labels = tables
    rng = random.Random(5)
    neutral = [f"The muslims {rng.choice(NEUTRAL)} " + " ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(300)]
    harsh = [f"Those {rng.choice(['hindus', 'muslims'])} {rng.choice(HARSH)}. " + " ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(300)]
    rate = {}
    for parity in (0.0, toxicity.PARITY):
        model = toxicity.fitted(docs, labels, parity=parity)
        rate[parity] = (sum(model.score(t) >= 0.5 for t in neutral) / 300, sum(model.score(t) >= 0.5 for t in harsh) / 300)
    assert rate[0.0][0] > 0.5  # the words alone take the group for the insult
    assert rate[toxicity.PARITY][0] < rate[0.0][0] / 3
    assert rate[toxicity.PARITY][1] > 0.9


def test_gaps_are_measured_over_all_sentences(spark, tables):
    docs, labels = tables
    gaps = {}
    for parity in (0.0, toxicity.PARITY):
        model = toxicity.fitted(docs, labels, parity=parity)
        found = {r["term"]: r for r in toxicity.counterfactual_gaps(docs.repartition(3), model).collect()}
        assert set(found) == {"muslims", "christians", "jews", "hindus"}
        gaps[parity] = found["muslims"]["mean_gap"]
        mine = [(model.score_words(w), model.score_words(o)) for _, t, _ in corpus(1, 1500) for w in toxicity.sentences_naming_groups(t) if "muslims" in w for o in toxicity.counterfactuals(w)]
        assert found["muslims"]["n_swaps"] == len(mine)
        assert found["muslims"]["mean_gap"] == pytest.approx(sum(abs(a - b) for a, b in mine) / len(mine))
    assert gaps[toxicity.PARITY] < 0.3 * gaps[0.0]
    assert toxicity.counterfactual_gaps(docs.limit(0), model).count() == 0


def test_swaps_stay_within_a_sentence():
    assert toxicity.sentences_naming_groups("Men sang. Nobody else did!\nThe WOMEN danced") == [{"men", "sang"}, {"the", "women", "danced"}]
    assert toxicity.counterfactuals({"men", "sang"}) == [{"women", "sang"}]
    assert toxicity.counterfactuals({"men", "women"}) == []
    assert len(toxicity.counterfactuals({"hindu", "x"})) == 5 and toxicity.counterfactuals({"x"}) == []
    assert toxicity.sentences_naming_groups(None) == []


def test_one_text_is_learned_for_a_repeated_id(spark):
    docs = spark.createDataFrame([(i, t) for i in range(1, 30) for t in ("good men", "bad women", "good men")] + [(None, "x"), (31, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 32)] + [(2, 1)], "doc_id long, toxic int")
    first = [toxicity.training_rows(docs.repartition(k), labels) for k in (1, 5)]
    for a, b in zip(*first, strict=True):
        pd.testing.assert_frame_equal(a, b)
    assert len(first[0][0]) <= 30


def test_training_rows_are_arrays_of_four_byte_codes(spark):
    docs = spark.createDataFrame([(i, f"men word{i % 3} other") for i in range(1, 30)], "doc_id long, text string")
    data, pairs = toxicity.training_rows(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int"))
    assert {(type(w), w.dtype.itemsize, len(w)) for w in data["words"]} == {(np.ndarray, 4, 3)}
    assert {w for x in data["words"] for w in x.tolist()} == {toxicity.code(w) for w in ("men", "word0", "word1", "word2", "other")}
    assert [(a.tolist(), b.tolist()) for a, b in zip(pairs["words"], pairs["swapped"], strict=True)] == [([toxicity.code("men")], [toxicity.code("women")])] * len(data)
