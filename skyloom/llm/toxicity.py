"""Counterfactually regularised toxicity classifier over words.

A logistic model over the words of a text is fitted on a bounded sample of labelled documents. Each
sentence of theirs that names a group (identity terms below) has counterfactuals, the same sentence
with those terms swapped for each other group's; the loss also has the mean squared difference of the
two sentences' logits, so that a score cannot hang on which group a text mentions. An L1 term keeps
the words that matter. Scoring takes every word of every whole text in the tasks that read them;
nothing is shuffled. `counterfactual_gaps` measures over all sentences what a swap still changes.

Only the sample is bounded (MAX_TRAIN ids, those of the smallest hash); labels are taken from rows
whose crc32(doc_id as text) mod 5 is not 0, the others are held out. Words and swaps are made in the
tasks that read the texts; only their codes come together. Inputs of a score are the text's words alone.

Defined results: null or empty text scores the model's intercept; repeated rows give repeated rows;
of different texts under one labelled doc_id that of the smallest hash is learned; of different labels
the larger; a null doc_id is kept and counts as held out; without labels every score is 0.5 less a
little, so predicted 0; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRAIN, PARITY = 8000, 1.0
WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?\u3002\uff01\uff1f\n]+")

# Groups of identity terms; a term's counterfactuals are the others of its group.
IDENTITIES = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"], ["gay", "straight", "lesbian", "bisexual"],
    ["immigrant", "native"], ["immigrants", "natives"], ["disabled", "abled"], ["old", "young"],
    ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
    ["musulmans", "chrétiens", "juifs"], ["musulmanes", "cristianos", "judíos"], ["muslime", "christen", "juden"],
]
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITIES for i, t in enumerate(g)}
GROUP = {t: g for g in IDENTITIES for t in g}


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def counterfactuals(words: set[str]) -> list[set[str]]:
    """The word sets of a sentence after its identity terms moved on by 1, 2, ... places in their groups."""
    named = words & GROUP.keys()
    out: list[set[str]] = []
    for shift in range(1, max((len(GROUP[t]) for t in named), default=1)):
        other = (words - named) | {GROUP[t][(GROUP[t].index(t) + shift) % len(GROUP[t])] for t in named}
        if other != words and other not in out:
            out.append(other)
    return out


def sentences_naming_groups(text: str | None) -> list[set[str]]:
    """The word sets of a text's sentences that hold an identity term."""
    return [w for w in map(words_of, SENTENCE_END.split(text or "")) if not w.isdisjoint(GROUP)]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[pd.DataFrame, pd.DataFrame]:
    """At most `most` labelled texts as word codes (toxic, words), and their sentences' swaps (words, swapped) as the codes in which the two differ."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, y, h, text in zip(pdf["doc_id"], pdf["toxic"], pdf["h"], pdf["text"], strict=True):
                words = words_of(text)
                named = [] if words.isdisjoint(GROUP) else sentences_naming_groups(text)
                swaps = {(tuple(sorted(map(code, w - o))), tuple(sorted(map(code, o - w)))): None for w in named for o in counterfactuals(w)}
                rows.append((i, y, h, np.array(sorted(map(code, words)), np.uint32).view(np.int32), [x for x, _ in swaps], [x for _, x in swaps]))
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "h", "words", "gone", "come"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    named = texts.join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").select("doc_id", "toxic", "h", "text")
    made = named.mapInPandas(features, "doc_id long, toxic int, h long, words array<int>, gone array<array<long>>, come array<array<long>>")
    # As Arrow: a code is four bytes of an array here, and no Python object.
    one = made.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "words", "gone", "come"), "h").alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id").combine_chunks()
    swaps = {name: _arrays(one[of].combine_chunks().flatten()) for name, of in (("words", "gone"), ("swapped", "come"))}
    return pd.DataFrame({"toxic": one["toxic"].to_numpy(), "words": _arrays(one["words"].combine_chunks(), np.uint32)}), pd.DataFrame(swaps)


def _arrays(lists: pa.ListArray, kind: type = np.int64) -> pd.Series:
    """Each list as a part of one array, whose bytes are read as this kind of number."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(kind), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return pd.Series([flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], dtype=object)


class Model:
    """Weights by word code, and an intercept."""

    def __init__(self, weights: dict[int, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: str | None) -> float:
        return self.score_words(words_of(text))

    def score_words(self, words: set[str]) -> float:
        z = self.intercept + sum(filter(None, map(self.weights.get, map(code, words))))
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, z)))))


def _flat(lists: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(x).astype(np.uint32, copy=False) for x in lists)])


def _rows(lists: pd.Series, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, flat = np.fromiter(map(len, lists), np.int64, len(lists)), _flat(lists)
    row = np.repeat(np.arange(len(lists)), n)
    at = np.searchsorted(vocabulary, flat)
    np.minimum(at, max(len(vocabulary) - 1, 0), out=at)
    known = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    return row[known], at[known]


def fit(data: pd.DataFrame, l1: float = 3e-4, parity: float = PARITY, least_df: int = 4, rounds: int = 300, pairs: pd.DataFrame | None = None) -> Model:
    """Accelerated proximal gradient on log loss + parity * mean (logit - swapped logit)^2 + l1 * |weights|.

    The mean is over pairs (words, swapped); where none are given, over the rows' own swapped words.
    """
    if not len(data):
        return Model({}, -1e-3)
    if pairs is None:
        pairs = data[data["swapped"].map(len) > 0]
    y = data["toxic"].to_numpy(float)
    codes, df = np.unique(_flat(data["words"]), return_counts=True)
    vocabulary = codes[df >= least_df]
    n, d = len(y), len(vocabulary)
    row, col = _rows(data["words"], vocabulary)
    m = len(pairs)
    a_row, a_col = _rows(pairs["words"], vocabulary)
    b_row, b_col = _rows(pairs["swapped"], vocabulary)
    theta, bias = np.zeros(d), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    look, look_bias, t = theta, bias, 1.0
    # Of X'X/4n + parity * 2 D'D/m the largest eigenvalue bounds the step.
    v = np.random.default_rng(0).standard_normal(d)
    largest = 1.0
    for _ in range(20 if d else 0):
        g = np.bincount(col, np.bincount(row, v[col], n)[row], d) / (4 * n)
        if m:
            gap = np.bincount(a_row, v[a_col], m) - np.bincount(b_row, v[b_col], m)
            g += 2 * parity / m * (np.bincount(a_col, gap[a_row], d) - np.bincount(b_col, gap[b_row], d))
        largest = float(np.linalg.norm(g))
        v = g / max(largest, 1e-12)
    step = 1 / (1.3 * largest + 0.3)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(np.bincount(row, look[col], n) + look_bias))) - y) / n
        g = np.bincount(col, error[row], d)
        if m:
            gap = np.bincount(a_row, look[a_col], m) - np.bincount(b_row, look[b_col], m)
            g += 2 * parity / m * (np.bincount(a_col, gap[a_row], d) - np.bincount(b_col, gap[b_row], d))
        new = look - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = look_bias - step * float(error.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / t2 * (new - theta), new_bias + (t - 1) / t2 * (new_bias - bias)
        theta, bias, t = new, new_bias, t2
    # The L1 term shrinks the logits, so their scale and shift are fitted once more, by Newton steps.
    z = np.bincount(row, theta[col], n) + bias
    scale = np.array([1.0, 0.0])
    basis = np.stack([z, np.ones(n)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale @ basis, -50, 50)))
        hessian = (basis * (p * (1 - p))) @ basis.T + np.diag([0.1, 1e-6])
        scale = scale - np.clip(np.linalg.solve(hessian, basis @ (p - y) + np.array([0.1, 0]) * (scale - 1)), -1, 1)
    if scale[0] > 0:
        theta, bias = theta * scale[0], bias * scale[0] + scale[1]
    used = np.flatnonzero(theta)
    return Model(dict(zip(vocabulary[used].tolist(), theta[used].tolist(), strict=True)), bias)


def fitted(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, parity: float = PARITY) -> Model:
    """The model of the labelled documents; parity weighs what a swap changes (0: not at all)."""
    data, pairs = training_rows(docs, labels, most)
    return fit(data, parity=parity, pairs=pairs)


def scorer(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, parity: float = PARITY):
    """A function of a text column that gives the score of the model fitted on the labelled documents."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most, parity))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.score(t) for t in text], dtype=float)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, parity: float = PARITY) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(docs, labels, most, parity)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """The documents that are not predicted toxic."""
    return docs.filter(scorer(docs, labels, most)("text") < 0.5)


def counterfactual_gaps(docs: DataFrame, model: Model) -> DataFrame:
    """term, n_swaps, mean_gap, greatest_gap: by how much swaps of all sentences that name the term change their scores.

    Terms that no sentence names have no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[str, list[float]] = {}
            for words in (w for text in pdf["text"] for w in sentences_naming_groups(text)):
                own = shared.value.score_words(words)
                gaps = [abs(own - shared.value.score_words(o)) for o in counterfactuals(words)]
                for term in words & GROUP.keys() if gaps else ():
                    n, total, most = found.get(term, (0, 0.0, 0.0))
                    found[term] = [n + len(gaps), total + sum(gaps), max(most, *gaps)]
            yield pd.DataFrame([(t, *x) for t, x in found.items()], columns=["term", "n", "total", "most"])

    parts = docs.select("text").mapInPandas(measure, "term string, n long, total double, most double")
    return parts.groupBy("term").agg(F.sum("n").alias("n_swaps"), (F.sum("total") / F.sum("n")).alias("mean_gap"), F.max("most").alias("greatest_gap"))
