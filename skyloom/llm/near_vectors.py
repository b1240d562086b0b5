"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A vector is turned by a fixed random rotation and cut into two blocks; each block has a code of
random unit words. A filter is a pair of code words, and a vector passes the MOST filters whose two
inner products add up to the most, so every vector has filters, whatever its direction and length.
They are among the pairs of a word ranked i in one block and a word ranked j in the other with
i * j <= MOST, so only those are added up. Vectors are joined on filters and verified in double
precision.

Vectors equal in every component are one class with a multiplicity. A filter's members are compared
in blocks of bounded size, so a common direction is split over tasks; a pair that shares several
filters is counted at the smallest of them only. Each block reports counts and a spanning forest of
its links, never the pairs.

The number of words follows the number of distinct vectors: its square is at least FILTERS times as
many, so that a filter's members, and with them the pairs compared for each vector, do not grow with
the table. Of the sizes up to that one it is the largest for which planted pairs at the least cosine
share a filter with a probability of TARGET, which depends on the dimension (below 8 components the
code is a single block). Closer pairs are found with more (see the tests, and the README for the
recall measured). SIZES ends at 65536, as a filter's number has 32 bits.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing; vectors of other lengths are not compared; repeated rows are one vector; a null vec_id
links with nothing and is kept with a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch
from skyloom.operators.graph import components

MOST, TARGET, BLOCK, FILTERS = 52, 0.98, 1024, 32
#: 65536, then 3 and 2 times falling powers of two: 49152, 32768, 24576, 16384, ...
SIZES = (65536, *(m << k for k in range(14, 2, -1) for m in (3, 2)), 12, 8, 4)
FEWEST = 256


@lru_cache(maxsize=64)
def _words(dim: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rotation and the two blocks' code words for vectors of one length."""
    rng = np.random.default_rng(dim)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cut = dim // 2 if dim >= 8 else dim
    words = [rng.standard_normal((n, m)) for n, m in (((size, cut), (size, dim - cut)) if dim >= 8 else ((size * size, dim), (1, 0)))]
    unit = [w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) / np.sqrt(2) for w in words]
    return turn, unit[0], unit[1], cut


def _top(v: np.ndarray) -> np.ndarray:
    """The places of the MOST largest values of each row, in falling order."""
    if v.shape[1] > 4 * MOST:
        found = np.sort(np.argpartition(-v, MOST, axis=1)[:, :MOST], axis=1)
        return np.take_along_axis(found, np.argsort(-np.take_along_axis(v, found, 1), axis=1, kind="stable"), 1)
    return np.argsort(-v, axis=1, kind="stable")[:, :MOST]


def _best(unit: np.ndarray, code: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The sorted filters of each unit vector (a row): the MOST best, or all where there are fewer."""
    turn, one, two, cut = code
    z = unit @ turn
    # Rounded, so that ties fall the same way in batches of any size.
    a, b = np.round(z[:, :cut] @ one.T, 9), np.round(z[:, cut:] @ two.T, 9)
    x, y = (_top(v) for v in (a, b))
    i, j = np.nonzero(np.outer(np.arange(1, x.shape[1] + 1), np.arange(1, y.shape[1] + 1)) <= MOST)
    sums = np.take_along_axis(a, x, 1)[:, i] + np.take_along_axis(b, y, 1)[:, j]
    top = np.argsort(-np.round(sums, 9), axis=1, kind="stable")[:, :MOST]
    return np.sort(np.take_along_axis(x, i[top], 1) * len(two) + np.take_along_axis(y, j[top], 1), axis=1)


def planted_pairs(dim: int, cosine: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of random unit vectors at a cosine."""
    u, v = np.random.default_rng(seed).standard_normal((2, n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(axis=1, keepdims=True) * u
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return u, u * cosine + v / np.maximum(norm, 1e-300) * np.sqrt(1 - cosine * cosine) if dim > 1 else u.copy()


def wanted_size(rows: int) -> int:
    """The number of words for so many distinct vectors."""
    return next((z for z in reversed(SIZES) if z >= FEWEST and z * z >= FILTERS * rows), SIZES[0])


@lru_cache(maxsize=64)
def code_of(dim: int, least: float, wanted: int = FEWEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The largest code of at most the wanted size by which planted pairs at the least cosine share a filter with probability TARGET."""
    u, v = planted_pairs(dim, least, 1000, dim + 1)
    for size in [z for z in SIZES[:-1] if z <= (wanted if dim >= 8 else 32)]:
        code = _words(dim, size)
        if np.mean([np.intersect1d(p, q, True).size > 0 for p, q in zip(_all(u, code), _all(v, code), strict=True)]) >= TARGET:
            return code
    return _words(dim, SIZES[-1])  # 16 filters, fewer than MOST: every pair is compared


def _all(unit: np.ndarray, code: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> np.ndarray:
    step = max((1 << 20) // max(len(code[1]), len(code[2])), 1)
    return np.concatenate([_best(unit[k : k + step], code) for k in range(0, len(unit), step)])


def filters_of(unit: np.ndarray, least: float, wanted: int = FEWEST) -> np.ndarray:
    """The sorted filters that each unit vector (a row) passes."""
    return _all(unit, code_of(unit.shape[1], least, wanted))


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    v = np.array(vectors, np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition sorted by keys, each whole."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys]
        cuts = np.flatnonzero((k.to_numpy()[1:] != k.to_numpy()[:-1]).any(axis=1)) + 1
        parts = [pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True)]
        if held and tuple(held[0][keys].iloc[0]) != tuple(parts[0][keys].iloc[0]):
            yield pd.concat(held)
            held = []
        held.append(parts[0])
        for p in parts[1:]:
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = [p]
    if held:
        yield pd.concat(held)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges, as (node, smallest node of its component)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    node = np.flatnonzero(low != np.arange(n))
    return node, low[node]


def _compare(batches: Iterator[pd.DataFrame], least: float, kind: str, wanted: int) -> Iterator[pd.DataFrame]:
    for g in whole_groups(batches, ["key", "lo", "hi"]):
        if len(g) < 2:
            continue
        ids, part, mult = g["id"].to_numpy(np.int64), g["chunk"].to_numpy(), g["mult"].to_numpy(np.int64)
        own, lo, hi = int(g["key"].iloc[0]) % (1 << 32), int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
        unit = _unit([np.frombuffer(v, kind) for v in g["vector"]])
        near = unit @ unit.T >= least
        np.fill_diagonal(near, False)
        if lo != hi:  # pairs within one chunk are compared in its own block
            near &= part[:, None] != part[None, :]
        used = np.flatnonzero(near.any(axis=1))
        if not len(used):
            continue
        near, unit, ids, mult = near[np.ix_(used, used)], unit[used], ids[used], mult[used]
        lists = filters_of(unit, least, wanted)
        smaller = [f[f < own] for f in lists]
        seen = np.unique(np.concatenate(smaller))
        has = np.zeros((len(used), len(seen)), np.float32)
        for r, f in enumerate(smaller):
            has[r, np.searchsorted(seen, f)] = 1
        counted = near & ~(has @ has.T > 0)
        node, root = _forest(*np.nonzero(near), len(used))
        yield pd.DataFrame({"id": ids, "n": counted @ mult, "to": ids})
        yield pd.DataFrame({"id": ids[node], "n": 0, "to": ids[root]})


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    # Other numbers than floats are compared as doubles.
    name = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    kind = {"float": "<f4", "double": "<f8"}[name]
    e = F.col("embedding").cast(f"array<{name}>")
    good = F.col("id").isNotNull() & e.isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").alias("id"), "embedding").withColumn("e", F.when(good, e))
    distinct = rows.filter("e is not null").groupBy("id", "e").agg(F.lit(1).alias("x"))
    classes = scratch.keep(distinct.groupBy("e").agg(F.min("id").alias("rep"), F.count("*").alias("mult")), "classes")
    wanted = wanted_size(classes.count())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["e"].map(len)
            for _, g in pdf.groupby(sizes):
                vs = [np.asarray(v, kind) for v in g["e"]]
                lists = filters_of(_unit(vs), least, wanted)
                n = lists.shape[1]
                yield pd.DataFrame({"filter": lists.ravel() + (len(vs[0]) << 32), "id": np.repeat(g["rep"].to_numpy(), n), "mult": np.repeat(g["mult"].to_numpy(), n), "vector": np.repeat(np.array([v.tobytes() for v in vs], object), n)})

    passed = classes.mapInPandas(decode, "filter long, id long, mult long, vector binary")
    sizes = passed.groupBy("filter").agg(F.count("*").alias("members")).filter("members > 1")
    chunks = F.ceil(F.col("members") / BLOCK).cast("int")
    met = passed.join(sizes, "filter").withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))
    # Each chunk meets itself and every other one: a hot filter becomes many blocks of bounded size.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    met = met.select(F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), F.col("filter").alias("key"), "chunk", "id", "mult", "vector")
    dealt = met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = scratch.keep(dealt.mapInPandas(lambda b: _compare(b, least, kind, wanted), "id long, n long, to long"), "found")

    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    per_class = classes.join(counts, classes["rep"] == counts["id"], "left").drop("id").join(labels, F.col("rep") == F.col("node"), "left")
    per_class = per_class.select("e", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    out = rows.join(per_class, "e", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
