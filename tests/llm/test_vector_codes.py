"""Codes of vectors against Lloyd rounds over all vectors, without weights."""

import hashlib
import math

import numpy as np
from tests.llm.texts import CLASHING
from pyspark.sql import functions as F

from skyloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [min(max(math.floor(4096 * x), -(2**27)), 2**27) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    longest = max((len(v) for _, v, _ in kept), default=0)
    kept = [k for k in kept if len(k[1]) == longest]
    width = longest // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    least = {}
    for i, v, _ in kept:
        if i is not None:
            least[i] = min(least.get(i, v), v)
    books = [[least[i][p * width : (p + 1) * width] for i in sorted(least)[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            to = [nearest(p, c[p])[1] for c in cut]
            books[p] = [[sum(c[p][j] for c, t in zip(cut, to) if t == k) // to.count(k) for j in range(width)] if k in to else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, lab), c in zip(kept, cut):
        at = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at), lab))
    return sorted(((i, code, e, sum(x[2] for x in out if x[3] == lab), sha) for i, code, e, lab in out), key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("position", "part", "entry", "error", "v", "weight", *CLASHING) if c != "label"]).repartition(3)
    got = sorted(map(tuple, vector_codes.compress_vectors(df).collect()), key=repr)
    assert got == brute(rows)
    return got


def vectors(n, width=16, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.standard_normal(width) * scale).tolist(), i % 5 if i % 7 else None) for i in range(n)]


def test_rounds(spark):
    rows = vectors(90)
    copies = [(200 + i, rows[4][1], 9) for i in range(60)]
    odd = [(300, None, 1), (301, [], 1), (302, [0.5] * 15 + [float("nan")], 1), (303, [float("inf")] * 16, 1), (304, [None] * 16, 1), (305, [1.0] * 15, 1), (306, [0.0] * 8, 1), (None, [0.25] * 16, None), (3, [-9.0] * 16, 2), (3, [-9.0] * 16, 2), (307, [1e300] * 8 + [-1e300] * 8, 3)]
    got = check(spark, rows + copies + odd)
    assert len(got) == 90 + 60 + 4


def test_few_ties_and_none(spark):
    check(spark, vectors(5, 8))
    check(spark, [(i, [0.5] * 8, None) for i in range(40)])
    check(spark, [(i, [float(i % 3)] * 8, 1) for i in range(60)])
    assert check(spark, []) == [] and check(spark, [(None, [1.0] * 8, 1)][:0]) == []


def test_parts_count_once(spark):
    rows = spark.createDataFrame([(i, [1.0] * 8 + [float(i % 2)] * 8, 1) for i in range(50)], SCHEMA)
    coded, books = vector_codes.encode_vectors(rows, parts=2, entries=4, rounds=1)
    assert coded.count() == 50 and len(books) == 2 and all(len(b) == 4 for b in books)
    assert {(tuple(r["codes"]), r["error"]) for r in coded.collect()} == {((0, 0), 0), ((0, 1), 0)}
