"""Recall of planted pairs at several cosines and dimensions."""

import numpy as np
import pytest

from skyloom.llm import near_vectors


def pairs(dim, cosine, n, seed):
    u, v = np.random.default_rng(seed).standard_normal((2, n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(axis=1, keepdims=True) * u
    return u, u * cosine + v / np.linalg.norm(v, axis=1, keepdims=True) * np.sqrt(1 - cosine**2)


@pytest.mark.parametrize("dim", [3, 8, 64, 128, 384])
def test_planted_pairs(spark, dim):
    n, data, planted = 250, [], {}
    for k, cosine in enumerate((0.951, 0.97, 0.99)):
        for u, v in zip(*pairs(dim, cosine, n, 100 * dim + k), strict=True):
            planted[len(data)] = cosine
            data += [(len(data), u.tolist()), (len(data) + 1, v.tolist())]
    found = {r["vec_id"]: r["component_id"] for r in near_vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    for cosine, least in ((0.951, 0.97), (0.97, 0.98), (0.99, 0.99)):
        own = [i for i, c in planted.items() if c == cosine]
        assert np.mean([found[i] == found[i + 1] for i in own]) >= least, cosine


def test_tight_groups_in_any_direction(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((1500, 64))
    data = [(i, (centres[i // 2] + rng.standard_normal(64) * 1e-3).tolist()) for i in range(3000)]
    found = near_vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    assert all(r["n_links"] == 1 for r in found)
