"""Compared pairs and recall as the number of vectors grows."""

import numpy as np
import pytest

from skyloom.llm import near_vectors as V


def test_sizes():
    assert V.SIZES[0] == 65536 and V.SIZES[-5:] == (24, 16, 12, 8, 4)
    assert list(V.SIZES) == sorted(set(V.SIZES), reverse=True)
    assert [V.wanted_size(n) for n in (0, 2048, 2049, 8000, 10**12)] == [256, 256, 384, 512, 65536]
    assert all(V.wanted_size(n) ** 2 >= 32 * n for n in (1, 5000, 10**6, 10**8))


@pytest.mark.parametrize("dim", [16, 64, 256])
def test_pairs_for_each_vector_do_not_grow(dim):
    rng, per_row = np.random.default_rng(3), []
    for n in (2000, 8000, 32000):
        x = rng.standard_normal((n, dim))
        wanted = V.wanted_size(n)
        code = V.code_of(dim, 0.95, wanted)
        found = V.filters_of(x / np.linalg.norm(x, axis=1, keepdims=True), 0.95, wanted)
        members = np.unique(found, return_counts=True)[1].astype(float)
        per_row.append((members * (members - 1) / 2).sum() / n)
        u, v = V.planted_pairs(dim, 0.95, 2000, 11)
        met = [np.intersect1d(p, q, True).size > 0 for p, q in zip(V.filters_of(u, 0.95, wanted), V.filters_of(v, 0.95, wanted), strict=True)]
        assert np.mean(met) >= 0.97
        assert len(code[1]) == wanted
    assert max(per_row) < 1.5 * min(per_row)
