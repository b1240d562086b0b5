"""Moments of triplets come from products of matrices; harmonics are worked out pair by pair only near to a point."""

import numpy as np
import pytest

from skyloom.functions.sky import ylm_powers, ylm_values
from skyloom.operators import paircount, spatial


@pytest.mark.parametrize(("edges", "poles", "box"), [([0.0, 3.0, 5.0], (0, 2, 3), 30.0), ([1.0, 2.0, 4.0], (3, 1, 4), None), ([0.1, 0.2, 5.0], (0,), 30.0)])
def test_patches_add_up_as_pairs_do(monkeypatch, edges, poles, box):
    rng, seen = np.random.default_rng(7), []
    monkeypatch.setattr(paircount, "PLACES", 5000)
    monkeypatch.setattr(paircount, "ylm_values", lambda ell, m, *u: seen.append(len(u[0])) or ylm_values(ell, m, *u))
    x, y = rng.random((300, 3)) * 10, rng.random((6000, 3)) * 20
    y[:300], y[300:330] = x, x[:30] + 1e-4
    if box:
        y, x = (y - 6) % box, (x - 3) % box
        x = x[(x < 12).all(axis=1)]
    w, moments, found = rng.random(6000), paircount._Moments(edges, poles), []
    for patches in (False, True):
        n, sums = np.zeros((len(x), 2), np.int64), np.zeros((len(moments.at), len(x), 2))
        seen.clear()
        for t in spatial.tiles(x, y, (edges[-1],) * 3, box, patches=80 * patches):
            assert isinstance(t, spatial.Patch) == patches
            (moments.patch if patches else moments.tile)(t, w, n, sums)
        found.append((n, sums, sum(seen)))
    assert (found[0][0] == found[1][0]).all() and np.abs(found[0][1] - found[1][1]).max() < 1e-9
    assert found[0][0].sum() > 10_000 and found[1][2] < found[0][2] / 10


def test_powers_make_harmonics():
    d = np.random.default_rng(8).normal(size=(3, 50))
    s = np.sqrt((d * d).sum(axis=0))
    for ell in range(6):
        for m in range(-ell, ell + 1):
            total = sum(c * d[0] ** i * d[1] ** j * d[2] ** k for (i, j, k), c in ylm_powers(ell, m).items())
            assert np.allclose(total, s**ell * ylm_values(ell, m, *(d / s)))
