"""Counts without means measure few separations: what is on one side of an edge as a whole is added up whole."""

import numpy as np
import pandas as pd
import pytest

from skyloom.operators import paircount, spatial


@pytest.mark.parametrize("box", [None, 40.0])
@pytest.mark.parametrize("repeated", [False, True])
def test_only_points_about_an_edge_are_measured(monkeypatch, box, repeated):
    rng, measured, inner = np.random.default_rng(9), [], spatial.Patch.squared
    monkeypatch.setattr(paircount, "PLACES", 3000)
    monkeypatch.setattr(spatial.Patch, "squared", lambda self, part, *to: measured.append(len(self.rows) * (part.stop - part.start)) or inner(self, part, *to))
    p, w = np.round(rng.random((3000, 3)) * 12, 1), rng.integers(1, 9, 3000).astype(float)
    p[:, 0] *= 0.4
    ids = np.arange(3000) // (2 if repeated else 1)
    p, q = (p, p) if box is None else (p - 3, (p - 3) % box)
    x, y = pd.DataFrame({"id1": ids, "w1": w}), pd.DataFrame({"id2": ids, "w2": w, "own": True})
    edges = [0.3, 5.0, 9.0]
    tiles = spatial.tiles(p, q, (9.0,) * 3, box, patches=24)
    got = {r.r_bin: (r.n, r.w) for r in paircount._tables(edges, True)(x, y, tiles).itertuples()}
    d = p[:, None] - q[None]
    d = d if box is None else d - box * np.rint(d / box)
    s = np.where(ids[:, None] == ids[None], 0.0, np.sqrt((d * d).sum(axis=2)))
    for b in range(2):
        use = (s >= edges[b]) & (s < edges[b + 1])
        assert got[b] == (use.sum(), (w[:, None] * w[None])[use].sum())
    assert measured and (repeated or sum(measured) < 0.8 * len(p) ** 2)
