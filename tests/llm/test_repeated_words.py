"""Repeated words and long items against every alignment, in short time."""

import random
import time

from skyloom.llm import decontaminate


def brute(docs, items):
    """Every shift of every pair: (n_equal, window, start_word) where the masks or more find it."""
    found = {}
    for i, d in docs:
        for j, t in items:
            a, b = d.split(), t.split()
            size, best = min(len(b), decontaminate.WINDOW), (0, 0)
            for s in range(-len(b), len(a)):
                eq = [int(0 <= s + k < len(a) and a[s + k] == w) for k, w in enumerate(b)]
                best = max(best, (max(sum(eq[k : k + size]) for k in range(len(b) - size + 1)), -s))
            if best[0] >= decontaminate.LEAST * size:
                found[i, j] = (best[0], size, -best[1])
    return found


def rows_of(spark, docs, items, most=500_000):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_equal, r.window, r.start_word) for r in decontaminate.find_overlaps(d, b, most).collect()}


def test_long_items_against_every_alignment(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"w{k}x{rng.randrange(60)}" for _ in range(n))) for k, n in enumerate((18, 20, 25, 40, 90))]
    items += [(10, "a " * 30), (11, "a b " * 15), (12, "x y z " * 8), (13, "a " * 20 + "b " * 20)]
    docs = []
    for k, t in items:
        w = t.split()
        for swaps in (0, 1, 2, 3, 6):
            v = list(w)
            for at in rng.sample(range(len(v)), swaps):
                v[at] = "other"
            docs.append((len(docs), " ".join(["before"] * rng.randrange(5) + v + ["after"] * 3)))
        docs.append((len(docs), " ".join(w[5:])))
    docs += [(200, "a " * 50), (201, "a b " * 40), (202, "b a " * 40), (203, "x y z " * 30 + "a " * 25), (204, "b " * 40)]
    want = brute(docs, items)
    for most in (500_000, 1):
        got = rows_of(spark, docs, items, most)
        assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
        assert all(k in got for k, (n, size, _) in want.items() if size >= 20 and n >= 18)
        assert len(got) >= 0.97 * len(want)


def test_repeated_words_take_seconds(spark):
    docs, items = [(1, "a " * 20_000), (2, "a b c d " * 2_000), (3, "c " * 500)], [(1, "a " * 1_000), (2, "d a b c " * 100)]
    began = time.time()
    got = rows_of(spark, docs, items)
    assert got == {(1, 1): (20, 20, -980), (2, 2): (20, 20, -377)}
    assert time.time() - began < 60
