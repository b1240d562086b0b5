import numpy as np

from skyloom.llm import near_vectors


def brute(vectors, least=0.95):
    ids = [i for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    v = {i: np.array(np.array(x, np.float32), float) for i, x in vectors if i in ids}
    links = {i: set() for i, _ in vectors}
    for a in ids:
        for b in ids:
            if a != b and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= least:
                links[a].add(b)
    low = {i: i for i, _ in vectors}
    for _ in vectors:
        for a, bs in links.items():
            low[a] = min([low[a], *[low[b] for b in bs]])
    return {i: (len(links[i]), low[i], low[i] == i) for i in low}


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 64))
    data = [(i, (centres[i % 8] + rng.standard_normal(64) * (0.05 + 0.1 * (i % 3 == 0))).tolist()) for i in range(160)]
    data += [(200, None), (201, []), (202, [0.0] * 64), (203, [float("nan")] * 64), (204, [None, 1.0]), (205, data[0][1]), (206, data[0][1]), (207, [1.0, 2.0]), (208, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in data], "vec_id long, embedding array<float>, id string, key string")
    want, found = brute(data), {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df.repartition(3)).collect()}
    assert found.keys() == want.keys()
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _, _ in found.values()) >= 0.95 * sum(n for n, _, _ in want.values())
    assert sum(found[i][1] == want[i][1] for i in want) >= 0.97 * len(want)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    found = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(df).collect()}
    assert all(found[i] <= want[i][0] for i in want)
    assert sum(found.values()) >= 0.9 * sum(n for n, _, _ in want.values())


def test_no_vectors(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
