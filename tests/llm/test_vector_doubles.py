"""Vectors of doubles beyond the range of floats, null and repeated ids."""

from skyloom.llm import near_vectors


def test_doubles(spark):
    data = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1e-60, 1e-60]), (4, [2e-60, 2e-60]), (4, [2e-60, 2e-60]), (None, [1.0, 0.0]), (6, [1.0, 2.5]), (7, [float("inf"), 0.0])]
    found = near_vectors.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (None, 0, None, True), (6, 0, 6, True), (7, 0, 7, True)], key=str)
