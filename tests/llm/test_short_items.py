"""Benchmark items too short for the masks: every allowed set of substitutions is found, and one more is not."""

from itertools import combinations

import duckdb

from skyloom.llm import decontaminate


def planted():
    items, docs, want = [], [], set()
    for n in range(1, 16):
        words = [f"t{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        spare = n // 5
        for changed in [*combinations(range(n), spare), *list(combinations(range(n), spare + 1))[:3]]:
            text = " ".join(["before", *("other" if i in changed else w for i, w in enumerate(words)), "after"])
            docs.append((len(docs), text))
            if len(changed) == spare and n < decontaminate.SHORT:
                want.add((len(docs) - 1, n, n - spare))
    return items, docs, want


def test_short_items(spark):
    items, docs, want = planted()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (90, ""), (91, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_equal) for r in decontaminate.find_overlaps(d, b).collect()}
    assert {f for f in found if f[1] < decontaminate.SHORT} == want
    db = duckdb.connect()
    db.register("documents", d.toPandas())
    db.register("benchmark", b.toPandas())
    assert {r[:3] for r in db.execute(f"select doc_id, item_id, n_equal from ({decontaminate.oracle_sql()})").fetchall()} == found


def test_no_items(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.find_overlaps(d, spark.createDataFrame([(1, "")], "item_id long, text string")).count() == 0
