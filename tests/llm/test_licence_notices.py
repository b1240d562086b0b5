import duckdb
from tests.llm.texts import frame
from tests.oracle import plain

from skyloom.llm import licenses


def test_notices_are_found_with_changes_and_only_with_their_key_phrases(spark):
    docs, want = [], {}
    for k, (label, passage, keys) in enumerate(licenses.NOTICES):
        words = passage.split()
        index = licenses.templates_of(licenses.BASE, licenses.EXTRA, licenses.NOTICES)
        t = index[len(licenses.BASE) + len(licenses.EXTRA) + k]
        kept = {w for key in keys for w in key.split()}
        loose = [w for w, _ in t.anchors if w not in kept][:1]
        changed = ["other" if w in loose else w for w in words]
        broken = passage.replace(keys[0], " ".join(reversed(keys[0].split())))
        cut = t.keys[0][1] + len(t.keys[0][0])  # words come between, after a key phrase
        for j, text in enumerate([passage, " ".join(changed), "/* " + " ".join(words[:cut] + ["//", "so", "to", "say"] + words[cut:]).upper() + " */", broken]):
            docs.append((10 * k + j, text))
            want[10 * k + j] = label if j < 3 else None
    found = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, docs)).collect()}
    for i, label in want.items():
        labels = found[i]["labels"].split(",")
        assert label is None or label in labels, (i, label, found[i])
        if i % 10 == 0:
            assert found[i]["score"] == 1
    # Where a notice's key phrase is broken, the notice by itself gives no label.
    only = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(frame(spark, docs), extra=[]).collect()}
    assert all(only[i] == "" for i in want if i % 10 == 3)
    assert all(want[i] in only[i].split(",") for i in want if want[i])
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    more = [*docs, (900, None), (None, "cc by nc cc by nc"), (901, "license " * 3000), (902, "under the mit license " * 500), (902, "by nc cc by")]
    db.executemany("insert into documents values (?, ?)", more)
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    assert order(map(tuple, licenses.scan_licenses(frame(spark, more)).collect())) == order(db.execute(licenses.oracle_sql()).fetchall())
