"""The join where doc_ids repeat or are missing."""

import numpy as np
import pyarrow as pa
from tests.llm.test_documents import brute_components
from tests.llm.texts import frame, sentences

from skyloom.llm import ngram_join


def test_texts_of_one_id_are_one_document(spark):
    x, y, z = (sentences(i, 40) for i in (400, 401, 402))
    docs = [(3, x), (3, y), (2, y), (1, x), (1, x), (9, z), (9, z), (None, x), (None, z), (8, ""), (8, None)]
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame(spark, docs)).collect()), key=str)
    assert found == sorted([(i, len(t.split()) - 4 if t else 0, {3: 1, 2: 1, 1: 1, 9: 9, 8: 8}.get(i)) for i, t in docs], key=str)


def test_one_row_of_each_component_stays(spark):
    near = sentences(500, 60).split()
    near[30] = "changed"
    docs = [(5, sentences(500, 60)), (5, sentences(500, 60)), (7, " ".join(near)), (None, sentences(500, 60)), (None, sentences(501, 30)), (None, sentences(501, 30)), (6, sentences(502, 30)), (6, ""), (6, "")]
    df = frame(spark, docs)
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, sentences(500, 60)), (None, sentences(501, 30)), (6, sentences(502, 30)), (6, ""), (6, "")], key=str)


def test_brute_force_knows_the_rule():
    x = sentences(1, 30)
    assert brute_components([(1, x), (2, x)]) == {1: (26, 1), 2: (26, 1)}


def test_a_batch_is_read_in_parts_of_bounded_size():
    texts = [None, "", *(sentences(i, 5 + 40 * (i % 3)) for i in range(60)), "x" * 5000, None, "Ä b\tC\x0bd e f"]
    parts = list(ngram_join._in_parts(pa.array(texts), 1000))
    assert [t for p in parts for t in p.to_pylist()] == texts and len(parts) > 10
    assert max(sum(len(t or "") for t in p.to_pylist()[1:]) for p in parts) <= 1000
    whole = ngram_join.shingle_sets([t and t.encode() for t in texts])
    cut = [s for p in parts for s in ngram_join.shingle_sets(p.cast(pa.binary()).to_pylist())]
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True)) and list(map(len, whole))[-1] == 2
    assert list(ngram_join._in_parts(pa.array([], pa.string()))) == []
