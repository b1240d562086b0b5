"""Repeated strings where rows share a doc_id."""

import hashlib

import pytest

from tests.llm.test_documents import brute_removed
from tests.llm.texts import frame, rows, sentences

from skyloom.llm import suffix_dedup


def test_repeated_rows_and_two_texts_under_one_id(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    shared, other = sentences(6, 60), sentences(7, 60)
    docs = [(i, sentences(10 + i, 20) + " " + shared + " " + sentences(50 + i, 20)) for i in range(1, 5)]
    docs += [docs[0], docs[0], docs[2], (2, sentences(90, 30) + " " + other), (7, other), (None, other), (None, shared + " end"), (None, shared + " end"), (8, None), (8, None)]
    order = sorted({(i, t or "") for i, t in docs}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = brute_removed([(r, r[1]) for r in order])
    found = suffix_dedup.remove_repeats(frame(spark, docs).repartition(3)).collect()
    key = lambda r: (r[0] is not None, r)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=key) == sorted(((i, *want[i, t or ""]) for i, t in docs), key=key)


@pytest.mark.parametrize("least", [50, 200])
def test_other_lengths(spark, least, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    shared = sentences(6, 120)
    docs = [(i, t or "") for i, t in rows() if i != 18] + [(40 + i, sentences(60 + i, 9) + shared[: 600 - 180 * i]) for i in range(3)]
    found = suffix_dedup.remove_repeats(frame(spark, docs).repartition(3), least).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == brute_removed(sorted(docs), least)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame(spark, docs), 39)
