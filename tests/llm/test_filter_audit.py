"""Orders of filters against a plain loop over documents."""

import re
from itertools import permutations

import pytest
from tests.llm.texts import CLASHING, rows, sentences
from tests.oracle import compare
from pyspark.sql import functions as F

from skyloom.llm import filter_audit
from skyloom.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    failing = []
    for i, t, _ in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A"} if len(words) < 100 else set()
        own |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        own |= {"E"} if i is not None and first[text] < i else set()
        failing.append(own)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out, by_filter = {}, {}
    for part in {lang or "" for *_, lang in docs}:
        here = [(i, failing[k]) for k, (i, _, lang) in enumerate(docs) if (lang or "") == part]
        for order in permutations("ABCDE"):
            left = here
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                redundant = sum(x in f for _, f in here) - len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), redundant, sum(f == {x} for _, f in here), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                by_filter[part, x] = by_filter.get((part, x), 0) + len(gone)
    return {k: (*v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, docs, labels):
    d = spark.createDataFrame(docs, SCHEMA).select("*", *[F.lit("x").alias(c) for c in (*CLASHING, "part", "state", "salt", "A", "filter", "good")]).repartition(3)
    got = filter_audit.audit_filters(d, spark.createDataFrame(labels, LABELS)).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def documents():
    long = sentences(7, 150, [f"word{i}" for i in range(2000)])
    more = [long, long, long.title(), long + " $", "A" * 100, sentences(8, 120, ["same", "few"]), long + " #", "x\ty\x0bz\x1fq"]
    docs = [(i, t, lang) for (i, t), lang in zip(rows(), ["en", None, "", "fr", "xx"] * 9)]
    docs += [(100 + i, t, "en") for i, t in enumerate(more)]
    return [*docs, (None, long, "de"), (None, None, None), (101, long, "fr"), (101, long, "fr"), (3, "", "es")]


def test_every_order(spark):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (100, 1, 1), (101, None, 1), (7, 1, 0), (900, 1, 1)]
    assert found(spark, documents(), labels) == brute(documents(), labels)


def test_no_labels_and_no_documents(spark):
    docs = documents()[:6]
    assert found(spark, docs, []) == brute(docs, [])
    assert found(spark, [], [(1, 1, 1)]) == {}


def test_all_gone_still_counts(spark):
    got = found(spark, [(1, "short", "en")], [(1, 1, 0)])
    assert len(got) == 600 and got["en", "ABCDE", 1] == (0, 1, 0, 1, 1, 0, 120) and got["en", "BCDEA", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_states_are_visited_once(spark):
    scratch = filter_audit.Scratch(spark)
    v = spark.createDataFrame([("en", 0, 0, True, False, True)], "part string, good int, toxic int, A boolean, B boolean, C boolean")
    e = filter_audit.edges(v, "ABC", scratch)
    # Seven states of three filters without the last, of which those behind A or C have no survivors.
    assert {(r["state"], r["filter"]) for r in e.collect()} == {("", "A"), ("", "B"), ("", "C"), ("B", "A"), ("B", "C")}
    assert not spark.sparkContext._jsc.getPersistentRDDs()


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_vector_codes", "op13_html_text"])
def test_against_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01" if name == "op12_vector_codes" else "/root/testdata/sf0.001")
