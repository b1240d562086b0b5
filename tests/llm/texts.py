"""Small documents with everything that operators must stand: nulls, empties, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

CLASHING = ("id", "row", "h", "n", "k", "sig", "z", "own", "label", "words", "at", "length", "key", "n_chars")


def sentences(seed, n, words=None):
    rng = random.Random(seed)
    words = words or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def rows():
    base = sentences(1, 60)
    near = base.split()
    near[30] = "changed"
    out = [base, base, " ".join(near), base.upper(), None, "", "  \n", "one", "one", "two words", sentences(2, 12), sentences(3, 300), sentences(3, 300) + " " + sentences(4, 40), "é ß ñ 漢字 " * 12, "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " smile", "a" * 500, "ab" * 300, sentences(5, 8000)]
    shared = sentences(6, 60)
    out += [sentences(10 + i, 20) + " " + shared + " " + sentences(50 + i, 20) for i in range(5)]
    return list(enumerate(out, 1))


def frame(spark, data=None, clash=True):
    data = rows() if data is None else data
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in data], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns]) if clash else df
