"""Perplexities do not depend on how files are split among tasks, not even when that changes during a run."""

from tests.llm.texts import sentences

from skyloom.llm import quality


def scores(spark, folder, labels):
    found = quality.classify_quality(spark.read.parquet(folder), labels, scan=True)
    return {r["doc_id"]: round(r["perplexity"], 6) for r in found.collect()}


def test_splits_that_change(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/documents"
    docs = [(i, "en", sentences(i, 30 + i % 7)) for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3).write.option("parquet.block.size", 4096).parquet(folder)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 600, 2)], "doc_id long, quality int")
    want = scores(spark, folder, labels)
    assert len(want) == 600
    kept, counts, keep = iter((1, 64, 3, 40, 2, 16) * 4), set(), quality.Scratch.keep

    def change(self, df, name):
        out = keep(self, df, name)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", str(next(kept)))
        counts.add(spark.read.parquet(folder).rdd.getNumPartitions())
        return out

    try:
        monkeypatch.setattr(quality.Scratch, "keep", change)
        assert scores(spark, folder, labels) == want
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert len(counts) > 2


def test_skipped_rows_start_new_blocks():
    import pandas as pd

    pdf = pd.DataFrame({"file": [1, 1, 1, 2, 2], "row": [0, 1, 5, 6, 7], "text": list("abcde")})
    assert ["".join(x["text"]) for x in quality._runs(pdf)] == ["ab", "c", "de"]
    assert [len(x) for x in quality._runs(pdf.head(0))] == [0]
