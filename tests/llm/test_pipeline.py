import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.texts import sentences
from tests.oracle import compare

from skyloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_stages(spark, tmp_path):
    item = sentences(1, 40)
    old = [(i, sentences(100 + i, 40)) for i in range(8)]
    docs = [*old, (10, old[0][1]), (11, sentences(5, 30) + " " + item), (12, sentences(6, 30) + " password = hunter2222 end"), (13, None), (14, "")]
    bad = "awful disgusting trash people "
    docs += [(100 + i, bad + sentences(200 + i, 20)) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in out.collect()}
    assert kept == {*range(8), 12, 13, 14}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "secret_scan", "best_fit_packing"]
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, stage, str(tmp_path))
        assert after.columns == stage.columns
    redacted = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_secrets(spark, stage, str(tmp_path)).collect()}
    assert "hunter2222" not in redacted[12] and stage.where(F.col("doc_id") == 12).first()["text"] != redacted[12]
