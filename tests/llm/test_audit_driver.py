"""What the audit of filters asks of the driver: no table that grows is broadcast, and plans are one for each level."""

from skyloom.llm import filter_audit

FOLDER = "/root/testdata/sf0.001"


def test_no_growing_broadcast_and_a_table_for_each_level(spark, monkeypatch):
    plans, keep = {}, filter_audit.Scratch.keep

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def kept(self, df, name):
        plans[name] = plan(df)
        return keep(self, df, name)

    monkeypatch.setattr(filter_audit.Scratch, "keep", kept)
    # Labels of some KB, which Spark would broadcast sixteenfold.
    out = filter_audit.audit_filters(*(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")))
    assert "SortMergeJoin" in plans["verdicts"] and not [n for n, p in plans.items() if "Broadcast" in p]
    # The constant table of steps alone.
    assert plan(out).count("BroadcastExchange") == 1
    assert sorted(plans) == [*(f"edges-{k}" for k in range(5)), "slim", "verdicts"]
