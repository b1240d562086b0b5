"""What every filter removes in every order: a trie of filter orders over persisted survivors.

The conditions of all filters are evaluated once for each whole text and written as slim rows (part,
labels, one boolean for each filter). From there a walk by levels applies one filter after another to
the survivors of its prefix. Orders with the same set of filters behind them have the same survivors,
so a prefix is an unordered set: it is visited once (5 filters: 31 sets instead of 325 prefixes). The
survivors of all sets of a size are persisted while the next size is made from them, and one aggregation
over them counts what each next filter really removes (80 edges in 5 tables; a plan for each set would
fill the driver). Orders are then a join of their steps with the edges.

Copies (filter E) are found by a digest of the text: one row for each text that repeats, with its
smallest doc_id, joins the rows over a written salt, so that no group of copies meets in one task.
Labels join the same way. Nothing is collected; what is broadcast is the constant table of steps. All
other joins are told to sort and merge: Spark takes a table's size from its files, without the copies
for each salt, and would broadcast millions of rows through the driver.

Defined results: a null text is empty; a null lang is the part ''; labels that repeat a doc_id count
as their maximum; a null doc_id has no labels, is never a copy and makes none; rows that repeat a
doc_id are documents of their own and no copies of each other; no documents, no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import combinations, permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch, text_or_empty

#: Copies of the right side of a join; a key's rows on the left are dealt over as many tasks.
SALTS = 16
COUNTS = ["kept", "removed", "good_lost", "toxic_lost"]

#: The filter of copies; it is not a condition on one text.
COPIES = "E"


def text_failures() -> dict[str, Column]:
    """Conditions under which a text fails."""
    words, capitals = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": (F.length("text") - F.length(F.translate("text", capitals, ""))) * 100 > F.length("text") * 10,
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def _salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(copies.hint("merge"), [key, "salt"], "left")


def verdicts(docs: DataFrame, labels: DataFrame, scratch: Scratch, failures: Mapping[str, Column] | None = None, copies: str = COPIES) -> DataFrame:
    """(part, good, toxic, one boolean for each filter), written; a row for each document."""
    failures = text_failures() if failures is None else failures
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    slim = src.select("doc_id", "part", F.sha2("text", 256).alias("digest"), (F.monotonically_increasing_id() % SALTS).cast("int").alias("salt"), *[c.alias(f) for f, c in failures.items()])
    slim = scratch.keep(slim, "slim")
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    of = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = _salted(_salted(slim, first, "digest"), of.where("doc_id is not null"), "doc_id")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return scratch.keep(found.select("part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), *failures, copy.alias(copies)), "verdicts")


def edges(rows: DataFrame, letters: str, scratch: Scratch) -> DataFrame:
    """(part, state, filter, kept, removed, good_lost, toxic_lost): what a filter removes from the survivors of a set of filters.

    By levels; a state is the sorted string of the filters behind it, made from that without its last one. Parts without survivors have no row.
    """
    lost = [F.struct(F.lit(x).alias("filter"), F.count_if(F.col(x)).alias("removed"), *[F.count_if(F.col(x) & (F.col(c) == 1)).alias(f"{c}_lost") for c in ("good", "toxic")]) for x in letters]

    def count(survivors: DataFrame) -> DataFrame:
        found = survivors.groupBy("part", "state").agg(F.count("*").alias("n"), F.array(*lost).alias("lost")).select("part", "state", "n", F.explode("lost").alias("x")).select("part", "state", "n", "x.*")
        return found.where(~F.col("state").contains(F.col("filter"))).select("part", "state", "filter", (F.col("n") - F.col("removed")).alias("kept"), "removed", "good_lost", "toxic_lost")

    def below(survivors: DataFrame) -> DataFrame:
        states = F.array(*[F.when(~F.col(x) & (F.right("state", F.lit(1)) < x), F.concat("state", F.lit(x))) for x in letters])
        return survivors.withColumn("state", F.explode(F.array_compact(states)))

    survivors = rows.withColumn("state", F.lit("")).persist(StorageLevel.MEMORY_AND_DISK)
    done = [scratch.keep(count(survivors), "edges-0")]
    for k in range(1, len(letters)):
        above, survivors = survivors, below(survivors).persist(StorageLevel.MEMORY_AND_DISK)
        done.append(scratch.keep(count(survivors), f"edges-{k}"))
        above.unpersist()
    survivors.unpersist()
    return rows.sparkSession.read.schema(done[0].schema).parquet(*[f"{scratch.root}/edges-{k}" for k in range(len(letters))])


def audit_filters(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None, copies: str = COPIES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for all orders of the filters."""
    failures = text_failures() if failures is None else failures
    spark, scratch, letters = docs.sparkSession, Scratch(docs.sparkSession), "".join(sorted([*failures, copies]))
    found = edges(verdicts(docs, labels, scratch, failures, copies), letters, scratch)

    names = [F.struct(F.lit("".join(s)).alias("state"), F.lit(x).alias("filter")) for k in range(len(letters)) for s in combinations(letters, k) for x in letters if x not in s]
    # Parts whose documents are all gone count as 0.
    zeros = found.where((F.col("state") == "") & (F.col("filter") == letters[0])).select("part", F.explode(F.array(*names)).alias("at")).select("part", "at.*", *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    full = found.unionByName(zeros).groupBy("part", "state", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])

    n = len(letters)
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.length("state") + 1)
    alone = F.sum(F.when(F.length("state") == n - 1, F.col("removed")))
    own = full.groupBy("part", "filter").agg(F.sum(F.when(F.col("state") == "", F.col("removed"))).alias("fails"), alone.alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley"))
    steps = spark.createDataFrame([("".join(p), k + 1, "".join(sorted(p[:k])), p[k]) for p in permutations(letters) for k in range(n)], "filter_order string, step int, state string, filter string")
    out = full.join(own.hint("merge"), ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle_sql() -> str:
    """The same by brute force: every order's every step over counts of documents by the set of filters that they fail."""
    letters = "ABCDE"
    bit = {x: 1 << i for i, x in enumerate(letters)}
    return f"""with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words, length(regexp_replace(text, '[^A-Z]', '', 'g')) as capitals, min(doc_id) over (partition by text) as first from d),
m as (select doc_id, part, cast(len(words) < 100 as integer) * {bit["A"]} + cast(100 * len(list_distinct(words)) < 80 * len(words) as integer) * {bit["B"]} + cast(100 * capitals > 10 * length(text) as integer) * {bit["C"]}
  + cast(regexp_matches(text, '[#$%&*|]') as integer) * {bit["D"]} + cast(coalesce(first < doc_id, false) as integer) * {bit["E"]} as mask from w),
l as (select doc_id, max(cast(quality = 1 as integer)) as good, max(cast(toxic = 1 as integer)) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l using (doc_id) group by part, mask),
f as (select unnest(range(0, 5)) as i),
p as (select [a.i, b.i, c.i, d.i, e.i] as o from f a, f b, f c, f d, f e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select list_aggregate([chr(cast(65 + x as integer)) for x in o], 'string_agg', '') as filter_order, k + 1 as step, 1 << cast(o[k + 1] as integer) as own, coalesce(list_sum([1 << cast(x as integer) for x in o[1:k]]), 0) as before from p, (select unnest(range(0, 5)) as k)),
r as (select part, filter_order, cast(step as integer) as step, own, sum(case when (mask & cast(before + own as bigint)) = 0 then n else 0 end) as kept, sum(case when (mask & cast(before as bigint)) = 0 and (mask & own) <> 0 then n else 0 end) as removed,
  sum(case when (mask & cast(before as bigint)) <> 0 and (mask & own) <> 0 then n else 0 end) as redundant, sum(case when mask = own then n else 0 end) as unique_fails,
  sum(case when (mask & cast(before as bigint)) = 0 and (mask & own) <> 0 then good else 0 end) as good_lost, sum(case when (mask & cast(before as bigint)) = 0 and (mask & own) <> 0 then toxic else 0 end) as toxic_lost from c, s group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from r"""
