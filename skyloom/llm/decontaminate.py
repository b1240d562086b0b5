"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A fixed mask keeps some of a run of tokens and ignores the others, so that a changed word leaves the
hashes of the masks that ignore it. The masked hashes at every word of every document are joined with
those of the benchmark items; a hit fixes how item and document are aligned. Around it the overlap is
verified word by word: in some window of WINDOW words (or the whole item, if shorter) at least LEAST
of the words must be equal, wherever the others were substituted.

Items of fewer than SHORT words are too short for the masks. They are sought by every run of as many
words as any allowed substitutions leave whole somewhere (run_length), so none of their overlaps is
missed. Documents get hashes of such runs only where the benchmark has items that need them. For items
of 15 words the masks find 0.976 of those with three words changed, from 18 words on over 0.999.

The benchmark's hashes are broadcast only while there are at most BROADCAST_ROWS of them; beyond
that the join is by shuffle.

Defined results: words are runs of letters and digits, lower-cased; null and empty texts have none;
items without words are not searched for; a null doc_id or item_id gives no rows;
repeated rows give their pair once; extra columns are ignored; start_word is below 0 where an item's
head hangs out before the document; of equally good places the first one is given.

A document of repeated words is compared in time that grows with its words and the item's, not with
their product's hits; only the words at the remaining shifts are compared, in one running sum each.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch

# The masks; 1 keeps a token.
MASKS = ("11101011", "110100111", "1100110101")
RUNS = ("1", "11", "111", "1111")
WINDOW, LEAST, SHORT, BROADCAST_ROWS = 20, 0.8, 15, 500_000


def run_length(n: int) -> int:
    """The longest run that stays whole in n words wherever the allowed substitutions fall."""
    whole = math.ceil(n * LEAST)
    return math.ceil(whole / (n - whole + 1))


def masks_for(n: int) -> tuple[str, ...]:
    return MASKS if n >= SHORT else (RUNS[run_length(n) - 1],)


def words_of(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " ", -1))


def _seeds(table: DataFrame, key: str, masks: tuple[str, ...]) -> DataFrame:
    """Masked hashes at every word: key, mask, pos, seed. Only the hashes are exploded, not the words with them."""

    def at(word: Column, i: Column) -> Column:
        hashes = []
        for mask in masks:
            kept = [F.get("words", i + j) for j, x in enumerate(mask) if x == "1"]
            hashes.append(F.when(i + (len(mask) - 1) < F.size("words"), F.xxhash64(F.lit((MASKS + RUNS).index(mask)), *kept)))
        return F.array(*hashes)

    every = table.select(key, F.posexplode(F.flatten(F.transform("words", at))).alias("place", "seed"))
    mask = F.get(F.array(*[F.lit((MASKS + RUNS).index(m)) for m in masks]), F.col("place") % len(masks))
    return every.filter("seed is not null").select(key, mask.alias("mask"), F.floor(F.col("place") / len(masks)).cast("int").alias("pos"), "seed")


def _first_of_diagonals(seeds: DataFrame, key: str) -> DataFrame:
    """Beside each seed the one of the same mask a word before it (null, if that is not among the rows).

    Where both sides' words before a hit agree too, that hit has the same shift already: only the first
    hit of each run along a diagonal is needed, so that a word repeated n times meets one repeated m
    times in n + m places instead of n * m.
    """
    w = Window.partitionBy(key, "mask").orderBy("pos")
    before = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lag("seed").over(w))
    return seeds.withColumn("before", before)


def _best_window(doc: Column, item: Column, shift: Column) -> Column:
    """The most equal words in any window of the item, laid over the document at a shift: a running sum."""
    length = F.least(F.size(item), F.lit(WINDOW))

    def equal(k: Column) -> Column:
        return F.when(F.get(doc, shift + k) == F.get(item, k), 1).otherwise(0)

    def step(state: Column, k: Column) -> Column:
        now = state["now"] + equal(k) - F.when(k >= length, equal(k - length)).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["best"], state["now"]).alias("best"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), zero, step, lambda s: F.greatest(s["best"], s["now"]))


def _best_shift(doc: Column, item: Column, shifts: Column) -> Column:
    """(n, before): the most equal words at any shift and the smallest such shift, negated.

    Shifts are tried in ascending order; once all words of a window are equal no later one can be better.
    """

    def step(best: Column, s: Column) -> Column:
        here = F.struct(_best_window(doc, item, s).alias("n"), (-s).alias("before"))
        return F.when(best["n"] >= F.least(F.size(item), F.lit(WINDOW)), best).otherwise(F.greatest(best, here))

    return F.aggregate(F.array_sort(shifts), F.struct(F.lit(-1).alias("n"), F.lit(0).alias("before")), step)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_equal (words, in the best window), window, start_word for each contaminated pair."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("words")).distinct()
    # At most SHORT - 1 lengths come to the driver.
    n = F.size("words")
    lengths = [r.n for r in items.filter((n > 0) & (n < SHORT)).select(n.alias("n")).distinct().collect()]
    by_mask = {MASKS: n >= SHORT} | {(run,): n.isin(having) for run in RUNS if (having := [x for x in lengths if masks_for(x) == (run,)])}
    parts = [_seeds(items.filter(which), "item_id", masks) for masks, which in by_mask.items()]
    scratch = Scratch(docs.sparkSession)
    tests = scratch.keep(_first_of_diagonals(reduce(DataFrame.unionByName, parts), "item_id"), "tests")
    small = tests.limit(broadcast_rows + 1).count() <= broadcast_rows
    sized = F.broadcast if small else lambda t: t
    d = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", words_of(F.col("text")).alias("words"))
    known = _seeds(d, "doc_id", sum(by_mask, ())).join(sized(tests.select("seed").distinct()), "seed", "left_semi")
    # Of the documents only words whose hashes the benchmark has are left: few rows, numbered by document.
    known = _first_of_diagonals(known, "doc_id").withColumnRenamed("before", "doc_before")
    t = sized(tests.select("item_id", "seed", "before", F.col("pos").alias("item_pos")))
    met = known.join(t, "seed").filter(F.col("doc_before").isNull() | F.col("before").isNull() | (F.col("doc_before") != F.col("before")))
    # The shifts of a pair are fewer than the words of both; written, their size is known when they fetch their words.
    shifts = met.groupBy("doc_id", "item_id").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts"))
    hits = d.join(scratch.keep(shifts, "hits"), "doc_id").join(items.withColumnRenamed("words", "item"), "item_id")
    best = _best_shift(F.col("words"), F.col("item"), F.col("shifts"))
    found = hits.select("doc_id", "item_id", best.alias("b"), F.least(F.size("item"), F.lit(WINDOW)).cast("long").alias("window"))
    found = found.select("doc_id", "item_id", F.col("b.n").cast("long").alias("n_equal"), "window", (-F.col("b.before")).alias("start_word"))
    found = found.filter(F.col("n_equal") >= F.col("window") * LEAST)
    best = F.max_by(F.struct("n_equal", "window", "start_word"), F.struct("n_equal", -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_equal", "b.window", F.col("b.start_word").cast("long").alias("start_word"))


def oracle_sql(window: int = WINDOW, least: float = LEAST) -> str:
    """DuckDB SQL for the same rows."""
    seeds = []
    for k, mask in enumerate(MASKS + RUNS):
        lengths = [n for n in range(1, SHORT) if mask in masks_for(n)]
        used = f"len(w) in ({', '.join(map(str, lengths))})" if lengths else f"len(w) >= {SHORT}"
        kept = ", ".join(f"w[pos + {i}]" for i, x in enumerate(mask) if x == "1")
        # Only the benchmark's own lengths decide which masks an item has; documents have all that some item needs.
        seeds.append((used, f"select id, w, pos - 1 as pos, {k} as mask, [{kept}] as seed from places where pos + {len(mask) - 1} <= len(w)"))
    chosen = {
        "benchmark": [f"{sql} and {used}" for used, sql in seeds],
        "documents": [f"{sql} and exists (from keys where mask = {k})" for k, (_, sql) in enumerate(seeds)],
    }
    side = lambda table, key: f"""  select id, w, mask, seed, pos from (
    with t as (select {key} as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from {table} where {key} is not null),
    places as (select id, w, unnest(range(1, len(w) + 1)) as pos from t)
    {" union all ".join(chosen[table])})"""  # noqa: E731
    return f"""
with test as materialized (
{side("benchmark", "item_id")}
), keys as (select distinct mask, seed from test),
train as (
{side("documents", "doc_id")}
), hits as (
  select distinct d.id as doc_id, t.id as item_id, d.pos - t.pos as shift, d.w as dw, t.w as tw
  from (select * from train semi join keys using (mask, seed)) d join test t using (mask, seed)
), scored as (
  select doc_id, item_id, shift, least(len(tw), {window}) as win,
    list_transform(range(1, len(tw) + 1), lambda k: case when shift + k >= 1 and dw[shift + k] = tw[k] then 1 else 0 end) as eq, len(tw) as n
  from hits
), best as (
  select doc_id, item_id, shift, win,
    list_max(list_transform(range(1, n - win + 2), lambda s: list_sum(list_slice(eq, s, s + win - 1)))) as n_equal
  from scored
)
select doc_id, item_id, max(n_equal)::bigint as n_equal, arg_max(win, n_equal)::bigint as window,
  min(shift) filter (where n_equal = top)::bigint as start_word
from (select *, max(n_equal) over (partition by doc_id, item_id) as top from best where n_equal >= win * {least}) x
group by doc_id, item_id"""


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that overlap a benchmark item; a null doc_id is kept."""
    return docs.join(find_overlaps(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
