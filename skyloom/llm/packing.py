"""Best-fit decreasing packing of tokenized documents into sequences of bounded length.

Texts are tokenized once in tasks. Which bin takes which piece depends on lengths alone, so the plan
is made from the number of pieces of each length: at most `capacity` rows, whatever the input. A
segment tree over the remaining capacities finds the tightest capacity that has an open bin in
logarithmic time; all bins of that capacity are then filled alike, just as if best-fit decreasing
had placed one document after another (a bin that took a piece is tighter than before, so it takes
the next one of that length too until that no longer fits). Pieces are numbered within their length
by a distributed count and look up their bin in the plan.

Defined results: null text is empty and gives one piece with the end id; repeated rows are packed
each; a null doc_id is kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch
from skyloom.llm.tokens import in_chunks, word_encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over capacities 0..n: how many runs of open bins each has."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, change: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += change
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that has a run."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts of lengths.

    Rows of the plan: length, first rank, first bin, pieces to a bin, tokens before them in the bin.
    Also the number of bins. Each length splits one run of bins at most, so the runs number a few
    times `capacity`, and the plan at most that for each length.
    """
    tree, runs, plan, bins = CapacityTree(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            runs.setdefault(left, []).append((first, n))
            tree.add(left, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and 0 < left < each:
                plan.append((length, rank, first + full, each, capacity - room))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                put(room, first + full, n - full)
    return np.array(plan, np.int64).reshape(-1, 5), bins


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens of each whole text, the end id included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(tokenizer)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in in_chunks(texts):
                ids, sizes = encoder.encode(texts[a:b])
                rows, at = [], 0
                for k, n in enumerate(sizes):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((a + k, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
                out["doc_id"] = pdf["doc_id"].take(out["doc_id"].to_numpy()).to_numpy()
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, PIECE + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of every document with their sequence_id and offset; with_ids adds their ids."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    pieces = scratch.keep(tokenize(docs, tokenizer, capacity, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    part = pieces.filter(F.col("length") < capacity)
    counts = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, bins = plan_bins(counts, capacity)
    # A rank within each length: over salted groups, so that no length lies in one task.
    salts = max(16, sum(counts.values()) // 200_000)
    salted = part.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")).cast("long") - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))
    shared = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, n, r = shared.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = p[np.searchsorted(p[:, 0] * -(1 << 44) + p[:, 1], n * -(1 << 44) + r, "right") - 1]
        slot = r - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 2] + slot // at[:, 3], "offset": at[:, 4] + slot % at[:, 3] * n})

    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    more = ["ids"] if with_ids else []
    placed = ranked.withColumn("at", place("length", "rank")).select(*cols, F.col("at.sequence_id"), F.col("at.offset"), *more)
    whole = pieces.filter(F.col("length") == capacity).select(*cols, (F.lit(bins) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *more)
    return placed.unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids. Needs pieces with ids; a group has one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
