"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted words.

A text's words (split at white space, lower-cased) are numbered by a hash below BUCKETS, and each word
is predicted from the one before it. The bigrams' counts are sharded by a hash of the bigram: a task
counts a block of texts and sends its sorted bigrams to each shard as one packed row, and a shard adds
them up. Totals, kinds of counts and continuation counts of single words are summed over the
shards into arrays whose size BUCKETS fixes; from them come the discounts, the unigram probabilities and
the back-off weights (the only part of the model that is broadcast: 3 arrays of BUCKETS doubles).

Scoring is a join by shard. The log probability of a text is the sum over its words of back-off weight
plus unigram log probability, which the reading task adds up, and over its seen bigrams of what the
bigram adds to that. So a block's bigrams go to the shards with the texts that hold them, meet the
counts there, and the sums come back to the block as one packed row from each shard (at most as many
numbers as the block has bigrams). No task and not the driver holds the bigrams. The shards are taken
in PASSES parts, each with a reading of the texts, so that only a part of the bigrams is on disk at a time.
A document is kept if its perplexity is at most the HIGH quantile of its language's trusted
documents that the model was not trained on.

Defined results: texts without words, null and empty ones among them, have a null perplexity and are
not kept; a null lang is a language of its own; a language without trusted documents keeps all;
repeated rows give repeated rows; a null doc_id is scored like any other; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch, free_shuffles, text_or_empty
from skyloom.llm.ngram_join import HELD_WORDS, _Hashes
from skyloom.llm.suffix_dedup import _chunks

BITS = 20
BUCKETS, START = 1 << BITS, 1 << BITS
BLOCK_BYTES, BLOCK_ROWS, SHARD_BYTES, LEAST_SHARDS, RANGES, PASSES = 6 << 20, 1 << 16, 16 << 20, 16, 16, 2
HIGH = 0.998
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pack(a: np.ndarray, kind: str) -> bytes:
    """Numbers by planes of bytes, compressed."""
    wide = np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return zstandard.ZstdCompressor(level=1).compress(wide.T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def word_numbers(texts: list[str], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words in order, and how many each text has."""
    if len(hashes) > HELD_WORDS:
        hashes.clear()
    split = [t.encode("utf-8", "replace").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), sizes


def bigrams(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word its number behind that of the word before, START at the first of a text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    first = np.cumsum(sizes) - sizes
    before[first[sizes > 0]] = START
    return before << BITS | words


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys.astype(np.uint64) * _ODD) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _runs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Cuts where a file ends or row numbers skip, so that a run's rows follow from its first one."""
    if "row" not in pdf:
        yield pdf
        return
    cuts = np.flatnonzero((np.diff(pdf["row"]) != 1) | (np.diff(pdf["file"]) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
        yield pdf.iloc[a:b]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    for pdf in chain.from_iterable(map(_runs, batches)):
        texts = list(pdf["text"])
        for x, y in _chunks(list(map(len, texts)), BLOCK_BYTES):
            for a in range(x, y, BLOCK_ROWS):
                b = min(a + BLOCK_ROWS, y)
                yield pdf.iloc[a:b], texts[a:b]


def _count(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, counts): the bigrams of the texts, in sorted and packed rows of at most BUCKETS each."""

    def cut(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        of = shard_of(keys, shards)
        order = np.argsort(of, kind="stable")
        keys, counts, of = keys[order], counts[order], of[order]
        at = np.flatnonzero(np.diff(of, prepend=-1))
        rows = [(of[a], pack(np.diff(keys[a:b], prepend=0), "<u8"), pack(counts[a:b], "<u8")) for a, b in zip(at, [*at[1:], len(keys)], strict=True)]
        return pd.DataFrame(rows, columns=["shard", "keys", "counts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, size = _Hashes(), [], 0
        for _, part in _blocks(batches):
            k, c = np.unique(bigrams(*word_numbers(part, hashes)), return_counts=True)
            held.append((k, c))
            size += len(k)
            if size > 3_000_000:
                yield cut(*merged(held))
                held, size = [], 0
        if size:
            yield cut(*merged(held))

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = merged([(np.cumsum(unpack(x, "<u8")), unpack(y, "<u8")) for x, y in zip(pdf["keys"], pdf["counts"], strict=True)])
        rows = [(key[0], pack(np.diff(k[a : a + BUCKETS], prepend=0), "<u8"), pack(c[a : a + BUCKETS], "<u8")) for a in range(0, len(k), BUCKETS)]
        return pd.DataFrame(rows, columns=["shard", "keys", "counts"])

    schema = "shard int, keys binary, counts binary"
    return texts.mapInPandas(run, schema).groupBy("shard").applyInPandas(add, schema)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _totals(table: DataFrame, scratch: Scratch) -> np.ndarray:
    """Over all bigrams, for each first word their count (row 0) and the number with count 1, 2 and 3 or more (1 to 3); for each second word the number of first words (4); and at the START of rows 1 to 4 the number of bigrams with count 1 to 4."""

    def rows(sums: np.ndarray) -> pd.DataFrame:
        parts = np.array_split(sums, RANGES, axis=1)
        return pd.DataFrame({"part": range(RANGES), "sums": [pack(p.ravel(), "<u8") for p in parts]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((5, BUCKETS + 2), np.int64)
        for pdf in batches:
            for x, y in zip(pdf["keys"], pdf["counts"], strict=True):
                k, c = np.cumsum(unpack(x, "<u8")), unpack(y, "<u8")
                v = k >> BITS
                sums[0] += np.bincount(v, c, BUCKETS + 2).astype(np.int64)
                for j in (1, 2, 3):
                    sums[j] += np.bincount(v[c == j if j < 3 else c >= 3], minlength=BUCKETS + 2)
                sums[4] += np.bincount(k & (BUCKETS - 1), minlength=BUCKETS + 2)
                for j in (1, 2, 3, 4):
                    sums[j, BUCKETS + 1] += int((c == j).sum())
        yield rows(sums)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for part, x in zip(pdf["part"], pdf["sums"], strict=True):
                sums[part] = sums.get(part, 0) + unpack(x, "<u8")
        yield pd.DataFrame({"part": list(sums), "sums": [pack(s, "<u8") for s in sums.values()]})

    schema = "part int, sums binary"
    each = scratch.keep(table.select("keys", "counts").mapInPandas(partial, schema), "partial")
    # A task adds up what some of the tasks before have found, so a range has at most 64 rows.
    few = each.coalesce(64).mapInPandas(again, schema).repartition(RANGES, "part")
    found: dict[int, np.ndarray] = {}
    for r in few.mapInPandas(again, schema).collect():
        found[r["part"]] = unpack(r["sums"], "<u8").reshape(5, -1)
    sizes = [p.shape[1] for p in np.array_split(np.zeros((5, BUCKETS + 2), np.int8), RANGES, axis=1)]
    return np.concatenate([found.get(i, np.zeros((5, n), np.int64)) for i, n in enumerate(sizes)], axis=1)


def discounts(n: list[int]) -> np.ndarray:
    """The discount of counts 0, 1, 2 and 3 or more from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = [max(int(x), 1) for x in n]
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *[min(max(j - (j + 1) * y * b / a, 0.05), j - 0.05) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]])


class Model:
    """What single words need: log probability, log back-off weight and total of each; and the bigrams' discounts."""

    def __init__(self, totals: np.ndarray):
        own = totals[4, :BUCKETS]
        d = discounts([(own == j).sum() for j in (1, 2, 3, 4)])
        c = max(int(own.sum()), 1)
        left = d[np.minimum(own, 3)].sum() / c if own.any() else 1.0
        self.uni = np.log((own - d[np.minimum(own, 3)]) / c + left / BUCKETS)
        self.d = discounts([totals[j, BUCKETS + 1] for j in (1, 2, 3, 4)])
        self.total = np.maximum(totals[0, : BUCKETS + 1], 1)
        rest = totals[1:4, : BUCKETS + 1].T @ self.d[1:]
        self.back = np.where(totals[0, : BUCKETS + 1] > 0, np.log(np.maximum(rest, 1e-300) / self.total), 0.0)

    def base(self, keys: np.ndarray) -> np.ndarray:
        """What a word has behind another one if the two were not seen together."""
        return self.back[keys >> BITS] + self.uni[keys & (BUCKETS - 1)]

    def gain(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What seen bigrams have more than that."""
        base = self.base(keys)
        return np.log((counts - self.d[np.minimum(counts, 3)]) / self.total[keys >> BITS] + np.exp(base)) - base


def _parts(rows: DataFrame, model, shards: int, at_pass: int) -> DataFrame:
    """(shard, file, block, keys, counts, docs) of blocks of consecutive rows: bigrams of the shards of a pass, how often the block has each and in which rows; in the first pass, under shards below 0, each row's words (counts) and base (docs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, m = _Hashes(), model.value
        for pdf, part in _blocks(batches):
            words, sizes = word_numbers(part, hashes)
            keys, row = bigrams(words, sizes), np.repeat(np.arange(len(part)), sizes)
            file, first, out = int(pdf["file"].iloc[0]), int(pdf["row"].iloc[0]), []
            if not at_pass:
                sums = np.bincount(row, m.base(keys), len(part))
                out.append((-1 - (file ^ first) % shards, file, first, b"", pack(sizes, "<u8"), sums.astype("<f8").tobytes()))
            now = shard_of(keys, shards) % PASSES == at_pass
            both = np.sort(keys[now] << 16 | row[now])
            keys = both >> 16
            at = np.flatnonzero(np.diff(keys, prepend=-1))
            n = np.diff(np.append(at, len(keys)))
            of = shard_of(keys[at], shards)
            order = np.argsort(of, kind="stable")
            n, of, own = n[order], of[order], keys[at][order]
            ends = np.cumsum(n)
            docs = (both & 0xFFFF)[np.repeat(at[order] - (ends - n), n) + np.arange(len(both))]
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(of)], strict=False):  # no cuts in an empty block
                out.append((of[a], file, first, pack(np.diff(own[a:b], prepend=0), "<u8"), pack(n[a:b], "<u4"), pack(docs[ends[a] - n[a] : ends[b - 1]], "<u2")))
            yield pd.DataFrame(out, columns=["shard", "file", "block", "keys", "counts", "docs"])

    return rows.mapInPandas(run, "shard int, file long, block long, keys binary, counts binary, docs binary")


def _meet(model):
    """Meets the counts of a shard with the blocks' bigrams: (file, block, docs, sums, counts), a row for each block."""

    def run(counts: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        m, out = model.value, []
        known = [(np.cumsum(unpack(x, "<u8")), unpack(y, "<u8")) for x, y in zip(counts["keys"], counts["counts"], strict=True)]
        keys, c = merged(known) if known else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        gain = np.append(m.gain(keys, c), 0.0)
        for shard, file, first, k, n, docs in zip(blocks["shard"], blocks["file"], blocks["block"], blocks["keys"], blocks["counts"], blocks["docs"], strict=True):
            if shard < 0:
                out.append((file, first, b"", docs, n))
                continue
            k = np.cumsum(unpack(k, "<u8"))
            at = np.searchsorted(keys, k)
            at = np.where(np.append(keys, -1)[at] == k, at, len(keys))
            sums = np.bincount(unpack(docs, "<u2"), np.repeat(gain[at], unpack(n, "<u4")))
            used = np.flatnonzero(sums)
            out.append((file, first, pack(used, "<u2"), sums[used].astype("<f8").tobytes(), b""))
        return pd.DataFrame(out, columns=["file", "block", "docs", "sums", "counts"])

    return run


def _back(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """The sums of a block's rows: (file, row, log_p, n)."""
    docs = [unpack(d, "<u2") if d else np.arange(len(s) // 8) for d, s in zip(parts["docs"], parts["sums"], strict=True)]
    log_p = np.bincount(np.concatenate(docs), np.frombuffer(b"".join(parts["sums"]), "<f8")) if docs else np.zeros(0)
    n = [unpack(c, "<u8") for c in parts["counts"] if c]
    return pd.DataFrame({"file": key[0], "row": key[1] + np.arange(len(log_p)), "log_p": log_p, "n": n[0] if n else 0})


def _named(docs: DataFrame, scan: bool, scratch: Scratch) -> DataFrame:
    """(file, row, doc_id, lang, text): rows named by a hash of their file and their place in it.

    Those names are the same however the files are split among tasks, so they may be found anew in each reading.
    """
    if not scan:
        docs = scratch.keep(docs.select("doc_id", "lang", "text"), "rows")
    at = docs.metadataColumn("_metadata")
    return docs.select(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"), "doc_id", "lang", text_or_empty().alias("text"))


def classify_quality(docs: DataFrame, labels: DataFrame, scan: bool = False) -> DataFrame:
    """doc_id, lang, perplexity, high (the language's bound), kept for each row.

    scan says that docs reads Parquet files as they are (columns may be chosen); other tables are written first.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("own")).distinct()
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = _named(docs, scan, scratch)
    d = rows.select("doc_id", "text")
    names = scratch.keep(rows.select("file", "row", "doc_id", "lang", F.octet_length("text").alias("bytes")), "names")
    shards = max(LEAST_SHARDS, (names.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES)
    trusted = d.filter(~held_out).join(good.hint("merge"), F.col("doc_id") == F.col("own"), "left_semi").select("text")
    counts = scratch.keep(_count(trusted, shards), "counts")
    del trusted
    free_shuffles(spark)
    model = spark.sparkContext.broadcast(Model(_totals(counts, scratch)))
    free_shuffles(spark)
    sums = None
    for k in range(PASSES):
        parts = _parts(rows.select("file", "row", "text"), model, shards, k)
        met = counts.groupBy("shard").cogroup(parts.groupBy("shard")).applyInPandas(_meet(model), "file long, block long, docs binary, sums binary, counts binary")
        own = scratch.keep(met.groupBy("file", "block").applyInPandas(_back, "file long, row long, log_p double, n long"), f"sums{k}")
        sums = own if sums is None else sums.unionByName(own)
        free_shuffles(spark)
    sums = sums.groupBy("file", "row").agg(F.sum("log_p").alias("log_p"), F.sum("n").alias("n"))
    scored = names.join(sums, ["file", "row"], "left")
    scored = scratch.keep(scored.select("doc_id", "lang", F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n"))).alias("perplexity")), "scored")
    free_shuffles(spark)
    scratch.drop("counts", "partial", "names", *[f"sums{k}" for k in range(PASSES)])
    known = scored.join(good, F.col("doc_id") == F.col("own"), "left_semi").filter(held_out & F.col("perplexity").isNotNull())
    bounds = known.groupBy(F.col("lang").alias("l")).agg(F.percentile_approx("perplexity", F.lit(HIGH), F.lit(100_000)).alias("high"))
    out = scored.join(F.broadcast(bounds), F.col("lang").eqNullSafe(F.col("l")), "left")
    inside = F.col("perplexity") <= F.coalesce("high", F.lit(float("inf")))
    return out.select("doc_id", "lang", "perplexity", "high", F.coalesce(inside, F.lit(False)).alias("kept"))
