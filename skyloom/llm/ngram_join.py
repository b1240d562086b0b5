"""Set similarity join of word shingles by vertical partitioning of the global shingle order.

The global order puts rare shingles first: a sketch of document counts (fixed size, summed over all
tasks) tells which hashes are far more common than the mean, and the order is (commonness, hash).
Two sets of similarity t or more share one of their first n - ceil(t n) + 1 shingles in any such
order, so those are the join keys, and shingles that very many documents share come last.

A candidate pair is first held against the sketches of both sets (how many shingles fall in each of
PROFILE ranges), which bound their overlap; only the documents of pairs that may link are read again.
Those pairs are verified by fragments: the order is cut into ranges, each set into its segments by
range, the overlap of a pair is counted for each fragment separately and summed.

Equal sets are one class, numbered in a written table, and classes take part, not documents. Groups of
near copies would make a square of pairs, so the join works by rounds: in each, a class is compared
with pivots of the buckets that it shares (a few, those with most buckets in common) unless both
are connected already. The pivot of a bucket is its most central class, that whose keys the
most others share: an original rather than one of its copies. In the end every pair of a bucket whose
classes are still in different components is compared, so no connection is lost, while dense
groups have become one component before that; pairs within a component are not made (see _open_pairs).

Defined results: null, empty and blank texts have 0 shingles and are linked with nothing; texts of
the same set are linked; a null doc_id is linked with nothing and gets a null component; rows of one
doc_id are one document, linked with all that any of its texts is linked with (n_shingles is that of
the row's own text); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from skyloom.llm.common import KEY, Scratch, free_shuffles, packed_texts, row_key
from skyloom.llm.tokens import forget
from skyloom.operators.graph import components

CELLS, BLOCKS, FRAGMENTS, PROFILE, FULL, PART, BROADCAST_IDS, HELD_WORDS = 1 << 20, 16, 4, 512, 255, 6, 100_000, 150_000
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hashes of the words of a task; it starts anew at HELD_WORDS, so that workers stay small."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h



def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _in_parts(texts: pa.Array, size: int = 1_000_000) -> Iterator[pa.Array]:
    """Slices of texts of about so many bytes, at least one text each."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for i, j in pairwise(cuts):
        if i < j:
            yield texts.slice(i, j - i)


def shingle_sets(texts: list[bytes | None], k: int = 5, hashes: _Hashes | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each UTF-8 text; words are split at ASCII white space, A-Z lower-cased."""
    hashes, out, at = hashes if hashes is not None else _Hashes(), [], 0
    if len(hashes) > HELD_WORDS:
        hashes.clear()
    split = [(t or b"").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    run = np.zeros(max(len(flat) - k + 1, 0), np.uint64)
    for j in range(k):
        run = run * _P + flat[j : len(flat) - k + 1 + j]
    run = _mix(run)
    for n in sizes:
        if n >= k:
            out.append(np.unique(run[at : at + n - k + 1]))
        else:
            h = np.uint64(n)
            for w in flat[at : at + n]:
                h = np.uint64((int(h) * int(_P) + int(w)) & (2**64 - 1))
            out.append(_mix(np.array([h] if n else [], np.uint64)))
        at += n
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (id, n, key, sketch), and for each task the blocks of its table of shingle counts."""

    names = ["id", "n", "key_a", "key_b", "sketch", "block", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts, hashes = np.zeros(CELLS, np.uint32), _Hashes()

        def table(*columns: object) -> pa.RecordBatch:
            size = max(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            at = 0
            for part in _in_parts(batch.column("text")):
                sets = shingle_sets(part.cast(pa.binary()).to_pylist(), k, hashes)
                cells, n = np.unique(np.concatenate(sets) >> np.uint64(44), return_counts=True)
                counts[cells.astype(np.int64)] += n.astype(np.uint32)
                sketches = [np.bincount((s % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE).clip(max=FULL).astype(np.uint8).tobytes() for s in sets]
                keys = [set_key(s) for s in sets]
                yield table(batch.column("id").slice(at, len(sets)), list(map(len, sets)), [a for a, _ in keys], [b for _, b in keys], sketches, None, None)
                at += len(sets)
            pa.default_memory_pool().release_unused()
        yield table(None, None, None, None, None, list(range(BLOCKS)), [b.astype("<u4").tobytes() for b in counts.reshape(BLOCKS, -1)])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, key_a long, key_b long, sketch binary, block int, counts binary")


def _commonness(profile: DataFrame) -> np.ndarray:
    """For each cell how common its shingles are: 0 up to four times the mean, then by powers of two."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(CELLS // BLOCKS, np.int64)
        for c in pdf["counts"]:
            out += np.frombuffer(c, "<u4")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [out.tobytes()]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for b, c in zip(pdf["block"], pdf["counts"], strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(c, "<u4").astype(np.int64)
        yield pd.DataFrame({"block": list(sums), "counts": [np.minimum(v, 2**32 - 1).astype("<u4").tobytes() for v in sums.values()]})

    sketch = profile.filter("block is not null").select("block", "counts").coalesce(64).mapInPandas(partial, "block int, counts binary")
    blocks = sketch.groupBy("block").applyInPandas(total, "block int, counts binary").collect()
    counts = np.zeros((BLOCKS, CELLS // BLOCKS), np.int64)
    for b in blocks:
        counts[b["block"]] = np.frombuffer(b["counts"], np.int64)
    counts = counts.ravel()
    mean = max(counts.mean(), 1.0)
    return np.maximum(np.floor(np.log2(np.maximum(counts, 1) / mean)) - 1, 0).astype(np.uint8)


def in_order(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A set in the global order: less common first, then by hash."""
    c = common[(s >> np.uint64(44)).astype(np.int64)]
    return s[np.argsort(c, kind="stable")] if c.any() else s


def _keys(docs: DataFrame, k: int, percent: int, common) -> DataFrame:
    """(sig, key_a, n, rest): the first shingles of each set in the global order, and how many the set has from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in _in_parts(batch.column("text")):
                sets = shingle_sets(part.cast(pa.binary()).to_pylist(), k, hashes)
                own = [in_order(s, common.value)[: len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0] for s in sets]
                sizes, key, n = list(map(len, own)), np.array([set_key(s)[0] for s in sets], np.int64), np.array(list(map(len, sets)), np.int32)
                rest = [len(s) - np.arange(m, dtype=np.int32) for s, m in zip(sets, sizes, strict=True)]
                columns = [np.concatenate(own).view(np.int64), np.repeat(key, sizes), np.repeat(n, sizes), np.concatenate(rest).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "key_a", "n", "rest"])
            pa.default_memory_pool().release_unused()

    return docs.select("text").mapInArrow(run, "sig long, key_a long, n int, rest int")


def _segments(docs: DataFrame, wanted: DataFrame, k: int, common) -> DataFrame:
    """(id, fragment, segment) of the classes asked for (id, rep, key_a, key_b); a segment is a binary of sorted hashes.

    A class is read from the text of its document rep. A few documents are found by a broadcast of their ids; beyond BROADCAST_IDS of them the texts are shuffled, compressed.
    """
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = wanted.withColumnRenamed("id", "node")
    joined = docs.join(F.broadcast(wanted), F.col("id") == F.col("rep")) if few else packed_texts(docs).join(wanted, F.col("id") == F.col("rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, hashes = zstandard.ZstdDecompressor(), _Hashes()
        for batch in batches:
            at = 0
            for part in _in_parts(batch.column("text" if few else "z"), 1_000_000 if few else 250_000):
                texts = part.cast(pa.binary()).to_pylist()
                sets = shingle_sets(texts if few else [z.decompress(x) for x in texts], k, hashes)
                ids, a, b = (batch.column(c).slice(at, len(sets)).to_pylist() for c in ("node", "key_a", "key_b"))
                at += len(sets)
                rows = []
                for i, key, s in zip(ids, zip(a, b, strict=True), sets, strict=True):
                    if set_key(s) != key:
                        continue  # another text of the same id
                    c = common.value[(s >> np.uint64(44)).astype(np.int64)]
                    own = np.where(c > 0, FRAGMENTS - 1, (s >> np.uint64(40)).astype(np.int64) * (FRAGMENTS - 1) >> 24)
                    rows += [(i, f, s[own == f].tobytes()) for f in np.unique(own).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["id", "fragment", "segment"])
            pa.default_memory_pool().release_unused()

    return joined.select("node", "text" if few else "z", "key_a", "key_b").mapInArrow(run, "id long, fragment int, segment binary")


@F.pandas_udf(LongType())
def _most(a: pd.Series, b: pd.Series) -> pd.Series:
    """The most that two sets of these sketches can share; without bound if a range is full."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, PROFILE) for s in (a, b))
    low = np.minimum(x, y)
    return pd.Series(np.where((low == FULL).any(axis=1), 1 << 40, low.sum(axis=1, dtype=np.int64)))


@F.pandas_udf(LongType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, common, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that link: partial overlaps by fragment, summed."""
    enough = lambda o: 100 * o >= percent * (F.col("n_a") + F.col("n_b") - o)
    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("sketch").alias("s_a")), "a").join(classes.select(F.col("id").alias("b"), F.col("sketch").alias("s_b")), "b")
    near = scratch.keep(both.filter(enough(_most("s_a", "s_b"))).select("a", "b", "n_a", "n_b"), f"near-{name}")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = scratch.keep(ids.join(classes.select("id", "rep", "key_a", "key_b"), "id"), f"wanted-{name}")
    segments = scratch.keep(_segments(docs, wanted, k, common), f"segments-{name}")
    left = near.join(segments.select(F.col("id").alias("a"), "fragment", F.col("segment").alias("s_a")), "a")
    parts = left.join(segments.select(F.col("id").alias("b"), "fragment", F.col("segment").alias("s_b")), ["b", "fragment"])
    parts = parts.select("a", "b", "n_a", "n_b", "fragment", _overlap("s_a", "s_b").alias("o")).distinct()
    links = scratch.keep(parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("o").alias("o")).filter(enough(F.col("o"))).select("a", "b"), f"links-{name}")
    scratch.drop(f"near-{name}", f"wanted-{name}", f"segments-{name}")
    return links


def _possible(n_a, n_b, rest_a, rest_b, percent: int):
    """Whether two sets can link if this is the first shingle that they share: what is left of both suffices."""
    return (100 + percent) * F.least(rest_a, rest_b) >= percent * (n_a + n_b)


def _pivot_pairs(buckets: DataFrame, labels: DataFrame, salt: int, percent: int, each: int) -> DataFrame:
    """For each class at most `each` pivots of its buckets, those that most of its buckets name.

    In the first round a bucket has one pivot, the most central of its classes; later it is cut at random
    into parts of about PART classes, and each part has a pivot of its own.
    """
    part = F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col("m") / PART)) if salt else F.lit(0).cast("long")
    at = buckets.join(labels, "id").withColumn("part", part)
    pivots = at.groupBy("sig", "part").agg(F.max_by(F.struct("id", "n", "rest", "label"), F.struct("weight", "id")).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    met = at.join(pivots, ["sig", "part"]).filter("label <> p.label")
    met = met.filter(_possible(F.col("n"), F.col("p.n"), F.col("rest"), F.col("p.rest"), percent)).groupBy("id", "n", F.col("p.id").alias("pivot"), F.col("p.n").alias("pn")).agg(F.count("*").alias("c"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "pivot"))).filter(F.col("r") <= each)
    low = F.col("id") < F.col("pivot")
    return best.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), F.when(low, F.col("n")).otherwise(F.col("pn")).alias("n_a"), F.when(low, F.col("pn")).otherwise(F.col("n")).alias("n_b")).distinct()


def _open_pairs(buckets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket that are not connected yet and whose sizes allow a link.

    Of each open bucket, the classes outside its commonest component meet all of the bucket: of m classes
    with t in that component at most m (m - t) meetings, twice the pairs that are not connected.
    """
    at = buckets.join(labels, "id").select("sig", "id", "n", "rest", "label")
    parts = at.groupBy("sig", "label").agg(F.count("*").alias("c"))
    common = parts.groupBy("sig").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("sig", "top")
    at = at.join(common, "sig")
    x = at.filter("label <> top").select("sig", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("r_a"), F.col("label").alias("l_a"))
    y = at.select("sig", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("r_b"), F.col("label").alias("l_b"), "top")
    once = (F.col("a") < F.col("b")) | (F.col("l_b") == F.col("top"))
    p = x.join(y, "sig").filter((F.col("l_a") != F.col("l_b")) & once & _possible(F.col("n_a"), F.col("n_b"), F.col("r_a"), F.col("r_b"), percent))
    low = F.col("a") < F.col("b")
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(low, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(low, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct()


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2, each: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: components of 100 * intersection >= percent * union."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    d = docs.select(F.col("doc_id").alias("id"), "text")
    profile = scratch.keep(_profile(d, k), "profile")
    common = spark.sparkContext.broadcast(_commonness(profile))
    rows = profile.filter("block is null").select("id", "n", "key_a", "key_b")
    # A class is a set of shingles; its number is written with it.
    known = profile.filter("id is not null and n > 0").groupBy("key_a", "key_b", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(known.select(F.monotonically_increasing_id().alias("id"), "rep", F.col("n").cast("int").alias("n"), "key_a", "key_b", "sketch"), "classes")
    numbers = classes.select("key_a", "n", "id")

    sigs = scratch.keep(_keys(d.filter("id is not null"), k, percent, common), "sigs")
    shared = sigs.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1").select("sig")
    met = sigs.join(shared, "sig").join(numbers, ["key_a", "n"]).groupBy("sig", "id", "n").agg(F.max("rest").alias("rest"))
    met = scratch.keep(met, "met")
    scratch.drop("sigs")
    free_shuffles(spark)
    met = met.join(met.groupBy("sig").agg(F.count("*").alias("m")).filter("m > 1"), "sig")
    # How many meetings a class has in all its buckets tells how central it is.
    weights = met.groupBy("id").agg(F.sum("m").alias("weight"))
    buckets = scratch.keep(met.join(weights, "id").select("sig", "id", "n", "rest", "m", "weight"), "buckets")
    scratch.drop("met")
    free_shuffles(spark)

    labels = buckets.select("id", F.col("id").alias("label")).distinct()
    links = None
    for r in range(rounds + 1):
        pairs = _pivot_pairs(buckets, labels, r, percent, each) if r < rounds else _open_pairs(buckets, labels, percent)
        found = _verify(pairs, classes, d.filter("id is not null"), k, percent, common, scratch, str(r))
        free_shuffles(spark)
        links = found if links is None else links.unionByName(found)
        if r < rounds:
            joined = scratch.keep(components(links), f"labels{r}")
            labels = buckets.select("id").distinct().join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    # The texts of one doc_id belong together, too.
    owned = scratch.keep(rows.filter("id is not null and n > 0").join(classes.select("key_a", "key_b", F.col("n").cast("long").alias("n"), F.col("id").alias("class")), ["key_a", "key_b", "n"]).select("id", "class").distinct(), "owned")
    several = owned.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a <> z").select("id", "a")
    links = links.unionByName(owned.join(several, "id").select("a", F.col("class").alias("b")).filter("a <> b"))
    of = owned.join(components(links), F.col("class") == F.col("node"), "left").select("id", F.coalesce("label", "class").alias("label"))
    of = of.groupBy("id").agg(F.min("label").alias("label"))
    least = of.groupBy("label").agg(F.min("id").alias("component_id"))
    out = rows.join(of.join(least, "label").select("id", "component_id"), "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest doc_id (of rows that repeat it any one); rows without shingles stay.

    A row without an id is named by its text, after all ids.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select(row_key().alias("doc_id"), "text")
    found = scratch.keep(ngram_components(d, k, percent), "found")
    some = found.filter("n_shingles > 0")
    gone = scratch.keep(some.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    again = scratch.keep(some.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").join(gone, "doc_id", "left_anti").select("doc_id"), "again")
    keyed = docs.withColumn(KEY, row_key()).join(gone.withColumnRenamed("doc_id", KEY), KEY, "left_anti")
    again = again.withColumnRenamed("doc_id", KEY)
    # Only rows whose key repeats are compared with each other.
    one = keyed.join(again, KEY, "left_anti").select(docs.columns)
    several = keyed.join(again, KEY, "left_semi")
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x09-\x0D]", " ")) == ""
    kept = several.filter(~blank).dropDuplicates([KEY]).unionByName(several.filter(blank))
    return one.unionByName(kept.select(docs.columns))
