"""Removal of repeated 100-byte strings by suffix arrays of shards.

Strings that are equal must meet in one shard, so the text is cut by its content. Every window of
`least` bytes has an anchor: the window's k-gram of smallest hash. Equal windows have equal anchors,
so the starts that share an anchor form a piece, and pieces are dealt to shards by anchor. A piece
whose anchor occurs once has no partner and is dropped by a count. Pieces of equal content are one
class, whose first place stands for it; every later place repeats the whole piece. The classes of an
anchor that differ go to a shard as snippets (the piece and the bytes that its last window needs).

A shard sorts its suffixes by induced sorting and finds the common prefixes of neighbours; a run of
neighbours that agree on `least` bytes holds the places of one string, and all but the first repeat
it. Anchors with very many classes are salted over shards of bounded size; each such shard
reports the first place of each of its strings under a 128-bit hash, and a grouped minimum over the
shards settles which of them is first of all.

Defined results: null text is empty; a null doc_id counts as the smallest and comes back null; rows
that repeat a doc_id and text are one document and get the same result; different texts under one
doc_id are documents of their own, in order of their SHA-256; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import NULL_ID, Scratch, free_shuffles, packed_texts
from skyloom.llm.ngram_join import _mix
from skyloom.llm.suffix_array import common_prefixes, suffix_array

GRAM, SHARD_BYTES, CLASSES, WIDE = 40, 2_000_000, 2000, 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


def _chunks(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def gram_hashes(t: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams, put together from those of lengths 1, 2, 4 and so on."""
    part, power, out, done = t.astype(np.uint64), _PRIME, None, 0
    m = len(t) - k + 1
    for bit in range(k.bit_length()):
        length = 1 << bit
        if k & length:
            own = part[done : done + m]
            out = own if out is None else out * power + own
            done += length
        if bit + 1 < k.bit_length():
            part = part[:-length] * power + part[length:]
            power = np.uint64(int(power) ** 2 % 2**64)
    return out


def pieces_of(data: bytes, bounds: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, document, start in data, number of starts) of the pieces of documents in data."""
    n = len(data)
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if n < least:
        return none
    h = _mix(gram_hashes(np.frombuffer(data, np.uint8), GRAM))
    value = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
    width, span = least - GRAM + 1, 1
    m = value
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    anchor = (m & _LOW).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(bounds, start, "right") - 1
    inside = start + least <= bounds[doc + 1]
    start, doc, anchor = start[inside], doc[inside], anchor[inside]
    if not len(start):
        return none
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    return h[anchor[new]], doc[new], start[new], np.diff(np.append(new, len(start)))


def _split_long(data: bytes, least: int, most: int = 1 << 23) -> Iterator[tuple[int, bytes]]:
    """A very long text in parts; every window starts in one part and lies in it whole."""
    for a in range(0, max(len(data), 1), most):
        yield a, data[a : a + most + least - 1]


def _pieces(docs: DataFrame, least: int) -> DataFrame:
    """(h, c, id, pos, n): anchor, content hash of the piece with its last window, place, number of starts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.encode("utf-8", "replace") for t in pdf["text"]]
            ids = pdf["id"].to_numpy(np.int64)
            parts = [(i, a, p) for i, t in enumerate(texts) for a, p in _split_long(t, least)]
            for x, y in _chunks([len(p) for _, _, p in parts]):
                data = b"".join(p for _, _, p in parts[x:y])
                bounds = np.concatenate([[0], np.cumsum([len(p) for _, _, p in parts[x:y]])])
                h, doc, start, n = pieces_of(data, bounds, least)
                own = np.array([parts[x + d][0] for d in range(y - x)], np.int64)
                base = np.array([parts[x + d][1] for d in range(y - x)], np.int64)
                ends = start + n + least - 1
                c = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)), np.uint64, len(start))
                yield pd.DataFrame({"h": h.view(np.int64), "c": c.view(np.int64), "id": ids[own[doc]], "pos": (start - bounds[doc] + base[doc] << WIDE) + n})

    return docs.mapInPandas(run, "h long, c long, id long, pos long")


def _snippets(docs: DataFrame, need: DataFrame, least: int) -> DataFrame:
    """(h, salt, hot, id, start, n, bytes) of the pieces asked for."""
    asked = need.groupBy("id").agg(F.collect_list(F.struct("h", "salt", "hot", "pos")).alias("at")).withColumnRenamed("id", "own")
    joined = packed_texts(docs).join(asked, F.col("id") == F.col("own")).select("id", "z", F.col("at.h").alias("h"), F.col("at.salt").alias("salt"), F.col("at.hot").alias("hot"), F.col("at.pos").alias("pos"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for pdf in batches:
            sizes = [len(x) for x in pdf["pos"]]
            flat = {name: np.concatenate([np.asarray(x) for x in pdf[name]]) for name in ("h", "salt", "hot", "pos")} if len(pdf) else None
            if flat is None:
                continue
            cut, at = [], 0
            start, n = flat["pos"] >> WIDE, flat["pos"] & (1 << WIDE) - 1
            a, b = start.tolist(), (start + n + least - 1).tolist()
            for packed, m in zip(pdf["z"], sizes, strict=True):
                data = z.decompress(packed)
                cut += [data[a[i] : b[i]] for i in range(at, at + m)]
                at += m
            yield pd.DataFrame({"h": flat["h"], "salt": flat["salt"], "hot": flat["hot"], "id": np.repeat(pdf["id"].to_numpy(), sizes), "start": start, "n": n, "bytes": cut})

    return joined.mapInPandas(run, "h long, salt int, hot boolean, id long, start long, n long, bytes binary")


def repeated_starts(snippets: list[bytes], n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over snippets in order of place: which starts repeat an earlier one, which are the first of their string, and the snippets' bounds."""
    data = np.frombuffer(b"".join(snippets), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in snippets])])
    sa = suffix_array(data)
    run = np.cumsum(common_prefixes(data, sa) < least)
    valid = np.zeros(len(data), bool)
    valid[np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = True
    keep = valid[sa]
    place, run = sa[keep], run[keep]
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    low = np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, len(place))))
    again, lead = np.zeros(len(data), bool), np.zeros(len(data), bool)
    again[place[place != low]] = True
    lead[low] = True
    return again, lead, bounds


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _shard(g: pd.DataFrame, least: int) -> Iterator[pd.DataFrame]:
    """Runs of repeated starts (id, a, b), and for hot anchors the first place of each string (w1, w2)."""
    g = g.sort_values(["id", "start"], kind="stable")
    snippets, ids, start = list(g["bytes"]), g["id"].to_numpy(np.int64), g["start"].to_numpy(np.int64)
    again, lead, bounds = repeated_starts(snippets, g["n"].to_numpy(np.int64), least)
    a, b = _runs(again)  # no run passes the end of its snippet, where no window starts
    k = np.searchsorted(bounds, a, "right") - 1
    move = start[k] - bounds[k]
    if len(a):
        yield pd.DataFrame({"id": ids[k], "a": a + move, "b": b + move}).assign(w1=None, w2=None)
    at = np.flatnonzero(np.repeat(g["hot"].to_numpy(bool), np.diff(bounds)) & lead)
    if len(at):
        k, data = np.searchsorted(bounds, at, "right") - 1, b"".join(snippets)
        names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[p : p + least]) for p in at.tolist()), np.int64).reshape(-1, 2)
        place = at + start[k] - bounds[k]
        yield pd.DataFrame({"id": ids[k], "a": place, "b": place + 1, "w1": names[:, 0], "w2": names[:, 1]})


def _sort_shards(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Sorted rows are gathered to shards of about SHARD_BYTES, cut where a group (h, salt) ends."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += int(pdf["bytes"].map(len).sum())
        if size < SHARD_BYTES:
            continue
        g = pd.concat(held, ignore_index=True)
        key = g[["h", "salt"]].to_numpy()
        ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        total = np.cumsum(g["bytes"].map(len).to_numpy())
        a = 0
        while len(fit := ends[(ends > a) & (total[ends - 1] - (total[a - 1] if a else 0) >= SHARD_BYTES)]):
            yield from _shard(g.iloc[a : fit[0]], least)
            a = int(fit[0])
        held = [g.iloc[a:]]
        size = int(total[-1] - (total[a - 1] if a else 0))
    if size:
        yield from _shard(pd.concat(held, ignore_index=True), least)


def _erase(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The result rows: each document's bytes less its spans."""
    asked = spans.groupBy("id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).withColumnRenamed("id", "own")
    joined = packed_texts(docs).join(asked, F.col("id") == F.col("own"), "left").select("id", "z", "a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for i, packed, a, b in zip(pdf["id"], pdf["z"], pdf["a"], pdf["b"], strict=True):
                data = z.decompress(packed)
                n = len(data)
                spans_n = removed = 0
                if a is not None and len(a):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.minimum(a, n), 1)
                    np.add.at(edge, np.minimum(b, n), -1)
                    gone = np.cumsum(edge)[:n] > 0
                    spans_n, removed = len(_runs(gone)[0]), int(gone.sum())
                    data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((i, n, removed, spans_n, hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(docs: DataFrame, least: int = 100) -> DataFrame:
    """(id, a, b): byte ranges to remove, which may overlap. docs has id and text, without nulls."""
    if not GRAM <= least < GRAM + (1 << WIDE):
        raise ValueError(f"strings of {GRAM} bytes or more are looked for, not of {least}")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    pieces = scratch.keep(_pieces(docs, least), "pieces")
    # The anchors that occur again are written, so that both sides of the join are plain shuffles, which a hot anchor can be split in.
    shared = scratch.keep(pieces.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h"), "shared")
    free_shuffles(spark)
    places = scratch.keep(pieces.join(shared, "h"), "places")
    scratch.drop("pieces", "shared")
    free_shuffles(spark)
    first = F.min(F.struct("id", "pos"))
    classes = scratch.keep(places.groupBy("h", "c").agg(first.alias("f"), F.count("*").alias("m")), "classes")
    later = places.join(classes.filter("m > 1").select("h", "c", "f"), ["h", "c"]).filter((F.col("id") != F.col("f.id")) | (F.col("pos") != F.col("f.pos")))
    start, n = F.shiftright("pos", WIDE), F.col("pos").bitwiseAND((1 << WIDE) - 1)
    whole = later.select("id", start.alias("a"), (start + n + (least - 1)).alias("b"))
    many = scratch.keep(classes.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"), "many")
    salts = F.ceil(F.col("k") / CLASSES)
    need = classes.join(many, "h").select(F.col("f.id").alias("id"), "h", F.pmod("c", salts).cast("int").alias("salt"), (F.col("k") > CLASSES).alias("hot"), F.col("f.pos").alias("pos"))
    snippets = _snippets(docs, need, least).repartition("h", "salt").sortWithinPartitions("h", "salt")
    found = scratch.keep(snippets.mapInPandas(lambda b: _sort_shards(b, least), "id long, a long, b long, w1 long, w2 long"), "found")
    free_shuffles(spark)
    firsts = found.filter("w1 is not null")
    best = firsts.groupBy("w1", "w2").agg(F.min(F.struct("id", "a")).alias("f"), F.count("*").alias("m")).filter("m > 1")
    across = firsts.join(best, ["w1", "w2"]).filter((F.col("id") != F.col("f.id")) | (F.col("a") != F.col("f.a"))).select("id", "a", "b")
    inside = found.filter("w1 is null").select("id", "a", "b").unionByName(across).select("id", "a", (F.col("b") + (least - 1)).alias("b"))
    spans = scratch.keep(whole.unionByName(inside), "spans")
    scratch.drop("places", "classes", "many", "found")
    free_shuffles(spark)
    return spans


def _one_row_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, text, own, copies) for each distinct (own, text); id is a number in order of own and the text's SHA-256."""
    distinct = docs.groupBy(F.col("id").alias("own"), "text").agg(F.count("*").alias("copies"))
    ordered = distinct.orderBy("own", F.sha2(F.encode("text", "UTF-8"), 256))
    return scratch.keep(ordered.select(F.monotonically_increasing_id().alias("id"), "text", "own", "copies"), "distinct")


def remove_repeats(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    d = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    if d.groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").isEmpty():
        out = _erase(d, repeated_spans(d, least))
    else:
        d = _one_row_each(d, Scratch(docs.sparkSession))
        found = _erase(d, repeated_spans(d, least)).withColumnRenamed("doc_id", "id")
        rows = d.select("id", "own", "copies").join(found, "id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        out = rows.select(F.col("own").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
