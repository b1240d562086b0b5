"""Product codes of vectors by weighted Lloyd rounds over distinct integer parts.

Components become whole numbers, floor(scale * x), and a vector is cut into equal consecutive parts.
Equal parts of one position are one row with their number as its weight, so that a group of copies
costs as much as one vector; the rounds run over this table alone. A round gives every distinct part
its nearest entry in batches of numpy, and one aggregation adds up weights and weighted components by
position and entry. Only a codebook (16 entries a position) passes through the driver. At the end codes
and errors are joined back to the vectors: parts that hold a thousandth of all vectors or more, at most
1000 a position, by a broadcast, so that none of them fills a task, and all others by a shuffle.

Written tables cut the lineage: vectors with a row key, distinct parts, their codes.

Defined results: rows whose vector is null or holds null or non-finite components have no code and no
row. So have rows whose vector cannot be cut into equal parts, or is not as long as the longest that
can. Components beyond 2^27 after scaling count as 2^27, so that distances are exact in 64 bits. Rows
that repeat a vec_id each have a row, and the id begins one entry only, with its least vector; a null
vec_id has a code, but begins no entry. With fewer ids than entries the codebook is as short. No
vectors, no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 2**27
#: Parts with at least this share of all vectors are joined by a broadcast; a position has at most as many as its inverse.
HOT = 1000
SALTS = 16

#: An array of positions, each a list of entries.
Codebooks = list[list[list[int]]]


def whole_numbers(vectors: DataFrame, scale: int, parts: int, label: str, scratch: Scratch) -> DataFrame:
    """(row, vec_id, label, v array<int>), written; vectors that have a code."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    ints = F.transform(x, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), "embedding").where(sound & fits)
    found = scratch.keep(src.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", ints.alias("v")), "vectors")
    longest = found.agg(F.max(F.size("v"))).first()[0]
    return found.where(F.size("v") == (longest or 0))


def _part(i: Column | int, width: int) -> Column:
    return F.slice("v", (i if isinstance(i, Column) else F.lit(i)) * width + 1, width)


def _nearest(codebooks: Codebooks):
    """A pandas UDF: the nearest entry of a part and its squared distance; ties go to the lower index."""
    books = [np.array(b, np.int64) for b in codebooks]

    @F.pandas_udf("entry int, error long")
    def run(position: pd.Series, part: pd.Series) -> pd.DataFrame:
        at, values = position.to_numpy(), np.stack(part.to_numpy()).astype(np.int64) if len(part) else np.zeros((0, 1), np.int64)
        entry, error = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        for p in np.unique(at):
            own = np.flatnonzero(at == p)
            d = np.stack([((values[own] - e) ** 2).sum(axis=1) for e in books[p]], axis=1)
            entry[own] = d.argmin(axis=1)
            error[own] = d.min(axis=1)
        return pd.DataFrame({"entry": entry, "error": error})

    return run


def first_entries(found: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors of the smallest ids."""
    least = found.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    width = len(least[0]["v"]) // parts if least else 0
    return [[list(r["v"][p * width : (p + 1) * width]) for r in least] for p in range(parts)]


def train(distinct: DataFrame, codebooks: Codebooks, rounds: int) -> Codebooks:
    """Weighted Lloyd rounds; sums are decimals, so that no number of vectors overflows them."""
    width = len(codebooks[0][0])
    sums = [F.sum((F.col("part")[j] * F.col("weight")).cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    for _ in range(rounds):
        chosen = distinct.select("position", "part", "weight", _nearest(codebooks)("position", "part")["entry"].alias("entry"))
        # At most parts x entries rows.
        for r in chosen.groupBy("position", "entry").agg(F.sum("weight").alias("n"), *sums).collect():
            codebooks[r["position"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return codebooks


def digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in codebooks for e in b for x in e).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(row, vec_id, label, codes array<int>, error) of all vectors that have a code, and the codebooks."""
    scratch = Scratch(vectors.sparkSession)
    found = whole_numbers(vectors, scale, parts, label, scratch)
    codebooks = first_entries(found, parts, entries)
    if not codebooks[0]:
        return found.select("row", "vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")).where("false"), codebooks
    width = len(codebooks[0][0])
    cut = found.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: _part(i, width))).alias("position", "part"))
    distinct = scratch.keep(cut.groupBy("position", "part").agg(F.count("*").alias("weight")), "distinct")
    codebooks = train(distinct, codebooks, rounds)

    coded = distinct.select("position", "part", "weight", _nearest(codebooks)("position", "part").alias("to")).select("position", "part", "weight", "to.*")
    coded = scratch.keep(coded, "coded")
    many = found.count()
    hot = coded.where(F.col("weight") * HOT >= many).select("position", "part", F.struct("entry", "error").alias("hot"))
    rest = coded.where(F.col("weight") * HOT < many).drop("weight")
    # At most HOT parts of a position: it is bounded whatever the input.
    near = cut.join(F.broadcast(hot), ["position", "part"], "left")
    back = near.where("hot is not null").select("row", "position", "hot.*")
    back = back.unionByName(near.where("hot is null").drop("hot").join(rest, ["position", "part"]).select("row", "position", "entry", "error"))
    codes = back.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda s: s["entry"]).alias("codes"), F.sum("error").alias("error"))
    return found.select("row", "vec_id", "label").join(codes, "row"), codebooks


def compress_vectors(vectors: DataFrame, label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector that has a code."""
    coded, codebooks = encode_vectors(vectors, label)
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    rows = Scratch(vectors.sparkSession).keep(coded.select("row", "vec_id", "label", code.alias("code"), "error"), "codes")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    total = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("part"))
    out = salted.join(total, (salted["salt"] == total["part"]) & salted["label"].eqNullSafe(total["of"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same round by round over all parts of all vectors, without weights."""
    nearest = "arg_min(e.entry, sqrt_free * 16 + e.entry)"
    ctes = [
        f"""k as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {SCALE}) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding))""",
        f"p as materialized (select vec_id, cast(q.position as integer) as position, v[q.position * (len(v) // {PARTS}) + 1:(q.position + 1) * (len(v) // {PARTS})] as part from k, (select unnest(range(0, {PARTS})) as position) q)",
        f"b0 as materialized (select position, row_number() over (partition by position order by vec_id) - 1 as entry, part as e from p qualify entry < {ENTRIES})",
    ]
    dist = "list_sum(list_transform(list_zip(p.part, e.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} as materialized (select vec_id, position, part, {nearest.replace('sqrt_free', 'd')} as entry, min(d) as d from (select p.vec_id, p.position, p.part, e.entry, cast({dist} as bigint) as d from p join b{r} e using (position)) e group by vec_id, position, part)")
        if r < ROUNDS:
            ctes.append(f"s{r} as (select position, entry, list(cast(floor(cast(total as double) / n) as bigint) order by j) as e from (select position, entry, j, sum(x) as total, count(*) as n from (select position, entry, unnest(part) as x, generate_subscripts(part, 1) as j from a{r}) group by position, entry, j) group by position, entry)")
            ctes.append(f"b{r + 1} as materialized (select position, b.entry, coalesce(s.e, b.e) as e from b{r} b left join s{r} s using (position, entry))")
    last = f"(select vec_id, string_agg(printf('%02x', entry), '' order by position) as code, cast(sum(d) as bigint) as error from a{ROUNDS} group by vec_id)"
    book = f"(select sha256(string_agg(cast(x as varchar), ',' order by position, entry, j)) as codebooks_sha256 from (select position, entry, unnest(e) as x, generate_subscripts(e, 1) as j from b{ROUNDS}))"
    return f"with {', '.join(ctes)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from {last} join k using (vec_id), {book}"
