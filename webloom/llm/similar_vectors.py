"""The k most similar vectors of every vector, by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.plans.lineage import keep
from webloom.sources.tables import table

#: Rows of one block of a bucket; larger buckets are compared block by block, whole.
BLOCK = 4096
#: Rows that one call of the comparing function gets, about.
GROUP_ROWS = 40_000
#: Rows of a bucket up to which sketches are compared, and standard deviations that a sketch may be off: one pair in 30,000 is further.
SMALL, OFF = 512, 4.0


@dataclass(frozen=True)
class Hashing:
    """tables x functions hash functions floor((a.v + b) / width) over unit vectors; probes further buckets a table.

    bits: signs of random projections that stand for a vector where its pairs are sought; 0 sends the vectors themselves.
    """

    tables: int
    functions: int
    width: float
    probes: int
    bits: int = 0
    dims: int = 96
    seed: int = 17


def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of places in a point's sorted list of border distances, in order of their expected score.

    Place j of the 2 * functions sorted distances has a known expected square, so one order serves all points.
    A set may not hold both directions of one function; since place j and its mirror are expected to be the two
    borders of one function, sets holding both are left out.
    """
    m = functions
    z = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    heap, out = [(z[0], (0,))], []
    while heap and len(out) < probes:
        score, held = heapq.heappop(heap)
        if all(2 * m - 1 - j not in held for j in held):
            out.append(held)
        last = held[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*held[:-1], last + 1)))
            heapq.heappush(heap, (score + z[last + 1], (*held, last + 1)))
    return out


def bucket_keys(vectors: np.ndarray, h: Hashing, probing: bool) -> list[tuple[int, np.ndarray]]:
    """(table, keys) of each vector's own buckets, then, if probing, of its perturbed ones."""
    rng = np.random.default_rng(h.seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out, k = [], h.functions
    sets = perturbations(k, h.probes) if probing else []
    for t in range(h.tables):
        a, b = rng.standard_normal((h.dims, k)), rng.random(k)
        odd = rng.integers(1, 2**62, k, dtype=np.int64) * 2 + 1
        at = unit @ (a / h.width) + b
        low = np.floor(at)
        cells = low.astype(np.int64)
        own = (cells * odd).sum(axis=1)  # wraps around; a sum, so that a step of one cell adds or takes one odd number
        out.append((t, own))
        if sets:
            down = at - low
            order = np.argsort(np.concatenate([down, 1 - down], axis=1), axis=1)
            step = np.concatenate([-odd, odd])[order]
            out += [(t, own + step[:, list(held)].sum(axis=1)) for held in sets]
    return out


def sketches(vectors: np.ndarray, h: Hashing) -> np.ndarray:
    """The signs of h.bits random projections of each vector, packed into bytes."""
    planes = np.random.default_rng(h.seed + 1).standard_normal((h.dims, h.bits))
    return np.packbits(vectors @ planes > 0, axis=1)


def farthest(least: float, h: Hashing) -> int:
    """Signs in which the sketches of two vectors of cosine `least` differ, OFF standard deviations above the mean."""
    p = np.arccos(np.clip(least, -1, 1)) / np.pi
    return int(np.ceil(h.bits * p + OFF * np.sqrt(h.bits * p * (1 - p))))


def _values(column: pd.Series, kind=np.int8) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def _hashed(h: Hashing, member: bool, probing: bool, bare: bool = False):
    """A row for each bucket of each vector: key, and v, its sketch or itself (nothing if bare)."""

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = _values(pdf["v"]).astype(np.float64)
            v = [b""] * len(pdf) if bare else [r.tobytes() for r in sketches(x, h)] if h.bits else pdf["v"].tolist()
            for j, (t, key) in enumerate(bucket_keys(x, h, probing)):
                own = j % (1 + h.probes) == 0 if probing else True
                yield pd.DataFrame({"id": pdf["id"], "v": v, "key": key ^ np.int64(t * 0x9E3779B97F4A7C1), "member": bool(own and member), "query": bool(probing or not member)})

    return run


def _alike(most: int):
    """Pairs (a, b) of the rows of each small bucket whose sketches differ in at most `most` signs; rows come sorted by bucket."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, ids, query, member = pdf["key"].to_numpy(), pdf["id"].to_numpy(), pdf["query"].to_numpy(), pdf["member"].to_numpy()
        x = _values(pdf["v"], np.uint64)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 1:
                q, m = lo + np.flatnonzero(query[lo:hi]), lo + np.flatnonzero(member[lo:hi])
                far = np.bitwise_count(x[q][:, None, :] ^ x[m][None, :, :]).sum(axis=2, dtype=np.int32)
                i, j = np.nonzero((far <= most) & (ids[q][:, None] != ids[m][None, :]))
                found.append((ids[q[i]], ids[m[j]]))
        a, b = (np.concatenate(z) for z in zip(*found))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf["key"] == pdf["key"].iloc[-1]).to_numpy() if len(pdf) else np.zeros(0, dtype=bool)  # may go on in the next batch
            rest = pdf[last]
            if not last.all():
                yield pairs(pdf[~last])
        if rest is not None and len(rest):
            yield pairs(rest)

    return run


def _cosines(batches):
    for pdf in batches:
        x, y = _values(pdf["va"]).astype(np.float64) if len(pdf) else np.zeros((0, 1)), _values(pdf["vb"]).astype(np.float64) if len(pdf) else np.zeros((0, 1))
        cos = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "cos": np.round(cos, 6)})


def _nearest(k: int, least: float, mutual: bool):
    """Compares the queries and members of each bucket in a group of rows; keeps each one's best k of a bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "qb", "mb"], kind="stable")
        x = np.frombuffer(b"".join(pdf["v"]), dtype=np.int8).reshape(len(pdf), -1).astype(np.float32)
        norm, ids = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)), pdf["id"].to_numpy()
        codes = pdf[["key", "qb", "mb"]].to_numpy()
        member, query = pdf["member"].to_numpy(), pdf["query"].to_numpy()
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1), len(pdf)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def best(cos: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
            if cos.shape[1] > k:  # ties at the border stay in
                border = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
                take = (cos >= border) & (cos >= least)
                if (take.sum(axis=1) > k + 8).any():
                    order = np.lexsort((np.broadcast_to(ids[cols], cos.shape), -cos), axis=1)[:, :k]
                    chosen = np.zeros_like(take)
                    np.put_along_axis(chosen, order, True, axis=1)
                    take = chosen & (cos >= least)
            else:
                take = cos >= least
            i, j = np.nonzero(take)
            found.append((ids[rows[i]], ids[cols[j]], cos[i, j]))

        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo < 2:
                continue
            rows = np.arange(lo, hi)
            q, m = rows[query[lo:hi]], rows[member[lo:hi]]
            if not len(q) or not len(m):
                continue
            cos = np.round((x[q] @ x[m].T).astype(np.float64) / (norm[q][:, None] * norm[m][None, :]), 6)
            cos[ids[q][:, None] == ids[m][None, :]] = -2.0
            best(cos, q, m)
            if mutual:
                best(cos.T, m, q)
        if not found:
            return pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64), "cos": np.array([], dtype=np.float64)})
        a, b, c = (np.concatenate(z) for z in zip(*found))
        out = pd.DataFrame({"a": a, "b": b, "cos": c})
        return out[out["cos"] > -1.5].drop_duplicates(["a", "b"])

    return run


def nearest_vectors(vectors: DataFrame, id_col: str, vec_col: str, k: int, h: Hashing, queries: str | None = None, least: float = -1.0) -> DataFrame:
    """For every row (or those where the SQL condition queries holds, over id_col) its k nearest other rows.

    vec_col: array of signed bytes. Rows with a null id, and rows whose vector is null, not h.dims long, holds a
    null or is all zero are near nothing and left out; a repeated id counts once. Result: vec_id, near_id,
    cosine (6 decimals), place; equal cosines order by the smaller near_id. Only cosines of at least `least` count.

    Copies of a vector are hashed once, by their smallest id; a row's copies stand for it by their k + 1 smallest
    ids, which is all that any list of k can need. Each distinct vector lies in one bucket of each of h.tables hash
    tables; a query also visits the h.probes buckets most likely to hold its neighbours. With sketches (h.bits), those of a bucket of
    up to SMALL rows are compared, and the pairs they let through meet by exact cosine; only larger buckets send vectors. Else
    all vectors of a bucket are compared by exact cosine. A bucket of more than BLOCK rows is compared block by block, none left out.
    Approximate only in that a neighbour may share no visited bucket, or have a sketch that is far off (see OFF).
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    usable = raw.filter(F.col("id").isNotNull() & (F.size("vec") == h.dims) & F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: x.isNull()))
    hexed = F.unhex(F.array_join(F.transform("vec", lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0")), ""))
    rows = keep(usable.dropDuplicates(["id"]).select("id", hexed.alias("v")))
    # the k + 1 smallest ids of each distinct vector; the row limit is applied before the shuffle too
    w = Window.partitionBy("v").orderBy("id")
    heads = keep(rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    asked = rows.filter(queries.replace(id_col, "id")) if queries else rows
    reps = asked.select("id", "v").join(heads.select("v", F.col("id").alias("rep"), "ids"), "v").drop("v")
    schema = "id long, v binary, key long, member boolean, query boolean"

    def spread(bare: bool) -> DataFrame:
        if not queries:
            return heads.select("id", "v").mapInPandas(_hashed(h, True, True, bare), schema)
        probing = heads.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "v")
        members = heads.select("id", "v").mapInPandas(_hashed(h, True, False, bare), schema).withColumn("query", F.lit(False))
        return members.union(probing.mapInPandas(_hashed(h, False, True, bare), schema))

    # a large bucket of q queries and m members is cut into blocks; every block of queries meets every block of members
    limit = SMALL if h.bits else BLOCK
    sizes = spread(True).groupBy("key").agg(F.count_if("query").alias("q"), F.count_if("member").alias("m"))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK).cast("int"), F.lit(1))
    hot = keep(sizes.filter((F.col("q") > limit) | (F.col("m") > limit)).select("key", blocks("q").alias("qs"), blocks("m").alias("ms")))
    every = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    place = lambda member, query, qb, mb: F.struct(member.alias("member"), query.alias("query"), qb.cast("int").alias("qb"), mb.cast("int").alias("mb"))
    no, yes, zero = F.lit(False), F.lit(True), F.lit(0)
    q0, m0 = F.pmod(F.xxhash64("id"), F.col("qs")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("ms"))
    none = F.array().cast("array<struct<member:boolean,query:boolean,qb:int,mb:int>>")
    split = F.concat(F.when(F.col("query"), every(F.col("ms"), lambda x: place(no, yes, q0, x))).otherwise(none), F.when(F.col("member"), every(F.col("qs"), lambda x: place(yes, no, x, m0))).otherwise(none))
    whole = F.array(place(F.col("member"), F.col("query"), zero, zero))
    large = spread(False).join(hot, "key", "inner" if h.bits else "left")
    if h.bits:
        large = large.drop("v").join(heads.select("id", "v"), "id")
    cut = large.select("id", "v", "key", F.explode(F.when(F.coalesce(F.col("qs") * F.col("ms"), F.lit(1)) == 1, whole).otherwise(split)).alias("x")).select("id", "v", "key", "x.*")
    groups = max(1, h.tables * (1 + h.probes) * heads.count() // GROUP_ROWS)
    placed = cut.withColumn("grp", F.pmod(F.xxhash64("key", "qb", "mb"), F.lit(groups)))
    near = placed.groupBy("grp").applyInPandas(_nearest(k + 1, least, mutual=not queries), "a long, b long, cos double")
    if h.bits:
        small = spread(False).join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
        pairs = small.mapInPandas(_alike(farthest(least, h)), "a long, b long").distinct()
        with_v = lambda i, v: heads.select(F.col("id").alias(i), F.col("v").alias(v))
        exact = pairs.join(with_v("a", "va"), "a").join(with_v("b", "vb"), "b").mapInPandas(_cosines, "a long, b long, cos double").filter(F.col("cos") >= least)
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
        near = near.union(exact.select("cos", both).select("x.a", "x.b", "cos"))
    # merge of the tables' candidates; each neighbour stands for its copies
    both = near.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    top = both.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1).select("a", "b", "cos")
    other = top.join(heads.select(F.col("id").alias("b"), "ids"), "b").select("a", "cos", F.explode("ids").alias("near"))
    own = heads.select(F.col("id").alias("a"), F.lit(1.0).alias("cos"), F.explode("ids").alias("near"))
    w = Window.partitionBy("a").orderBy(F.desc("cos"), "near")
    lists = other.union(own).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", "near", "cos"))).alias("list"))
    mine = reps.join(lists, reps.rep == lists.a).select("id", F.slice(F.filter("list", lambda x: x["near"] != F.col("id")), 1, k).alias("list"))
    out = mine.select("id", F.posexplode("list").alias("p", "x")).select(F.col("id").alias("vec_id"), F.col("x.near").alias("near_id"), F.col("x.cos").alias("cosine"), (F.col("p") + 1).alias("place"))
    return out.filter(F.col("cosine") >= least)


#: For neighbours of cosine 0.9 and more.
CLOSE = Hashing(tables=4, functions=16, width=2.5, probes=6, bits=192)
#: For the nearest whatever their cosine; in these data most lie near 0.47, little above the rest.
WIDE = Hashing(tables=2, functions=5, width=2.0, probes=60)


def p2_found(spark, d):
    """Pairs of cosine 0.9 and more in which one is among the five nearest of the other."""
    near = nearest_vectors(table(spark, d, "site_vectors"), "vec_id", "vec", 5, CLOSE, least=0.9)
    return near.select(F.least("vec_id", "near_id").alias("vec_a"), F.greatest("vec_id", "near_id").alias("vec_b")).distinct()


def p2_neighbours(spark, d):
    """The five nearest rows of every row whose id is divisible by 20, with domain and cosine."""
    vectors = table(spark, d, "site_vectors")
    near = nearest_vectors(vectors, "vec_id", "vec", 5, WIDE, queries="vec_id % 20 = 0")
    names = vectors.select(F.col("vec_id").alias("near_id"), F.col("domain").alias("near_domain")).dropDuplicates(["near_id"])
    return near.join(names, "near_id").select("vec_id", "near_id", "near_domain", "cosine", "place")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
SQL = {
    "p2_found": """
WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, vec::DOUBLE[] AS x FROM site_vectors WHERE vec IS NOT NULL AND len(vec) = 96 AND (list_max(vec) <> 0 OR list_min(vec) <> 0) ORDER BY vec_id),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.x, b.x), 6) AS cosine FROM v a, v b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM c WHERE cosine >= 0.9)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE place <= 5"""
}
