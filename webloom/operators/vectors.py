"""Vectors of meaning: quantizing, cosines, exact neighbours of stated queries, closeness, relation maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.sources.tables import table

#: Rows of one block of queries that meets all vectors.
BLOCK = 2048


def quantize(v: Column) -> Column:
    """Bytes of a unit vector: each value times 127, rounded away from zero at halves, at most 127 either way."""
    return F.transform(v, lambda x: F.greatest(F.least(F.round(x.cast("double") * 127), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all zero."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def _nearest(k: int):
    """The best k of a block of vectors for each query of a block."""

    def usable(ids, rows):
        held = [(i, v) for i, v in zip(ids, rows) if v is not None and len(v) and np.any(v)]
        return np.array([i for i, _ in held], dtype=np.int64), [v for _, v in held]

    def run(batches):
        for pdf in batches:
            for qi, qv, vi, vv in zip(pdf["qi"], pdf["qv"], pdf["vi"], pdf["vv"]):
                (a, x), (b, y) = usable(qi, qv), usable(vi, vv)
                for dims in {len(v) for v in x}:
                    one, two = [j for j, v in enumerate(x) if len(v) == dims], [j for j, v in enumerate(y) if len(v) == dims]
                    if not two:
                        continue
                    unit = lambda m, js: (lambda z: z / np.linalg.norm(z, axis=1, keepdims=True))(np.array([m[j] for j in js], dtype=np.float64))
                    ids, other = a[one], b[two]
                    cos = np.round(unit(x, one) @ unit(y, two).T, 6)
                    cos[ids[:, None] == other[None, :]] = -2
                    take = np.lexsort((np.broadcast_to(other, cos.shape), -cos), axis=1)[:, :k]
                    rows = np.repeat(np.arange(len(ids)), take.shape[1])
                    c = cos[rows, take.ravel()]
                    yield pd.DataFrame({"id": ids[rows], "near": other[take.ravel()], "cosine": c})[c > -1.5]

    return run


def exact_neighbours(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """key, near, cosine, place: the k nearest others of a stated set of query rows among all vectors, exactly; ties by the smaller key.

    Both sides are cut into blocks of about BLOCK rows by a hash of the key, and every block of queries meets every block of vectors,
    each pair of blocks in one step of one task that keeps the best k. Vectors of other lengths, null or all zero are near nothing.
    """

    def blocks(df: DataFrame, i: str, v: str) -> DataFrame:
        n = max(1, -(-df.count() // BLOCK))
        return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("b")).agg(F.collect_list(F.struct(key, vec)).alias("x")).select(F.col(f"x.{key}").alias(i), F.col(f"x.{vec}").alias(v))

    met = blocks(queries, "qi", "qv").crossJoin(blocks(vectors, "vi", "vv"))
    found = met.mapInPandas(_nearest(k), "id long, near long, cosine double")
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "near")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).withColumnRenamed("id", key)


def _unit(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id is not null").dropDuplicates(["vec_id"])


def quantized_loss(spark, d):
    """Cosine of each vector with its quantized form."""
    e = _unit(spark, d).select("vec_id", "embedding", quantize(F.col("embedding")).alias("q"))
    return e.select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


def neighbours(spark, d):
    """The five nearest of every embedding whose id is divisible by 20."""
    e = _unit(spark, d)
    return exact_neighbours(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5)


def nearest_by_set(spark, d):
    """Of each asked embedding the nearest in each set (label), and how far the next there is behind."""
    e = _unit(spark, d)
    near = exact_neighbours(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10).join(e.select(F.col("vec_id").alias("near"), "label"), "near")
    w = Window.partitionBy("vec_id", "label").orderBy("place")
    rows = near.withColumn("n", F.row_number().over(w)).withColumn("gap", F.round(F.col("cosine") - F.lead("cosine").over(w), 5))
    return rows.filter("n = 1").select("vec_id", "label", "near", "gap")


def closeness(spark, d):
    """Neighbours' cosines stretched between the farthest kept and the best of each query (a spread of 0.15 at least), within 0 and 1."""
    n = neighbours(spark, d)
    w = Window.partitionBy("vec_id")
    low, high = F.min("cosine").over(w), F.max("cosine").over(w)
    return n.select("vec_id", "near", F.round(F.greatest(F.least((F.col("cosine") - low) / F.greatest(high - low, F.lit(0.15)), F.lit(1.0)), F.lit(0.0)), 5).alias("closeness"))


def label_recall(spark, d):
    """How often the neighbours share their query's label: among the first and the first five, by label."""
    e = _unit(spark, d)
    n = neighbours(spark, d).join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("near"), F.col("label").alias("other")), "near")
    same = F.col("label") == F.col("other")
    return n.groupBy("label").agg(F.count_if(same & (F.col("place") == 1)).alias("first"), F.count_if(same).alias("five"), F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (quantized_loss, neighbours, nearest_by_set, closeness, label_recall)}
_COS = lambda a, b: f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"
_N = f"e AS (SELECT DISTINCT ON (vec_id) * FROM embeddings WHERE vec_id IS NOT NULL), nn AS (SELECT * FROM (SELECT a.vec_id, b.vec_id AS near, {_COS('a.embedding', 'b.embedding')} AS cosine, a.label AS own, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS('a.embedding', 'b.embedding')} DESC, b.vec_id) AS place FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE place <= 10)"
SQL = {
    "quantized_loss": "WITH e AS (SELECT DISTINCT ON (vec_id) * FROM embeddings WHERE vec_id IS NOT NULL) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding, lambda x: greatest(least(round(x::DOUBLE * 127), 127), -127))::DOUBLE[]), 5) AS cosine FROM e",
    "neighbours": f"WITH {_N} SELECT vec_id, near, cosine, place FROM nn WHERE place <= 5",
    "nearest_by_set": f"WITH {_N}, r AS (SELECT vec_id, other AS label, near, row_number() OVER v AS n, round(cosine - lead(cosine) OVER v, 5) AS gap FROM nn WINDOW v AS (PARTITION BY vec_id, other ORDER BY place)) SELECT vec_id, label, near, gap FROM r WHERE n = 1",
    "closeness": f"WITH {_N}, f AS (SELECT *, min(cosine) OVER v AS lo, max(cosine) OVER v AS hi FROM nn WHERE place <= 5 WINDOW v AS (PARTITION BY vec_id)) SELECT vec_id, near, round(greatest(least((cosine - lo) / greatest(hi - lo, 0.15), 1), 0), 5)::DOUBLE AS closeness FROM f",
    "label_recall": f"WITH {_N} SELECT own AS label, count(*) FILTER (own = other AND place = 1) AS first, count(*) FILTER (own = other) AS five, count(*) AS rows FROM nn WHERE place <= 5 GROUP BY 1",
}
