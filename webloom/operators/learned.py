"""Learned ranking: features of hits, tree ensembles and small nets as expressions, LambdaMART on a bounded sample, guarded reordering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators import evaluation, merge
from webloom.plans.lineage import keep
from webloom.sources.tables import table

FEATURES = ["place", "reciprocal", "rows", "score", "gap", "links", "official", "best_links"]
#: Rows of labelled cases that an ensemble is trained on, at most (whole cases of the smallest hashes); trees, their depth, least leaf and rate.
TRAIN_ROWS, TREES, DEPTH, LEAF, RATE = 50_000, 20, 3, 20, 0.1
#: Places that reordering may change, and how far a hit may rise.
TOP, RISE = 10, 3


def features(spark, d) -> DataFrame:
    """case_id, domain, grade and FEATURES of the graded answers: place, its inverse, list size, score, gap to the best score, links, official, gap to the most links."""
    g = evaluation.graded(spark, d)
    s = merge.signals(spark, d).select("domain", F.round(F.log1p(F.coalesce("linking_domains", F.lit(0))), 5).alias("links"), F.coalesce("official_site", F.lit(False)).cast("int").cast("double").alias("official"))
    w = Window.partitionBy("case_id")
    rows = g.join(s, "domain", "left").select("case_id", "domain", "grade", "place", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("links", F.lit(0.0)).alias("links"), F.coalesce("official", F.lit(0.0)).alias("official"))
    return rows.select("case_id", "domain", "grade", F.col("place").cast("double").alias("place"), F.round(1 / F.col("place"), 5).alias("reciprocal"), F.count("*").over(w).cast("double").alias("rows"), "score", F.round(F.max("score").over(w) - F.col("score"), 5).alias("gap"), "links", "official", F.round(F.max("links").over(w) - F.col("links"), 5).alias("best_links"))


def tree(node: dict) -> Column:
    """A regression tree as an expression: {"f": feature, "t": threshold, "l": node, "r": node}, or {"v": value}."""
    if "v" in node:
        return F.lit(float(node["v"]))
    return F.when(F.col(node["f"]) <= node["t"], tree(node["l"])).otherwise(tree(node["r"]))


def ensemble(trees: list[dict]) -> Column:
    """Sum of the trees' values; 0 without trees. It stays inside generated code, whatever the number of rows."""
    return sum((tree(t) for t in trees), F.lit(0.0))


def net(layers: list[tuple[list[list[float]], list[float]]], inputs: list[str]) -> Column:
    """A small net of x / (1 + |x|) squashes and a linear last layer; layers: (weights, biases)."""
    x = [F.col(c).cast("double") for c in inputs]
    for i, (weights, biases) in enumerate(layers):
        x = [sum((float(w) * v for w, v in zip(row, x)), F.lit(float(b))) for row, b in zip(weights, biases)]
        if i < len(layers) - 1:
            x = [v / (1 + F.abs(v)) for v in x]
    return x[0]


def lambda_mart(rows: DataFrame, inputs: list[str]) -> list[dict]:
    """Trees trained for NDCG@10 by LambdaMART on at most TRAIN_ROWS rows of (case_id, domain, grade, inputs), taken as whole cases; the same rows give the same trees."""
    sizes = rows.groupBy("case_id").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("case_id"))
    few = sizes.orderBy("h", "case_id").limit(TRAIN_ROWS)
    pdf = rows.join(few.select("case_id", "h"), "case_id").orderBy("h", "case_id", "domain").limit(TRAIN_ROWS).toPandas()
    if pdf.empty:
        return []
    x, grade = pdf[inputs].to_numpy(float), pdf["grade"].fillna(0).to_numpy(float)
    cuts = np.flatnonzero(pdf["case_id"].to_numpy()[1:] != pdf["case_id"].to_numpy()[:-1]) + 1
    groups = np.split(np.arange(len(pdf)), cuts)
    score, trees, gain = np.zeros(len(pdf)), [], 2.0**grade - 1
    for _ in range(TREES):
        lam, hess = np.zeros(len(pdf)), np.zeros(len(pdf))
        for g in groups:
            rank = np.empty(len(g), dtype=int)
            rank[np.lexsort((np.arange(len(g)), -score[g]))] = np.arange(len(g))
            discount = np.where(rank < 10, 1 / np.log2(rank + 2), 0.0)
            ideal = (np.sort(gain[g])[::-1][:10] / np.log2(np.arange(2, min(len(g), 10) + 2))).sum()
            better = grade[g][:, None] > grade[g][None, :]
            if ideal <= 0 or not better.any():
                continue
            rho = 1 / (1 + np.exp(score[g][:, None] - score[g][None, :]))
            delta = np.abs((gain[g][:, None] - gain[g][None, :]) * (discount[:, None] - discount[None, :])) / ideal
            push, curve = np.where(better, rho * delta, 0), np.where(better, rho * (1 - rho) * delta, 0)
            lam[g] += push.sum(1) - push.sum(0)
            hess[g] += curve.sum(1) + curve.sum(0)
        trees.append(_grown(x, lam, hess, np.arange(len(pdf)), DEPTH, inputs))
        score += _values(trees[-1], x, inputs)
    return trees


def _grown(x, lam, hess, rows, depth, names) -> dict:
    leaf = {"v": round(float(RATE * lam[rows].sum() / (hess[rows].sum() + 1e-6)), 6)} if len(rows) else {"v": 0.0}
    if not depth or len(rows) < 2 * LEAF:
        return leaf
    best, total = (1e-9, None, None), lam[rows].sum()
    for j in range(x.shape[1]):
        o = rows[np.argsort(x[rows, j], kind="stable")]
        v, s = x[o, j], lam[o].cumsum()[:-1]
        n = np.arange(1, len(o))
        ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(o) - n >= LEAF)
        if ok.any():
            won = np.where(ok, s**2 / n + (total - s) ** 2 / (len(o) - n) - total**2 / len(o), -1.0)
            i = int(won.argmax())
            if won[i] > best[0]:
                best = (won[i], j, float((v[i] + v[i + 1]) / 2))
    if best[1] is None:
        return leaf
    low = x[rows, best[1]] <= best[2]
    return {"f": names[best[1]], "t": best[2], "l": _grown(x, lam, hess, rows[low], depth - 1, names), "r": _grown(x, lam, hess, rows[~low], depth - 1, names)}


def _values(t: dict, x, names) -> np.ndarray:
    if "v" in t:
        return np.full(len(x), t["v"])
    low = x[:, names.index(t["f"])] <= t["t"]
    return np.where(low, _values(t["l"], x, names), _values(t["r"], x, names))


def reordered(rows: DataFrame, by: str) -> DataFrame:
    """rows (case_id, domain, place, by) with `now`: the first TOP places in order of `by`, none of them risen by more than RISE; the rest stay."""
    w = Window.partitionBy("case_id").orderBy(F.desc(by), "place", "domain")
    top = rows.filter(F.col("place") <= TOP).withColumn("_want", F.row_number().over(w))
    held = top.withColumn("_to", F.greatest(F.col("_want"), F.col("place") - RISE))
    moved = held.withColumn("now", F.row_number().over(Window.partitionBy("case_id").orderBy("_to", "_want"))).drop("_want", "_to")
    return moved.unionByName(rows.filter(F.col("place") > TOP).withColumn("now", F.col("place").cast("int")))


#: An ensemble and a net of set weights, for scoring without training.
SET_TREES = [{"f": "links", "t": 3.0, "l": {"v": -0.2}, "r": {"f": "gap", "t": 0.1, "l": {"v": 0.5}, "r": {"v": 0.1}}}, {"f": "official", "t": 0.5, "l": {"f": "reciprocal", "t": 0.3, "l": {"v": -0.1}, "r": {"v": 0.05}}, "r": {"v": 0.3}}]
SET_NET = [([[0.5, -1.0, 0.2], [-0.3, 0.4, 0.1]], [0.1, -0.2]), ([[1.0, -0.5]], [0.05])]


def hit_features(spark, d):
    return features(spark, d)


def tree_scores(spark, d):
    return features(spark, d).select("case_id", "domain", F.round(ensemble(SET_TREES), 5).alias("value"))


def net_scores(spark, d):
    return features(spark, d).select("case_id", "domain", F.round(net(SET_NET, ["score", "gap", "links"]), 5).alias("value"))


def guarded_order(spark, d):
    """Answers reordered by the set ensemble within the guards."""
    rows = features(spark, d).select("case_id", "domain", "place", F.round(ensemble(SET_TREES), 5).alias("value"))
    return reordered(rows, "value").select("case_id", "domain", F.col("now").cast("long").alias("now"))


def trained_order(spark, d):
    """NDCG@10 of all cases before and after ordering by trees trained on the tune split's cases."""
    rows = keep(features(spark, d))
    split = table(spark, d, "audit_cases").filter("case_id is not null").select("case_id", (F.coalesce("split", F.lit("none")) == "tune").alias("tune")).dropDuplicates(["case_id"])
    marked = rows.join(split, "case_id")
    scored = marked.withColumn("value", ensemble(lambda_mart(marked.filter("tune"), FEATURES)))
    place = lambda *o: F.row_number().over(Window.partitionBy("case_id").orderBy(*o))
    p = scored.withColumn("now", place(F.desc("value"), "place")).withColumn("best", place(F.desc("grade"), "domain"))
    gain = lambda c: F.when(F.col(c) <= 10, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(c) + 1)).otherwise(0.0)
    sums = p.groupBy("case_id", "tune").agg(F.sum(gain("place")).alias("a"), F.sum(gain("now")).alias("b"), F.sum(gain("best")).alias("i")).filter("i > 0")
    return sums.groupBy("tune").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("a") / F.col("i")), 4).alias("before"), F.round(F.avg(F.col("b") / F.col("i")), 4).alias("after"))


QUERIES = {f.__name__: f for f in (hit_features, tree_scores, net_scores, guarded_order, trained_order)}


def _tree_sql(t: dict) -> str:
    return str(float(t["v"])) if "v" in t else f"CASE WHEN {t['f']} <= {t['t']} THEN {_tree_sql(t['l'])} ELSE {_tree_sql(t['r'])} END"


_FT = f"""{evaluation._GRADED}, fa AS (SELECT case_id, g.domain, grade, place, coalesce(round(sc.score, 5), 0) AS score, coalesce(round(ln(1 + coalesce(s.l, 0)), 5), 0) * CASE WHEN s.domain IS NULL THEN 0 ELSE 1 END AS links, coalesce(s.o, false)::INT::DOUBLE AS official FROM g LEFT JOIN sc ON sc.domain = g.domain LEFT JOIN s ON s.domain = g.domain),
ft AS (SELECT case_id, domain, grade, place::DOUBLE AS place, round(1 / place::DOUBLE, 5) AS reciprocal, count(*) OVER v::DOUBLE AS rows, score, round(max(score) OVER v - score, 5) AS gap, links, official, round(max(links) OVER v - links, 5) AS best_links FROM fa WINDOW v AS (PARTITION BY case_id))"""
_FT = _FT.replace("count(*) OVER v::DOUBLE AS rows", "(count(*) OVER v)::DOUBLE AS rows")
_VALUE = f"round(({_tree_sql(SET_TREES[0])})::DOUBLE + ({_tree_sql(SET_TREES[1])})::DOUBLE, 5)"
_H = [f"({w[0]} * score + {w[1]} * gap + {w[2]} * links + {b})::DOUBLE" for w, b in zip(*SET_NET[0])]
SQL = {
    "hit_features": f"WITH {_FT} SELECT * FROM ft",
    "tree_scores": f"WITH {_FT} SELECT case_id, domain, {_VALUE} AS value FROM ft",
    "net_scores": f"WITH {_FT}, h AS (SELECT case_id, domain, {_H[0]} AS a, {_H[1]} AS b FROM ft) SELECT case_id, domain, round(a / (1 + abs(a)) - 0.5::DOUBLE * b / (1 + abs(b)) + 0.05::DOUBLE, 5) AS value FROM h",
    "guarded_order": f"WITH {_FT}, v AS (SELECT case_id, domain, place, {_VALUE} AS value FROM ft), w AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, place, domain) AS want FROM v WHERE place <= {TOP}), t AS (SELECT *, greatest(want, place - {RISE}) AS target FROM w) SELECT case_id, domain, row_number() OVER (PARTITION BY case_id ORDER BY target, want) AS now FROM t UNION ALL SELECT case_id, domain, place::BIGINT FROM v WHERE place > {TOP}",
}
