"""One ranking from several differently scaled scores, by median rank aggregation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.ranking import count_before
from webloom.plans.lineage import keep
from webloom.sources.tables import table

#: Rows of a list that share a value from which on its rank is sent to them.
HOT = 50_000
SCORES = {"tranco_rank": ("low", 1.0), "linking_domains": ("high", 1.0), "harmonic_rank": ("low", 1.0), "fact_checks": ("high", 1.0)}


def median_rank(items: DataFrame, group: str, item: str, scores: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Rank the items of each group by the weighted median of their ranks in each score.

    scores: column -> (which end is better, "low" or "high"; weight above 0). Every item gets a rank in every
    score, items of one value the mean of the places they share; a null score shares the worst place. Items
    are ordered by weighted median rank (the middle of the two central ranks where the weights split evenly),
    then mean rank, then item. Only ranks enter, so no score's range or spread counts. Rows with a null group
    or item are left out; of rows repeated for one (group, item) the best value of each score counts; other
    columns are ignored. Result: group, item, median_rank, mean_rank, place (from 1). A group may be of any size.
    """
    names = list(scores)
    value = {c: (F.col(c).cast("double") if end == "low" else -F.col(c).cast("double")) for c, (end, _) in scores.items()}
    rows = items.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(*[F.min(F.when(~F.isnan(v), v)).alias(c) for c, v in value.items()])
    rows = keep(rows)
    # null values become +infinity: one shared place behind all others
    entry = F.posexplode(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(float("inf"))) for c in names])).alias("s", "v")
    long = rows.select("g", "i", entry)
    values = count_before(long.groupBy("g", "s", "v").agg(F.count("*").alias("n")), ["g", "s"], ["v"], "n", "before")
    ranks = keep(values.select("g", "s", "v", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank")))
    # values that HOT rows and more share (such as the missing ones of a long list) would gather in one task: they are at most rows / HOT, and go to the rows
    hot = long.join(F.broadcast(ranks.filter(F.col("n") >= HOT).drop("n")), ["g", "s", "v"], "left")
    rest = hot.filter("rank is null").drop("rank").join(ranks.filter(F.col("n") < HOT).drop("n"), ["g", "s", "v"])
    ranked = hot.filter("rank is not null").unionByName(rest)
    weights = F.element_at(F.array(*[F.lit(float(w)) for _, w in scores.values()]), F.col("s") + 1)
    each = ranked.withColumn("w", weights)
    one = each.groupBy("g", "i").agg(
        F.sort_array(F.collect_list(F.struct("rank", "w"))).alias("rw"),  # one entry per score
        (F.sum(F.col("rank") * F.col("w")) / F.sum("w")).alias("mean_rank"),
        F.sum("w").alias("total"),
    )
    step = "aggregate(rw, named_struct('s', 0D, 'lo', double(null), 'hi', double(null)), (a, x) -> named_struct('s', a.s + x.w, 'lo', coalesce(a.lo, if(a.s + x.w >= total / 2, x.rank, null)), 'hi', coalesce(a.hi, if(a.s + x.w > total / 2, x.rank, null))), a -> (a.lo + coalesce(a.hi, a.lo)) / 2)"
    one = one.select("g", "i", F.round(F.expr(step), 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"), F.lit(1).alias("n"))
    placed = count_before(one, ["g"], ["median_rank", "mean_rank", "i"], "n", "before")
    return placed.select(F.col("g").alias(group), F.col("i").alias(item), "median_rank", "mean_rank", (F.col("before") + 1).cast("long").alias("place"))


def latest_signals(signals: DataFrame) -> DataFrame:
    """The latest observation of each site; ranks that aren't positive are unknown, as are negative counts."""
    known = signals.filter("site_id is not null")
    last = known.groupBy("site_id").agg(F.max(F.struct("observed_at", "received_at", "tranco_rank", "harmonic_rank", "linking_domains", "fact_checks")).alias("x"))
    ranks = [F.when(F.col(f"x.{c}") > 0, F.col(f"x.{c}")).alias(c) for c in ("tranco_rank", "harmonic_rank")]
    counts = [F.when(F.col(f"x.{c}") >= 0, F.col(f"x.{c}")).alias(c) for c in ("linking_domains", "fact_checks")]
    return last.select("site_id", *ranks, *counts)


def p1_ranking(spark, d):
    """The whole order of every candidate list."""
    lists = table(spark, d, "candidate_lists").select("query_id", "site_id").distinct()
    scored = lists.join(latest_signals(table(spark, d, "site_signals")), "site_id", "left")
    return median_rank(scored, "query_id", "site_id", SCORES)


def p1_found(spark, d):
    """The first site of each list."""
    return p1_ranking(spark, d).filter("place = 1").select("query_id", "site_id")


QUERIES = {"p1_found": p1_found, "p1_ranking": p1_ranking}

_RANKS = """
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY observed_at DESC NULLS LAST, received_at DESC NULLS LAST, tranco_rank DESC NULLS LAST, harmonic_rank DESC NULLS LAST, linking_domains DESC NULLS LAST, fact_checks DESC NULLS LAST) AS rn FROM site_signals WHERE site_id IS NOT NULL) WHERE rn = 1),
rows AS (SELECT DISTINCT c.query_id, c.site_id,
  CASE WHEN tranco_rank > 0 THEN tranco_rank END::DOUBLE AS a, CASE WHEN harmonic_rank > 0 THEN harmonic_rank END::DOUBLE AS b,
  CASE WHEN linking_domains >= 0 THEN -linking_domains END::DOUBLE AS c, CASE WHEN fact_checks >= 0 THEN -fact_checks END::DOUBLE AS d
  FROM candidate_lists c LEFT JOIN last USING (site_id) WHERE c.query_id IS NOT NULL AND c.site_id IS NOT NULL),
ranks AS (SELECT query_id, site_id,
  rank() OVER (PARTITION BY query_id ORDER BY a NULLS LAST) + (count(*) OVER (PARTITION BY query_id, a) - 1) / 2 AS ra,
  rank() OVER (PARTITION BY query_id ORDER BY b NULLS LAST) + (count(*) OVER (PARTITION BY query_id, b) - 1) / 2 AS rb,
  rank() OVER (PARTITION BY query_id ORDER BY c NULLS LAST) + (count(*) OVER (PARTITION BY query_id, c) - 1) / 2 AS rc,
  rank() OVER (PARTITION BY query_id ORDER BY d NULLS LAST) + (count(*) OVER (PARTITION BY query_id, d) - 1) / 2 AS rd FROM rows),
lists AS (SELECT query_id, site_id, list_sort([ra, rb, rc, rd]) AS r, (ra + rb + rc + rd) / 4 AS mean_rank FROM ranks),
placed AS (SELECT query_id, site_id, (r[2] + r[3]) / 2 AS median_rank, mean_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY (r[2] + r[3]) / 2, mean_rank, site_id) AS place FROM lists)
"""

SQL = {
    "p1_found": _RANKS + "SELECT query_id, site_id FROM placed WHERE place = 1",
    "p1_ranking": _RANKS + "SELECT query_id, site_id, median_rank, mean_rank, place FROM placed",
}
