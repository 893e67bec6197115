"""The link graph: edges, seeded rank, positions and co-citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.ranking import count_before
from webloom.plans.lineage import keep
from webloom.sources.tables import table

# Part of a rank that follows links, best Tranco ranks that are seeds, least number of ways a rank is split, and change at which rounds stop.
DAMPING, SEED_TRANCO, MIN_SHARES, CONVERGED = 0.85, 100_000, 10, 1e-7
#: Rounds at most, and most similar sites of a list.
ROUNDS, SIMILAR = 200, 20


def organization(domain: Column) -> Column:
    """The name behind a site: the first label of its registrable domain."""
    return F.substring_index(F.coalesce(U.registrable_domain(domain), domain), ".", 1)


def edges(spark, d) -> DataFrame:
    """src, dst: distinct links between sites of different organizations."""
    a = table(spark, d, "anchors").filter("linking_domain is not null and target_domain is not null and linking_domain <> target_domain")
    links = a.select(F.col("linking_domain").alias("src"), F.col("target_domain").alias("dst")).distinct()
    return links.filter(organization(F.col("src")) != organization(F.col("dst")))


def resolved(links: DataFrame, redirects: DataFrame) -> DataFrame:
    """links with both ends replaced by where redirects (site, target) lead, over at most four hops; a loop stays put.

    Links that end at their own source, and repeats, are dropped; a site redirected twice takes the smaller target.
    """
    one = redirects.filter("site is not null and target is not null and site <> target").groupBy("site").agg(F.min("target").alias("t"))
    hops = one.select("site", F.col("t").alias("to"))
    for _ in range(4):
        hops = hops.join(one.select(F.col("site").alias("to"), F.col("t").alias("more")), "to", "left").select("site", F.coalesce("more", "to").alias("to"))
    ends = keep(hops.join(one.select(F.col("site").alias("to")), "to", "left_anti"))
    end = lambda side: ends.select(F.col("site").alias(side), F.col("to").alias(f"{side}_to"))
    both = links.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    return both.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst")).filter("src <> dst").distinct()


def seeded_rank(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, rank of links (src, dst) with seeds (node): the rank of every site, in all 1.

    A site's rank is split evenly among its links, at least MIN_SHARES ways; what follows no link goes to the seeds. Without
    seeds every site is one. Stops once all ranks together move less than CONVERGED. Each round is written, so a lost
    executor costs one round. An empty graph has no ranks but its seeds'.
    """
    e = keep(links.join(links.groupBy("src").agg(F.count("*").alias("n")), "src").select("src", "dst", F.greatest("n", F.lit(MIN_SHARES)).alias("ways"), "n"))
    named = seeds.filter("node is not null").select("node").distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).union(named).distinct()
    if named.isEmpty():
        named = nodes
    count = named.count()
    share = e.groupBy(F.col("src").alias("node")).agg((F.first("n") / F.first("ways")).alias("follows"))
    start = keep(nodes.join(named.withColumn("s", F.lit(True)), "node", "left").join(share, "node", "left").select("node", F.coalesce("s", F.lit(False)).alias("seed"), F.coalesce("follows", F.lit(0.0)).alias("follows")))
    ranks = start.withColumn("rank", F.when(F.col("seed"), F.lit(1.0 / max(count, 1))).otherwise(0.0))
    followed = float(ranks.agg(F.sum(F.col("rank") * F.col("follows"))).first()[0] or 0.0)
    for _ in range(rounds):
        given = ranks.select(F.col("node").alias("src"), "rank").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("ways")).alias("got"))
        to_seeds = (1 - DAMPING * followed) / max(count, 1)
        new = DAMPING * F.coalesce("got", F.lit(0.0)) + F.when(F.col("seed"), F.lit(to_seeds)).otherwise(0.0)
        moved = ranks.join(given, "node", "left").select("node", "seed", "follows", F.col("rank").alias("old"), new.alias("rank"))
        seen = Observation()
        ranks = keep(moved.observe(seen, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change"), F.sum(F.col("rank") * F.col("follows")).alias("followed"))).drop("old")
        followed = seen.get["followed"] or 0.0
        if (seen.get["change"] or 0.0) < CONVERGED:
            break
    return ranks.select("node", "rank")


def seeds(spark, d) -> DataFrame:
    """node: official sites and the best of Tranco's."""
    return table(spark, d, "site_signals").filter(f"official_site or tranco_rank between 1 and {SEED_TRANCO}").select(F.col("domain").alias("node")).distinct()


def trust_rank(spark, d):
    """Each site's rank as a multiple of the mean."""
    ranks = seeded_rank(edges(spark, d), seeds(spark, d))
    whole = ranks.agg(F.count("*").alias("n"))
    return ranks.crossJoin(F.broadcast(whole)).select("node", F.round(F.col("rank") * F.col("n"), 3).alias("score"))  # one row


def in_degree(spark, d):
    return edges(spark, d).groupBy("dst").agg(F.count("*").alias("linking"))


def untrusted_in_degree(spark, d):
    """Linking sites of each target, and those of them that no seed leads to."""
    e = edges(spark, d)
    trusted = seeded_rank(e, seeds(spark, d)).filter("rank > 0").select(F.col("node").alias("src"), F.lit(1).alias("trusted"))
    return e.join(trusted, "src", "left").groupBy("dst").agg(F.count("*").alias("linking"), F.count_if(F.col("trusted").isNull()).alias("untrusted"))


def rank_positions(spark, d):
    """Places of the sites with a record and some rank, best first, ties by name; any number of sites."""
    records = table(spark, d, "site_items").filter("id is not null").select(F.col("id").alias("node")).distinct()
    ranks = seeded_rank(edges(spark, d), seeds(spark, d)).filter("rank > 0").join(records, "node", "left_semi")
    rows = ranks.select("node", F.lit(0).alias("all"), F.lit(1).alias("one"), (-F.round("rank", 7)).alias("by"))
    return count_before(rows, ["all"], ["by", "node"], "one", "before").select("node", (F.col("before") + 1).alias("position"))


def cocitation(spark, d):
    """The sites most often linked by the same trusted sites as each site whose id is divisible by 20: at most SIMILAR, with similarity.

    Shared linking sites over the geometric mean of both sites' trusted links; two at least, and of another organization.
    Linking sites of any number of targets count.
    """
    e = keep(edges(spark, d).join(seeded_rank(edges(spark, d), seeds(spark, d)).filter("rank > 0").select(F.col("node").alias("src")), "src", "left_semi"))
    asked = table(spark, d, "site_signals").filter("site_id % 20 = 0").select(F.col("domain").alias("site")).distinct()
    mine = e.join(asked.select(F.col("site").alias("dst")), "dst", "left_semi").select("src", F.col("dst").alias("site"))
    shared = mine.join(e, "src").filter("site <> dst").groupBy("site", "dst").agg(F.count("*").alias("shared")).filter("shared >= 2")
    shared = shared.filter(organization(F.col("site")) != organization(F.col("dst")))
    degree = e.groupBy("dst").agg(F.count("*").alias("links"))
    both = shared.join(degree, "dst").join(degree.select(F.col("dst").alias("site"), F.col("links").alias("own")), "site")
    like = both.select("site", F.col("dst").alias("like"), "shared", F.round(F.col("shared") / F.sqrt(F.col("links") * F.col("own")), 6).alias("similarity"))
    w = Window.partitionBy("site").orderBy(F.desc("similarity"), "like")
    return like.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= SIMILAR)


QUERIES = {f.__name__: f for f in (in_degree, untrusted_in_degree, trust_rank, rank_positions, cocitation)}


def _organization_sql(c: str) -> str:
    return f"string_split(coalesce({U.domain_sql(c)}, {c}), '.')[1]"


_EDGES = f"e AS (SELECT DISTINCT linking_domain AS src, target_domain AS dst FROM anchors WHERE linking_domain IS NOT NULL AND target_domain IS NOT NULL AND linking_domain <> target_domain AND {_organization_sql('linking_domain')} <> {_organization_sql('target_domain')})"
_RANKS = f"""{_EDGES}, w AS (SELECT src, dst, greatest(count(*) OVER (PARTITION BY src), {MIN_SHARES}) AS ways FROM e), sd AS (SELECT DISTINCT domain AS node FROM site_signals WHERE domain IS NOT NULL AND (official_site OR tranco_rank BETWEEN 1 AND {SEED_TRANCO})),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT node FROM sd), k AS (SELECT greatest(count(*), 1) AS k FROM sd), s AS (SELECT nodes.node, sd.node IS NOT NULL AS seed FROM nodes LEFT JOIN sd ON nodes.node = sd.node),
r AS (SELECT 0 AS i, node, seed, CASE WHEN seed THEN 1.0::DOUBLE / k ELSE 0 END AS rank, 1.0::DOUBLE AS change FROM s, k UNION ALL
SELECT i + 1, node, seed, fresh, sum(abs(fresh - rank)) OVER () FROM (SELECT r.i, r.node, r.seed, r.rank, {DAMPING} * coalesce(g.got, 0) + CASE WHEN seed THEN (1 - {DAMPING} * f.f) / k ELSE 0 END AS fresh FROM r LEFT JOIN (SELECT dst, sum(rank / ways) AS got FROM r JOIN w ON r.node = w.src GROUP BY 1) AS g ON r.node = g.dst, (SELECT coalesce(sum(rank / ways), 0) AS f FROM r JOIN w ON r.node = w.src) AS f, k WHERE r.change >= {CONVERGED} AND r.i < {ROUNDS})),
ranks AS (SELECT node, rank FROM r WHERE i = (SELECT max(i) FROM r))"""
SQL = {
    "in_degree": f"WITH {_EDGES} SELECT dst, count(*) AS linking FROM e GROUP BY 1",
    "untrusted_in_degree": f"WITH RECURSIVE {_RANKS} SELECT dst, count(*) AS linking, count(*) FILTER (rank = 0) AS untrusted FROM e JOIN ranks ON src = node GROUP BY 1",
    "trust_rank": f"WITH RECURSIVE {_RANKS} SELECT node, round(rank * (SELECT count(*) FROM ranks), 3) AS score FROM ranks",
    "rank_positions": f"WITH RECURSIVE {_RANKS} SELECT node, row_number() OVER (ORDER BY round(rank, 7) DESC, node) AS position FROM ranks WHERE rank > 0 AND node IN (SELECT id FROM site_items)",
    "cocitation": f"WITH RECURSIVE {_RANKS}, t AS (SELECT e.* FROM e JOIN ranks ON src = node WHERE rank > 0), q AS (SELECT DISTINCT domain AS site FROM site_signals WHERE site_id % 20 = 0), dg AS (SELECT dst, count(*) AS n FROM t GROUP BY 1), p AS (SELECT a.dst AS site, b.dst AS lk, count(*) AS shared FROM t a JOIN q ON a.dst = q.site JOIN t b ON a.src = b.src AND a.dst <> b.dst GROUP BY 1, 2 HAVING count(*) >= 2), z AS (SELECT site, lk AS \"like\", shared, round(shared / sqrt(x.n::DOUBLE * y.n), 6) AS similarity FROM p JOIN dg x ON x.dst = site JOIN dg y ON y.dst = lk WHERE {_organization_sql('site')} <> {_organization_sql('lk')}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY similarity DESC, \"like\") AS place FROM z) WHERE place <= {SIMILAR}",
}
