"""Folding observations of a site into one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.sources.tables import table

#: Most names and link texts that a site keeps.
NAMES, LINK_TEXTS = 16, 32


def _newest(value: str, by: str) -> Column:
    """The newest value that isn't null: gaps are filled from older ones."""
    return F.max(F.when(F.col(value).isNotNull(), F.struct(by, value)))[value].alias(value)


def site_merge(spark, d):
    items = table(spark, d, "site_items").filter("id is not null")
    return items.groupBy("id").agg(F.max("rev").alias("rev"), *[_newest(c, "rev") for c in ("title", "url", "about", "lang")], F.max("weight").alias("weight"))


def journal_latest(spark, d):
    items = table(spark, d, "site_items").filter("id is not null")
    return items.groupBy("id").agg(F.max("rev").alias("rev"), F.count_distinct("rev").alias("revisions"))


# Least checked facts, usual accuracy and the checks it counts as, and the accuracy of a site wrong throughout.
MIN_CHECKS, PRIOR, PRIOR_CHECKS, WRONG = 5, 0.97, 10, 0.5


def accuracy(checks: Column, agrees: Column) -> Column:
    """Smoothed share of right facts; null below MIN_CHECKS."""
    return F.when(checks >= MIN_CHECKS, (F.least(agrees, checks) + PRIOR * PRIOR_CHECKS) / (checks + PRIOR_CHECKS))


def signals(spark, d) -> DataFrame:
    """Best ranks, largest counts, any official flag of each site; unknown ranks (not above 0) don't count.

    Of several pairs of checked facts the one of the lowest accuracy counts, and none if any has too few checks.
    """
    s = table(spark, d, "site_signals").filter("domain is not null")
    rank = lambda c: F.min(F.when(F.col(c) > 0, F.col(c))).alias(c)
    most = lambda c: F.max(c).alias(c)
    checks, agrees = F.coalesce("fact_checks", F.lit(0)), F.coalesce("fact_agrees", F.lit(0))
    s = s.withColumn("f", F.struct(accuracy(checks, agrees).alias("a"), checks.alias("c"), agrees.alias("g")))
    worst, few = F.min("f").alias("f"), F.max((checks < MIN_CHECKS)).alias("few")
    one = s.groupBy("domain").agg(rank("harmonic_rank"), rank("pagerank_rank"), rank("tranco_rank"), most("linking_domains"), most("sitelinks"), F.bool_or("official_site").alias("official_site"), worst, few)
    fact = lambda c, name: F.when(F.col("few"), 0).otherwise(F.col(f"f.{c}")).alias(name)
    return one.select("*", fact("c", "fact_checks"), fact("g", "fact_agrees")).drop("f", "few")


def trust(checks: Column, agrees: Column) -> Column:
    """How far a site's accuracy is from the usual one, from -1 to 1; 0 below MIN_CHECKS."""
    a = accuracy(checks, agrees)
    return F.when(a >= PRIOR, (a - PRIOR) / (1 - PRIOR)).when(a < PRIOR, F.greatest((a - PRIOR) / (PRIOR - WRONG), F.lit(-1.0))).otherwise(0.0)


def with_link_score(sites: DataFrame) -> DataFrame:
    """Popularity by the best rank on a logarithmic scale, linking domains, official status and trust, from 0 to 1."""
    of = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(1 - F.log(F.col(c)) / F.log(F.lit(1e8)), F.lit(1.0)), F.lit(0.0)))
    best = F.coalesce(F.greatest(of("harmonic_rank"), of("pagerank_rank"), of("tranco_rank")), F.lit(0.0))
    links = F.least(F.log1p(F.coalesce("linking_domains", F.lit(0))) / F.log1p(F.lit(1e5)), F.lit(1.0))
    official = F.when(F.col("official_site"), 0.15 + 0.05 * F.least(F.log1p(F.coalesce("sitelinks", F.lit(0))) / F.log(F.lit(201.0)), F.lit(1.0))).otherwise(0.0)
    score = 0.75 * best + 0.25 * links + official + 0.1 * trust(F.coalesce("fact_checks", F.lit(0)), F.coalesce("fact_agrees", F.lit(0)))
    return sites.withColumn("link_score", F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)))


def link_score(spark, d):
    return with_link_score(signals(spark, d)).select("domain", F.round("link_score", 5).alias("link_score"))


def top_sites(spark, d):
    return with_link_score(signals(spark, d)).select("domain", F.round("link_score", 5).alias("score")).orderBy(F.desc("score"), "domain").limit(100)


def fact_trust(spark, d):
    s = signals(spark, d)
    return s.filter("fact_checks >= 5").select("domain", F.round(trust(F.col("fact_checks"), F.col("fact_agrees")), 5).alias("trust"))


def linker_estimate(spark, d):
    """Linking sites of each target by linear counting over the OR of the 64-bit sketches; 300 where all bits are set."""
    a = table(spark, d, "anchors").groupBy("target_domain").agg(F.bit_or("linkers").alias("sketch"), F.count_distinct("linking_domain").alias("linking"))
    bits = F.bit_count(F.col("sketch"))
    return a.select("target_domain", "linking", F.when(bits == 64, 300).otherwise(F.round(64 * F.log(64 / (64 - bits)))).cast("int").alias("estimate"))


def link_names(spark, d):
    """Names that a site's links agree on: used by three linking sites and in a twentieth of its links."""
    a = table(spark, d, "anchors").select("target_domain", "linking_domain", T.normalize(F.col("anchor_text")).alias("name")).filter("name <> ''")
    uses = a.groupBy("target_domain", "name").agg(F.count("*").alias("uses"), F.count_distinct("linking_domain").alias("sites"))
    total = uses.groupBy("target_domain").agg(F.sum("uses").alias("total"))
    return uses.join(total, "target_domain").filter((F.col("sites") >= 3) & (F.col("uses") >= 0.05 * F.col("total"))).select("target_domain", "name", "uses", "sites")


def link_texts(spark, d):
    """The most used link texts of each site, at most LINK_TEXTS."""
    a = table(spark, d, "anchors").filter("target_domain is not null").select("target_domain", T.normalize(F.col("anchor_text")).alias("text")).filter("text <> ''")
    w = Window.partitionBy("target_domain").orderBy(F.desc("n"), "text")
    return a.groupBy("target_domain", "text").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= LINK_TEXTS)


def names_union(spark, d):
    """Names of a site over all revisions, one for each normal form, the newest spelling first, at most NAMES."""
    n = table(spark, d, "site_items").filter("id is not null").select("id", "rev", F.explode("names").alias("name")).withColumn("form", T.joined(F.col("name"))).filter("form <> ''")
    one = n.groupBy("id", "form").agg(F.max(F.struct("rev", "name")).alias("x")).select("id", "form", F.col("x.rev").alias("rev"), F.col("x.name").alias("name"))
    w = Window.partitionBy("id").orderBy(F.desc("rev"), "form")
    return one.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= NAMES).select("id", "name", "place")


def late_rows(spark, d):
    """Observations that arrived more than a week after they were made, by week of arrival."""
    s = table(spark, d, "site_signals").filter(F.col("received_at") > F.col("observed_at") + F.expr("INTERVAL 7 DAYS"))
    return s.groupBy(F.date_format(F.date_trunc("week", "received_at"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("late"))


QUERIES = {f.__name__: f for f in (site_merge, journal_latest, link_score, top_sites, fact_trust, linker_estimate, link_names, link_texts, names_union, late_rows)}
_SIGNALS = """s AS (SELECT domain, min(CASE WHEN harmonic_rank > 0 THEN harmonic_rank END) AS h, min(CASE WHEN pagerank_rank > 0 THEN pagerank_rank END) AS p, min(CASE WHEN tranco_rank > 0 THEN tranco_rank END) AS t,
  max(linking_domains) AS l, max(sitelinks) AS sl, bool_or(official_site) AS o FROM site_signals WHERE domain IS NOT NULL GROUP BY 1),
fp AS (SELECT domain, coalesce(fact_checks, 0) AS c, least(coalesce(fact_agrees, 0), coalesce(fact_checks, 0)) AS g0, coalesce(fact_agrees, 0) AS g FROM site_signals WHERE domain IS NOT NULL),
fr AS (SELECT *, min(c) OVER (PARTITION BY domain) AS least_c, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN c >= 5 THEN (g0 + 9.7::DOUBLE) / (c + 10) END NULLS FIRST, c, g) AS rn FROM fp),
f AS (SELECT domain, CASE WHEN least_c < 5 THEN 0 ELSE c END AS c, CASE WHEN least_c < 5 THEN 0 ELSE g0 END AS g FROM fr WHERE rn = 1),
tr AS (SELECT domain, c, CASE WHEN c >= 5 THEN CASE WHEN (g + 9.7::DOUBLE) / (c + 10) >= 0.97::DOUBLE THEN ((g + 9.7::DOUBLE) / (c + 10) - 0.97::DOUBLE) / (1 - 0.97::DOUBLE) ELSE greatest(((g + 9.7::DOUBLE) / (c + 10) - 0.97::DOUBLE) / (0.97::DOUBLE - 0.5), -1.0::DOUBLE) END ELSE 0.0 END::DOUBLE AS trust FROM f)"""
_SCORE = """sc AS (SELECT domain, greatest(least(
  0.75 * coalesce(greatest(least(greatest(1 - ln(h) / ln(1e8), 0), 1), least(greatest(1 - ln(p) / ln(1e8), 0), 1), least(greatest(1 - ln(t) / ln(1e8), 0), 1)), 0)
  + 0.25 * least(ln(1 + coalesce(l, 0)) / ln(1 + 1e5), 1) + CASE WHEN o THEN 0.15 + 0.05 * least(ln(1 + coalesce(sl, 0)) / ln(201), 1) ELSE 0 END + 0.1 * trust, 1), 0)::DOUBLE AS score FROM s JOIN tr USING (domain))"""
SQL = {
    "site_merge": "SELECT id, max(rev) AS rev, " + ", ".join(f"max(CASE WHEN {c} IS NOT NULL THEN {{'rev': rev, 'v': {c}}} END).v AS {c}" for c in ("title", "url", "about", "lang")) + ", max(weight) AS weight FROM site_items WHERE id IS NOT NULL GROUP BY 1",
    "journal_latest": "SELECT id, max(rev) AS rev, count(DISTINCT rev) AS revisions FROM site_items WHERE id IS NOT NULL GROUP BY 1",
    "link_score": f"WITH {_SIGNALS}, {_SCORE} SELECT domain, round(score, 5) AS link_score FROM sc",
    "top_sites": f"WITH {_SIGNALS}, {_SCORE} SELECT domain, round(score, 5) AS score FROM sc ORDER BY round(score, 5) DESC, domain LIMIT 100",
    "fact_trust": f"WITH {_SIGNALS} SELECT domain, round(trust, 5) AS trust FROM tr WHERE c >= 5",
    "linker_estimate": "WITH a AS (SELECT target_domain, bit_count(bit_or(linkers)) AS b, count(DISTINCT linking_domain) AS linking FROM anchors GROUP BY 1) SELECT target_domain, linking, CASE WHEN b = 64 THEN 300 ELSE round(64 * ln(64 / (64 - b)))::INT END AS estimate FROM a",
    "link_names": f"WITH a AS (SELECT target_domain, linking_domain, array_to_string({T.words_sql('anchor_text')}, ' ') AS name FROM anchors), u AS (SELECT target_domain, name, count(*) AS uses, count(DISTINCT linking_domain) AS sites, sum(count(*)) OVER (PARTITION BY target_domain) AS total FROM a WHERE name <> '' GROUP BY 1, 2) SELECT target_domain, name, uses, sites FROM u WHERE sites >= 3 AND uses >= 0.05 * total",
    "link_texts": f"WITH a AS (SELECT target_domain, array_to_string({T.words_sql('anchor_text')}, ' ') AS text FROM anchors WHERE target_domain IS NOT NULL), u AS (SELECT target_domain, text, count(*) AS n FROM a WHERE text <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY target_domain ORDER BY n DESC, text) AS place FROM u) SELECT * FROM r WHERE place <= 32",
    "names_union": f"WITH n AS (SELECT id, rev, unnest(names) AS name FROM site_items WHERE id IS NOT NULL), f AS (SELECT *, array_to_string({T.words_sql('name')}, '') AS form FROM n), o AS (SELECT id, form, max({{'rev': rev, 'name': name}}) AS x FROM f WHERE form <> '' GROUP BY 1, 2), r AS (SELECT id, x.name AS name, row_number() OVER (PARTITION BY id ORDER BY x.rev DESC, form) AS place FROM o) SELECT * FROM r WHERE place <= 16",
    "late_rows": "SELECT strftime(date_trunc('week', received_at), '%Y-%m-%d') AS week, count(*) AS late FROM site_signals WHERE received_at > observed_at + INTERVAL 7 DAYS GROUP BY 1",
}
